"""Domain tables and requests, derived from the driver's tables.

Each entry is the body of a common table expression that runs unchanged on Spark and on DuckDB; only the names
in braces differ: the base tables, and the type of a time without zone. Every row of the base tables takes part.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pillflow.session import scratch_path
from pillflow.sources.tables import COMPACT, write_table

AS_OF = "2000-01-01"
AS_OF_TIME = "2000-01-01 08:30:00"

BASE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

BODIES = {
    # Order lines by their key, which repeats in the data.
    "lines": """
        SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity,
               min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus,
               CAST(min(l_shipdate) AS DATE) AS l_shipdate
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Each name has a channel number; chilled and heated goods are not in the dispenser to begin with.
    "names": """
        SELECT p_name AS n_name, min(p_partkey) + 1 AS n_number, NOT (p_name LIKE 'cold%' OR p_name LIKE 'hot%') AS n_held
        FROM {part} GROUP BY p_name""",
    "stock": """
        SELECT CAST(10000000 + l_orderkey * 10 + l_linenumber AS STRING) AS barcode, p_name AS name,
               CAST(l_quantity AS INT) AS menge, CAST(l_shipdate + INTERVAL 730 DAY AS DATE) AS verfallsdatum,
               CASE WHEN l_linestatus = 'F' AND n_held THEN 'Automat' ELSE 'Lager' END AS ort,
               CASE WHEN l_linestatus = 'F' AND n_held THEN 'Kanal ' || CAST(n_number AS STRING) END AS kanal
        FROM lines JOIN {part} ON l_partkey = p_partkey JOIN names ON p_name = n_name
        WHERE l_returnflag = 'N'""",
    # What is not in stock has been ordered. Returned lines (R) name the barcode next to their own, so some
    # ordered barcodes are in stock as well and some are ordered twice.
    "bestellungen": """
        SELECT l_orderkey * 10 + l_linenumber AS id, 100000 + l_orderkey AS bestellgruppe_id,
               CAST(10000000 + o_custkey AS STRING) AS kundennummer,
               CAST(10000000 + l_orderkey * 10 + l_linenumber + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS STRING) AS barcode,
               p_name AS name, CAST(o_orderdate AS {ntz}) AS bestelldatum,
               CASE o_orderstatus WHEN 'O' THEN 'Offen' WHEN 'F' THEN 'Genehmigt' ELSE 'Storniert' END AS status
        FROM lines JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey
        WHERE l_returnflag <> 'N'""",
    "users": """
        SELECT c_custkey + 1 AS id, CAST(10000000 + c_custkey AS STRING) AS kundennummer, c_name AS username,
               CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'user' END AS role
        FROM {customer}""",
    "action_log": """
        SELECT substring(CAST(ts AS STRING), 1, 19) AS zeitstempel, CAST(10000000 + user_id AS STRING) AS kundennummer,
               CASE event_type WHEN 'error' THEN 'Systemfehler: Timeout' WHEN 'purchase' THEN 'Bestellung "' || CAST(event_id AS STRING) || '" aufgegeben'
                    WHEN 'signup' THEN 'Registrierung erfolgreich' WHEN 'view' THEN 'Benutzer hat Lagerbestand gefiltert'
                    ELSE 'Medikament zum Warenkorb' END AS aktion
        FROM {events}""",
    # Warnings on goods there are a lot of, and on everything ordered: those are orphans, unless still in stock.
    "warnungen": """
        SELECT barcode, min(name) AS name, min(verfallsdatum) AS verfallsdatum, min(ort) AS ort, min(status) AS status
        FROM (SELECT barcode, name, verfallsdatum, 'Lager' AS ort, 'Offen' AS status FROM stock WHERE menge >= 40
              UNION ALL
              SELECT barcode, name, CAST(bestelldatum AS DATE), 'Automat', 'Medikament abgelaufen' FROM bestellungen) w
        GROUP BY barcode""",
    # One request per line and day of shipping, in the order of lines. Some lines stand for goods not seen before
    # (tax), some for mistakes in the form (quantity).
    "requests": """
        SELECT (l_orderkey * 10 + l_linenumber) * 100000
               + (year(ship_day) - 1970) * 372 + (month(ship_day) - 1) * 31 + day(ship_day) AS seq,
               l_orderkey, l_linenumber, ship_day, l_partkey, l_quantity,
               10000000 + l_orderkey * 10 + l_linenumber AS code_number, l_tax
        FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_day, min(l_partkey) AS l_partkey,
                     min(l_quantity) AS l_quantity, min(l_tax) AS l_tax
              FROM {lineitem} GROUP BY l_orderkey, l_linenumber, CAST(l_shipdate AS DATE)) d""",
    "intake_req": """
        SELECT seq,
               CASE WHEN l_quantity = 50 THEN 'ABC' || CAST(code_number AS STRING)
                    WHEN l_quantity = 49 THEN ''
                    WHEN l_tax >= 0.04 THEN '9' || CAST(code_number AS STRING)
                    ELSE CAST(code_number AS STRING) END AS barcode,
               CASE WHEN l_quantity = 48 THEN '' WHEN l_quantity = 47 THEN NULL ELSE p_name END AS name,
               CASE WHEN l_quantity >= 45 THEN '2000-02-30' WHEN l_quantity = 44 THEN '2001-1-5'
                    ELSE CAST(CAST(ship_day + INTERVAL 730 DAY AS DATE) AS STRING) END AS verfallsdatum_raw,
               'Lager' AS ort
        FROM requests JOIN {part} ON l_partkey = p_partkey""",
    "barcode_req": """
        SELECT seq,
               CASE WHEN l_quantity = 50 THEN 'ABC' || CAST(code_number AS STRING)
                    WHEN l_quantity = 49 THEN ''
                    WHEN l_tax >= 0.06 THEN '9' || CAST(code_number AS STRING)
                    ELSE CAST(code_number AS STRING) END AS barcode
        FROM requests""",
    "cart_scans": """
        SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS cart_id, seq AS line_no,
               CASE WHEN l_quantity = 50 THEN 'ABC' || CAST(code_number AS STRING)
                    WHEN l_quantity = 49 THEN ''
                    ELSE CAST(code_number AS STRING) END AS barcode
        FROM requests""",
    # Goods in the dispenser, and a few that are not, are wanted both by a cart that gathers four orders (even
    # numbers) and, where there are many, by a cart of the customer (odd numbers).
    "wanted": """
        SELECT l_orderkey, o_custkey, l_orderkey * 10 + l_linenumber AS line_no, l_quantity
        FROM lines JOIN {part} ON l_partkey = p_partkey JOIN names ON p_name = n_name JOIN {orders} ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'N' AND ((l_linestatus = 'F' AND n_held) OR l_quantity >= 48)""",
    "cart_lines": """
        SELECT CAST(floor(l_orderkey / 4) AS BIGINT) * 2 AS cart_id, line_no, CAST(10000000 + line_no AS STRING) AS barcode
        FROM wanted
        UNION ALL
        SELECT o_custkey * 2 + 1, line_no, CAST(10000000 + line_no AS STRING) FROM wanted WHERE l_quantity >= 15""",
    # Every customer has a cart, if only an empty one; customers in debt are not known by number.
    "carts": """
        SELECT CAST(floor(o_orderkey / 4) AS BIGINT) * 2 AS cart_id, min(CAST(10000000 + o_custkey AS STRING)) AS kundennummer
        FROM {orders} GROUP BY CAST(floor(o_orderkey / 4) AS BIGINT) * 2
        UNION ALL
        SELECT c_custkey * 2 + 1, CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(10000000 + c_custkey AS STRING) END
        FROM {customer}""",
    # Each order is cancelled once by its customer and once more by somebody else, nobody or the same customer.
    "cancel_req": """
        SELECT o_orderkey * 2 AS seq, 100000 + o_orderkey AS bestellgruppe_id,
               CAST(10000000 + o_custkey AS STRING) AS kundennummer
        FROM {orders}
        UNION ALL
        SELECT o_orderkey * 2 + 1, CASE WHEN o_orderpriority = '2-HIGH' THEN 0 ELSE 100000 + o_orderkey END,
               CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '5-LOW' THEN '99999999'
                    ELSE CAST(10000000 + o_custkey AS STRING) END
        FROM {orders}""",
    # All open orders are approved; those of low priority are cancelled later.
    "status_req": """
        SELECT o_orderkey * 2 AS seq, 100000 + o_orderkey AS bestellgruppe_id, 'Genehmigt' AS status
        FROM {orders} WHERE o_orderstatus = 'O'
        UNION ALL
        SELECT o_orderkey * 2 + 1, 100000 + o_orderkey, 'Storniert' FROM {orders} WHERE o_orderpriority = '5-LOW'""",
    # Customers are taken, suppliers are new and come twice; some forget the name.
    "user_req": """
        SELECT c_custkey * 4 AS seq, c_name AS username, 'user' AS role FROM {customer}
        UNION ALL
        SELECT s_suppkey * 4 + 1, CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END,
               CASE WHEN s_nationkey = 0 THEN 'admin' ELSE NULL END FROM {supplier}
        UNION ALL
        SELECT s_suppkey * 4 + 3, s_name, 'user' FROM {supplier}""",
    "leaving": """
        SELECT c_name AS username FROM {customer} WHERE c_acctbal < 0
        UNION ALL
        SELECT s_name FROM {supplier}""",
}

_REFERENCE = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(BODIES)})\b")


def _needed(sql: str) -> list[str]:
    """The expressions a text builds on, each after those it needs itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for _, name in _REFERENCE.findall(text):
            if name not in found:
                visit(BODIES[name])
                found.append(name)

    visit(sql)
    return found


def with_clause(sql: str, extra: str = "", recursive: bool = False) -> str:
    """``sql`` preceded by the expressions it needs; ``extra`` holds further expressions of its own."""
    parts = [f"{name} AS ({BODIES[name]})" for name in _needed(f"{extra} {sql}")]
    if extra:
        parts.append(extra.strip())
    if not parts:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql


def for_duckdb(sql: str) -> str:
    """The text with DuckDB's names filled in."""
    return sql.format(ntz="TIMESTAMP", **{t: t for t in BASE_TABLES})


# Tables of the store, which are written as such.
_STORED_AS = {"stock": "stock", "bestellungen": "orders", "warnungen": "warnings", "users": "users"}

# Order lines are grouped by this key, which hardly repeats, so summing up before the shuffle would fill the memory of
# each task with as many groups as it reads rows. They are brought together first, in ranges of so many rows.
_LINE_KEY = "l_orderkey, l_linenumber"
_RANGE_ROWS = 1_000_000

# (session, folder, state of the files, table) -> schema and path of the written table
_stored: dict[tuple, tuple] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of the driver's files, so that changed data is derived anew."""
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet") for table in BASE_TABLES]
    files = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [files.getFileStatus(path) for path in paths]
    return tuple((status.getLen(), status.getModificationTime()) for status in found)


class Domain:
    """The tables over one folder of the driver's data: ``Domain(spark, sf_dir).stock`` and so on.

    In use these tables lie in storage, so each is derived once per session, from those it builds on, written to
    the shared folder and read from there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._origin = (spark.sparkContext.applicationId, self.sf_dir, _state(spark, self.sf_dir))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in BODIES:
            raise AttributeError(name)
        schema, path = self._written(name)
        return self.spark.read.schema(schema).parquet(path)

    def path_of(self, name: str) -> str:
        """Where a table lies."""
        return self._written(name)[1]

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Something else derived once per session, written and read from there."""
        schema, path = self._kept(name, build)
        return self.spark.read.schema(schema).parquet(path)

    def _written(self, name: str) -> tuple:
        return self._kept(name, lambda: self._derived(name))

    def _derived(self, name: str) -> DataFrame:
        sql = _REFERENCE.sub(lambda m: f"{m[1]} parquet.`{self._written(m[2])[1]}`", BODIES[name])
        tables = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in BASE_TABLES}
        if "{lineitem}" in sql:
            tables["lineitem"] = self._in_ranges(tables["lineitem"])
        return self.spark.sql(sql.format(ntz="TIMESTAMP_NTZ", **tables))

    def _in_ranges(self, lines: str) -> str:
        ranges = 1 + self.spark.sql(f"SELECT count(*) FROM {lines}").first()[0] // _RANGE_ROWS
        return f"(SELECT /*+ REPARTITION_BY_RANGE({ranges}, {_LINE_KEY}) */ * FROM {lines})"

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> tuple:
        key = (*self._origin, name)
        if key not in _stored:
            table, path = build(), scratch_path(self.spark, f"domain-{name}")
            if name in _STORED_AS:
                write_table(table, _STORED_AS[name], path)
            else:
                table.write.options(**COMPACT).parquet(path)
            _stored[key] = table.schema, path
        return _stored[key]
