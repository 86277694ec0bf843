"""Versions of the stored tables, written piece by piece.

Every table is cut into pieces by its key. A batch writes new files for the pieces it changes, or files beside the
old ones where it only adds rows, and then publishes a manifest: which files make up each piece, the highest numbers
ever given, the last micro-batch of each stream and what it has counted so far. A manifest is one small file in a folder per version, so reading
the current state does not depend on how many versions there have been, and leaving out its publication undoes the
batch. Files are never changed, so a reader stays with the version it began with. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pillflow.schemas import TABLES
from pillflow.sources.folders import newest_published, numbered, remove, size_of
from pillflow.sources.tables import BUCKET_KEYS, COMPACT, empty_table, read_table, stored_form, write_table

#: Choose the number of pieces so that one is some hundred megabytes large.
PIECES = 16
#: A piece that consists of so many additions is written anew with the next one.
MOST_PARTS = 8
#: Pieces of less than so many bytes, on average, are brought together into one file each after they are written.
SMALL = 1_000_000

KEYS = {"stock": "barcode", "warnings": "barcode", "orders": "bestellgruppe_id", "users": "username"}
#: Order groups in a row share a piece, so that new orders go to few pieces.
_GROUPS_TOGETHER = 64

# What is counted on from table to table: the highest number ever seen in these columns, rows since removed included.
_COUNTED = {
    "orders": {"order_id": "id", "order_group": "bestellgruppe_id", "customer_number": "kundennummer"},
    "users": {"user_id": "id", "customer_number": "kundennummer"},
}

# Columns by which the rows of a piece are sorted, so that a range of them lies together.
_SORTED = {"stock": ("verfallsdatum",)}

_ENTRY = "kind string, name string, piece int, path string, number long"


@dataclass(frozen=True)
class Rewrite:
    """The new content of some pieces; ``None`` stands for all."""

    rows: DataFrame
    pieces: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Append:
    """Rows that are added to a table."""

    rows: DataFrame


Change = DataFrame | Rewrite | Append


@dataclass(frozen=True)
class Manifest:
    """What is published with a version. ``parts``: per table and piece the folders that make it up."""

    version: int | None = None
    parts: dict[str, dict[int, tuple[str, ...]]] = field(default_factory=dict)
    buckets: dict[str, int] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    tallies: dict[str, int] = field(default_factory=dict)

    def entries(self) -> list[tuple]:
        return [
            *(("part", table, piece, path, None) for table, pieces in self.parts.items() for piece, paths in pieces.items() for path in paths),
            *(("buckets", table, None, None, n) for table, n in self.buckets.items()),
            *(("counter", name, None, None, n) for name, n in self.counters.items()),
            *(("batch", stream, None, None, n) for stream, n in self.batches.items()),
            *(("tally", name, None, None, n) for name, n in self.tallies.items()),
        ]


@dataclass(frozen=True)
class Staged:
    """Files that are written and not yet visible, by piece, and the pieces they replace (``None``: all)."""

    folders: dict[int, str]
    replaced: tuple[int, ...] | None
    buckets: int
    counters: dict[str, int]


def piece_of(table: str, pieces: int) -> Column:
    """The piece of a row, by the key of its table."""
    key = F.col(KEYS[table])
    if table == "orders":
        return F.coalesce(F.pmod(F.floor(key / _GROUPS_TOGETHER), F.lit(pieces)).cast("int"), F.lit(0))
    return F.pmod(F.hash(key), F.lit(pieces))


class Snapshots:
    """Tables under one root folder, in ``pieces`` pieces.

    With ``buckets``, tables with a unique barcode are instead written as a whole in that many buckets, so that they
    need not be shuffled when requests are joined to them; a change then rewrites all of such a table.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 0, pieces: int = PIECES):
        self.spark = spark
        self.root = root
        self.buckets = buckets
        self.pieces = pieces
        self._known = Manifest()

    def create_if_absent(self) -> None:
        """Start with empty tables unless there are some."""
        if self.version() is None:
            self.commit({table: empty_table(self.spark, table) for table in TABLES})

    def version(self) -> int | None:
        return newest_published(self.spark, f"{self.root}/published")

    def manifest(self) -> Manifest:
        """The current manifest."""
        version = self.version()
        if version is None:
            return Manifest()
        if version != self._known.version:
            self._known = self._manifest_of(version)
        return self._known

    def _manifest_of(self, version: int) -> Manifest:
        found = Manifest(version)
        for r in self.spark.read.schema(_ENTRY).json(f"{self.root}/published/version={version}").collect():
            if r.kind == "part":
                pieces = found.parts.setdefault(r.name, {})
                pieces[r.piece] = (*pieces.get(r.piece, ()), r.path)
            else:
                {"buckets": found.buckets, "counter": found.counters, "batch": found.batches, "tally": found.tallies}[r.kind][r.name] = r.number
        return found

    def changed(self, table: str, version: int) -> set[int]:
        """The pieces of a table that have been changed since a version."""
        now, then = self.manifest().parts.get(table, {}), self._manifest_of(version).parts.get(table, {})
        return {p for p in {*now, *then} if now.get(p) != then.get(p)}

    def counters(self) -> dict[str, int]:
        """The highest numbers ever given: ``order_id``, ``order_group``, ``user_id``, ``customer_number``."""
        return dict(self.manifest().counters)

    def tallies(self) -> dict[str, int]:
        """Counts that streams publish with their micro-batches."""
        return dict(self.manifest().tallies)

    def has_batch(self, stream: str, batch_id: int) -> bool:
        """Whether a micro-batch has been published already; streams number theirs upwards."""
        return self.manifest().batches.get(stream, -1) >= batch_id

    def touched(self, table: str, keys: DataFrame) -> tuple[int, ...]:
        """The pieces in which the keys lie: at most as many numbers as there are pieces."""
        return tuple(sorted(r[0] for r in keys.select(piece_of(table, self.pieces)).distinct().collect()))

    def read(self, table: str, pieces: Iterable[int] | None = None) -> DataFrame:
        """Current state of a table, or of some of its pieces."""
        manifest = self.manifest()
        parts = manifest.parts.get(table, {})
        if manifest.buckets.get(table):
            (path,) = parts[0]
            return read_table(self.spark, table, path, manifest.buckets[table])
        chosen = parts if pieces is None else [p for p in pieces if p in parts]
        paths = [path for p in chosen for path in parts[p]]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else empty_table(self.spark, table)

    def near(self, table: str, keys: DataFrame) -> tuple[DataFrame, tuple[int, ...] | None]:
        """The pieces of a table in which ``keys`` lie: their rows and their numbers (``None``: all, see ``buckets``).

        All rows with one of the keys are there, so an operation that only looks at and changes such rows can be
        given these pieces for the whole table.
        """
        if self.manifest().buckets.get(table):
            return self.read(table), None
        pieces = self.touched(table, keys)
        return self.read(table, pieces), pieces

    def _write(self, table: str, change: Rewrite) -> Staged:
        path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        if self.buckets and table in BUCKET_KEYS:
            write_table(change.rows, table, path, self.buckets)
            return Staged({0: path}, None, self.buckets, {})
        rows = stored_form(change.rows, table).withColumn("_piece", piece_of(table, self.pieces))
        # Each task writes a file for each piece of which it has rows: a shuffle by piece would move a large table once more.
        folders = self._in_pieces(table, rows, path)
        size, files = size_of(self.spark, path)
        if files > len(folders) and size < SMALL * len(folders):
            small = self.spark.read.schema(TABLES[table]).parquet(*folders.values())
            small = small.withColumn("_piece", piece_of(table, self.pieces)).hint("rebalance", "_piece")
            folders = self._in_pieces(table, small, f"{path}-together")
            remove(self.spark, path)
        return Staged(folders, change.pieces, 0, self._highest(table, list(folders.values())))

    def _in_pieces(self, table: str, rows: DataFrame, path: str) -> dict[int, str]:
        rows = rows.sortWithinPartitions("_piece", *_SORTED.get(table, ()))
        rows.write.options(**COMPACT).partitionBy("_piece").parquet(path)
        return {n: f"{path}/_piece={n}" for n in numbered(self.spark, path, "_piece")}

    def _highest(self, table: str, folders: list[str]) -> dict[str, int]:
        counted = _COUNTED.get(table, {})
        if not counted or not folders:
            return {}
        rows = self.spark.read.schema(TABLES[table]).parquet(*folders)
        found = rows.agg(*[F.max(F.col(c).try_cast("long")).alias(name) for name, c in counted.items()]).first()
        return {name: n for name, n in found.asDict().items() if n is not None}

    def _added(self, table: str, rows: DataFrame) -> Staged:
        """Added rows beside what there is; pieces of many parts are written anew with them."""
        if self.buckets and table in BUCKET_KEYS:
            return self._write(table, Rewrite(self.read(table).unionByName(rows)))
        parts = self.manifest().parts.get(table, {})
        many = tuple(p for p, paths in parts.items() if len(paths) >= MOST_PARTS)
        many = tuple(p for p in self.touched(table, rows) if p in many) if many else ()
        return self._write(table, Rewrite(rows.unionByName(self.read(table, many)) if many else rows, many))

    def stage(self, changes: dict[str, Change]) -> dict[str, Staged]:
        """Write changes to new folders, not yet visible. A table on its own replaces what there is."""
        staged = {}
        for table, change in changes.items():
            if isinstance(change, Append):
                staged[table] = self._added(table, change.rows)
            else:
                staged[table] = self._write(table, change if isinstance(change, Rewrite) else Rewrite(change))
        return staged

    def publish(self, staged: dict[str, Staged], stream: str = "", batch_id: int = -1, tallies: dict[str, int] | None = None,
                counters: dict[str, int] | None = None) -> int:
        """Make staged changes the current state, all at once, raise ``counters`` to the numbers given and set ``tallies``."""
        old = self.manifest()
        parts = {table: dict(pieces) for table, pieces in old.parts.items()}
        buckets, highest, batches = dict(old.buckets), dict(old.counters), dict(old.batches)
        for table, new in staged.items():
            kept = {} if new.replaced is None else {p: paths for p, paths in parts.get(table, {}).items() if p not in new.replaced}
            parts[table] = kept | {p: (*kept.get(p, ()), path) for p, path in new.folders.items()}
            buckets[table] = new.buckets
        for name, n in [(name, n) for given in (counters or {}, *(new.counters for new in staged.values())) for name, n in given.items()]:
            highest[name] = max(n, highest.get(name, n))
        if stream:
            batches[stream] = max(batch_id, batches.get(stream, batch_id))
        new = Manifest((old.version or 0) + 1, parts, buckets, highest, batches, {**old.tallies, **(tallies or {})})
        entries = self.spark.createDataFrame(new.entries(), _ENTRY).coalesce(1)
        entries.write.mode("overwrite").json(f"{self.root}/published/version={new.version}")
        self._known = new
        return new.version

    def commit(self, changes: dict[str, Change], stream: str = "", batch_id: int = -1, tallies: dict[str, int] | None = None,
               counters: dict[str, int] | None = None) -> int:
        return self.publish(self.stage(changes), stream, batch_id, tallies, counters)
