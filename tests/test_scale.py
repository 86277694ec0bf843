"""Steps whose spill and shuffle would grow faster than the tables."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pillflow.operators import lookups as L
from pillflow.operators.carts import CartScans
from pillflow.operators.orders import Cancellation
from pillflow.operators.stockroom import Removal
from pillflow.schemas import TABLES
from pillflow.sources import snapshots
from pillflow.sources.snapshots import Snapshots
from pillflow.streaming import request_batches
from pillflow.testbed import mapping

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("table", ["lines", "requests"])
def test_order_lines_are_not_summed_up_before_their_shuffle(spark, monkeypatch, table):
    """Their key hardly repeats: a task that groups what it reads would hold as many groups as rows, and spill them."""
    monkeypatch.setattr(mapping, "_RANGE_ROWS", 1000)
    plan = mapping.Domain(spark, SMALL)._derived(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    grouped, read = plan.split("Exchange rangepartitioning")
    assert "Aggregate" in grouped
    assert "Aggregate" not in read


def sides_of_first_join(df):
    """The columns that go into the topmost join from either side, after pruning."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    return [[out.apply(i).name() for i in range(out.size())] for out in (plan.left().output(), plan.right().output())]


def test_a_key_goes_through_a_hot_join_once(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (None, "b", "z")], "n long, t string, v string")
    right = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "n long, t string, w int")
    joined = L.hot_join(left, right, ["n", "t"])
    assert joined.columns == ["n", "t", "v", "w"]
    assert sorted(map(tuple, joined.collect()), key=str) == [(1, "a", "x", 7), (2, None, "y", None), (None, "b", "z", None)]
    assert sorted(sides_of_first_join(joined)[0]) == ["_k0", "_k1", "v"]


def test_requests_keep_their_text_whatever_their_key(spark):
    requests = spark.createDataFrame([(1, "12345678"), (2, "bad"), (None, "worse"), (3, None), (None, "12345678"), (4, "")], "seq long, barcode string")
    facts = spark.createDataFrame([("12345678", 9)], "barcode string, f int")
    judged = L.with_facts(requests, facts, ["barcode"], F.col("barcode") == "12345678")
    assert sorted(map(tuple, judged.select("seq", "barcode", "f").collect()), key=str) == sorted(
        [(1, "12345678", 9), (2, "bad", None), (None, "worse", None), (3, None, None), (None, "12345678", 9), (4, "", None)], key=str)


def test_goods_that_are_not_there_are_no_facts(spark):
    """Only what is in stock is joined to the requests; the rest would be shuffled twice to say nothing."""
    stock = spark.createDataFrame([], TABLES["stock"])
    requests = spark.createDataFrame([(1, 1, 1, "12345678")], "seq long, cart_id long, line_no long, barcode string")
    for outcomes in (Removal(stock, requests).outcomes, CartScans(stock, requests, "2000-01-01").outcomes):
        assert outcomes._jdf.queryExecution().analyzed().toString().count("LeftOuter") == 1
        assert [r.code for r in outcomes.collect()] in (["NOT_FOUND"], ["NOT_IN_DISPENSER"])


def test_cancellation_judges_once(spark):
    """What outcomes, stock and orders are built on is kept, not made anew for each."""
    stock = spark.createDataFrame([], TABLES["stock"])
    orders = spark.createDataFrame([], TABLES["orders"])
    asked = spark.createDataFrame([(1, 100000, "1")], "seq long, bestellgruppe_id long, kundennummer string")
    result = Cancellation(stock, orders, asked, "2000-01-01")
    assert result._verdicts._jdf.queryExecution().optimizedPlan().nodeName() == "LogicalRDD"


def test_outcomes_of_a_stream_are_judged_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"), pieces=2)
    store.create_if_absent()
    asked = spark.createDataFrame([(1, 100000, "1")], "seq long, bestellgruppe_id long, kundennummer string")
    lines = spark.createDataFrame([(1, 1, "12345678", "K")], "cart_id long, line_no long, barcode string, kundennummer string")
    for operation, requests in ((request_batches.cancellation("2000-01-01"), asked), (request_batches.checkout("2000-01-01 08:30:00"), lines)):
        outcomes = operation(store, requests).outcomes
        assert outcomes._jdf.queryExecution().optimizedPlan().nodeName() == "LogicalRDD"


@pytest.mark.parametrize(("small", "expected"), [(0, 3), (1_000_000, 1)])
def test_a_large_table_is_published_without_moving_it(spark, tmp_path, monkeypatch, small, expected):
    """Each task writes its own rows of a piece; a shuffle by piece would bring them into one file, as is done with small pieces."""
    monkeypatch.setattr(snapshots, "SMALL", small)
    store = Snapshots(spark, str(tmp_path / "store"), pieces=1)
    barcode = (F.col("id") + 10000000).cast("string").alias("barcode")
    store.commit({"stock": spark.range(0, 30, 1, 3).select(barcode, *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["stock"].fields if f.name != "barcode"])})
    files = list(Path(tmp_path / "store" / "data" / "stock").rglob("*.parquet"))
    assert len(files) == expected
    assert store.read("stock").count() == 30
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in files]
    assert all(c.compression == "ZSTD" for c in columns)


def test_outcomes_that_nothing_else_needs_are_written_once(spark, tmp_path):
    """They are counted and logged from the folder they are written to, not kept beside it."""
    store = Snapshots(spark, str(tmp_path / "store"), pieces=2)
    store.create_if_absent()
    requests = spark.createDataFrame([(1, "12345678")], "seq long, barcode string")
    step = request_batches.removal()(store, requests)
    assert step.outcomes._jdf.queryExecution().optimizedPlan().nodeName() != "LogicalRDD"
    stream = request_batches.RequestStream("removal", store, request_batches.removal(), str(tmp_path / "out"), str(tmp_path / "log"), "2000-01-01 08:30:00")
    stream.apply(requests, 0)
    assert store.counters() == {}
    assert store.tallies() == {"judged by removal": 1, "accepted by removal": 0}
