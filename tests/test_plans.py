"""What the plans must look like for the operators to hold up on large tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pillflow import schemas as S
from pillflow.operators.carts import CartScans
from pillflow.operators.dispenser import Fill, Return
from pillflow.operators.expiry import refresh_warnings
from pillflow.operators.orders import Cancellation, set_order_status
from pillflow.operators.stockroom import Intake, Removal
from pillflow.plans import log_views, order_views, stock_views
from pillflow.sources.snapshots import Snapshots
from pillflow.testbed.mapping import Domain

TODAY = dt.date(2000, 1, 1)
SMALL = "/root/testdata/sf0.001"

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def skew_sensitive(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    domain = Domain(spark, SMALL)
    listed = plan(stock_views.stock_list(domain.stock, location="Automat", channel="Kanal 3"))
    assert "EqualTo(ort,Automat)" in listed and "EqualTo(kanal,Kanal 3)" in listed
    totals = plan(stock_views.article_totals(domain.stock))
    assert "ReadSchema: struct<name:string,menge:int>" in totals
    overview = plan(order_views.customer_orders(domain.bestellungen, "10000042"))
    assert "EqualTo(kundennummer,10000042)" in overview and "EqualTo(status,Offen)" in overview
    review = plan(log_views.log_review(domain.action_log.withColumn("ts", F.col("zeitstempel").try_cast("timestamp_ntz")), "2024-01-15"))
    assert "StringStartsWith(zeitstempel,2024-01-15)" in review
    assert "TakeOrderedAndProject" in plan(stock_views.random_stock_row(domain.stock, 1))
    labels = plan(order_views.order_labels(domain.bestellungen, "10000042"))
    assert "EqualTo(status,Offen)" in labels


def test_each_side_is_shuffled_once(spark, skew_sensitive):
    """Facts share one partitioning by barcode: one shuffle for each table, then one for either side of the last join."""
    domain = Domain(spark, SMALL)
    intake = Intake(domain.stock, domain.bestellungen, domain.intake_req, TODAY)
    assert plan(intake.outcomes).count("Exchange hashpartitioning") == 5
    assert plan(intake.stock).count("Exchange hashpartitioning") == 3
    assert plan(refresh_warnings(domain.warnungen, domain.stock, TODAY)).count("Exchange hashpartitioning") == 2
    removal = Removal(domain.stock, domain.barcode_req)
    assert plan(removal.stock).count("Exchange hashpartitioning") == 2


def test_stock_in_buckets_is_not_shuffled(spark, skew_sensitive, tmp_path):
    domain = Domain(spark, SMALL)
    store = Snapshots(spark, str(tmp_path / "store"), buckets=8)
    store.commit({"stock": domain.stock, "orders": domain.bestellungen, "warnings": domain.warnungen})
    stock = store.read("stock")
    removal = Removal(stock, domain.barcode_req)
    assert plan(removal.stock).count("Exchange") == 1
    assert plan(refresh_warnings(store.read("warnings"), stock, TODAY)).count("Exchange") == 0
    assert plan(Intake(stock, store.read("orders"), domain.intake_req, TODAY).stock).count("Exchange") == 2
    assert removal.stock.count() == Removal(domain.stock, domain.barcode_req).stock.count()


HOT = 30000


def hot_requests(spark):
    """A third of the requests scan one barcode."""
    hot = F.when(F.col("id") % 3 == 0, "10000001").otherwise((F.col("id") + 10000000).cast("string"))
    return spark.range(HOT).select(F.col("id").alias("seq"), hot.alias("barcode")).repartition(16)


def hot_stock(spark, place):
    return spark.range(10000000, 10003000).select(
        F.col("id").cast("string").alias("barcode"), F.lit("a").alias("name"), F.lit(1).alias("menge"),
        F.lit(dt.date(2001, 1, 1)).alias("verfallsdatum"), F.lit(place).alias("ort"), F.lit("Kanal 1").alias("kanal"))


def split(df):
    """Runs the query and tells whether a skewed partition was split; also returns the rows per code."""
    rows = df.collect()
    return "skew=true" in plan(df), rows


def test_hot_barcode_is_split(spark, skew_sensitive):
    requests = hot_requests(spark)
    stock, inside = hot_stock(spark, "Lager"), hot_stock(spark, "Automat")
    orders = spark.createDataFrame([], S.ORDERS)
    goods = requests.withColumns({"name": F.lit("a"), "verfallsdatum_raw": F.lit("2001-01-01"), "ort": F.lit("Lager")})
    scans = requests.select(F.lit(1).cast("long").alias("cart_id"), F.col("seq").alias("line_no"), "barcode")
    for outcomes, accepted in [
        (Intake(stock.where("false"), orders, goods, TODAY).outcomes, 1 + HOT * 2 // 3 - 1),
        (Removal(stock, requests).outcomes, 1 + 2000 - 1),
        (Return(inside, requests).outcomes, 1 + 2000 - 1),
        (Fill(stock, requests, TODAY).outcomes, HOT // 3 + 2000 - 1),
    ]:
        was_split, rows = split(outcomes)
        assert was_split
        assert len(rows) == HOT
        assert abs(sum(r.code == "OK" for r in rows) - accepted) <= 1
    was_split, rows = split(CartScans(inside, scans, TODAY).outcomes)
    assert was_split
    assert sum(r.code == "OK" for r in rows) == 1 + 2000 - 1 and len(rows) == HOT


def test_bad_scans_do_not_pile_up(spark, skew_sensitive):
    """Requests that fail their own checks are spread over all partitions."""
    requests = spark.range(HOT).select(F.col("id").alias("seq"), F.lit(None).cast("string").alias("barcode")).repartition(16)
    outcomes = Removal(hot_stock(spark, "Lager"), requests).outcomes
    was_split, rows = split(outcomes)
    assert not was_split and {r.code for r in rows} == {"BAD_BARCODE"}
    sizes = outcomes.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < HOT / 2 and sizes[1] > 2


def test_hot_order_is_split(spark, skew_sensitive):
    group = F.when(F.col("id") % 3 == 0, F.lit(100001)).otherwise(F.col("id") + 200000).cast("long")
    orders = spark.range(HOT).select(
        "id", group.alias("bestellgruppe_id"), F.lit("K").alias("kundennummer"), F.col("id").cast("string").alias("barcode"),
        F.lit("a").alias("name"), F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz").alias("bestelldatum"), F.lit("Offen").alias("status"),
    ).repartition(16)
    status = spark.createDataFrame([(1, 100001, "Genehmigt"), (2, 200002, "Storniert")], S.STATUS_REQUESTS)
    was_split, rows = split(set_order_status(orders, status))
    assert was_split and sum(r.status == "Genehmigt" for r in rows) == HOT // 3
    requests = spark.createDataFrame([(1, 100001, "K")], S.CANCEL_REQUESTS)
    result = Cancellation(spark.createDataFrame([], S.STOCK), orders, requests, TODAY)
    was_split, rows = split(result.orders)
    assert was_split and sum(r.status == "Storniert" for r in rows) == HOT // 3
    assert result.stock.count() == HOT // 3
