"""Queries on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pillflow import schemas as S
from pillflow.operators import audit, expiry
from pillflow.operators.carts import CartScans, Checkout
from pillflow.operators.dispenser import Fill
from pillflow.operators.ranking import free_numbers, rank_rows
from pillflow.operators.stockroom import Intake
from pillflow.plans import log_views, order_views, quality, stock_views
from pillflow.sources import action_log, tables
from pillflow.sources.snapshots import Append, Rewrite, Snapshots
from pillflow.streaming import log_ingest, request_batches, running_figures

TODAY = dt.date(2000, 1, 1)
LATER = dt.date(2001, 1, 1)
NOON = dt.datetime(2000, 1, 1, 12)
NOW_OR_LATER = [NOON, NOON + dt.timedelta(hours=1)]


def stock_of(spark, *rows):
    return spark.createDataFrame([(b, n, 1, LATER, "Automat" if k else "Lager", k) for b, n, k in rows], S.STOCK)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ranks_are_those_of_a_sort(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("x"), F.lit("hot").alias("k")).repartition(7)
    ranked = rank_rows(df, "k", "x").orderBy("rang").collect()
    assert [r.rang for r in ranked] == list(range(1, 5001))
    assert [r.x for r in ranked] == sorted(r.x for r in ranked)
    assert not rank_rows(df.where("false"), "x").collect()


def test_free_numbers(spark):
    taken = spark.createDataFrame([(1,), (2,), (4,), (4,), (90,), (-3,)], "n long")
    assert values(free_numbers(taken, 4)) == [(1, 3), (2, 5), (3, 6), (4, 7)]
    assert values(free_numbers(taken, 0)) == []


def test_names_of_large_orders(spark):
    """An order spread over many slices is still one row, its names in order."""
    lines = [(i, 1 if i % 3 else None, "K", f"{(i * 7919) % 5000:08d}", f"n{(i * 7919) % 5000}", NOW_OR_LATER[i % 2], "Offen") for i in range(5000)]
    lines += [(10000, 2, "K", "1", None, NOON, "Offen"), (10001, 3, "K", "2", "solo", NOON, "Offen"), (10002, 3, "K", "3", "", NOON, "Genehmigt")]
    orders = spark.createDataFrame(lines, S.ORDERS).repartition(5)
    shown = {r["Bestell-ID"]: r for r in order_views.order_overview(orders).collect()}
    assert len(shown) == 4
    for group in (1, None):
        own = sorted(line[3:5] for line in lines if line[1] == group)
        assert shown[group]["Medikamente"] == ", ".join(name for _, name in own)
        assert shown[group]["Bestelldatum"] == NOON
    assert shown[2]["Medikamente"] is None and shown[3]["Medikamente"] == "solo, "
    sliced = order_views.order_overview(orders)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(bestellgruppe_id" in sliced


def test_totals_keep_goods_without_name(spark):
    stock = stock_of(spark, ("1", None, None), ("2", None, None), ("3", "a", None))
    assert values(stock_views.article_totals(stock)) == [("a", 1), (None, 2)]


def test_rates(spark):
    empty = spark.createDataFrame([], S.STOCK)
    assert values(quality.faulty_rate(empty)) == [(0, None, 0.0)]
    outcomes = spark.createDataFrame([("OK",), ("OK",), ("EXPIRED",), ("OK",)], "code string")
    assert values(quality.outcome_rates(outcomes.withColumn("vorgang", F.lit("fill")))) == [("fill", 4, 75.0, 25.0)]
    assert values(quality.repeated_keys(stock_of(spark, ("1", "a", None), ("1", "b", None)), "barcode")) == [("1", 2)]


def failures(spark, *hours):
    rows = [(str(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)), "K", "Timeout") for h in hours]
    return action_log.with_moments(spark.createDataFrame(rows + [("kaputt", "K", "Timeout"), ("2024-01-01 00:30:00", "K", "ok")], S.ACTION_LOG))


def test_time_between_failures(spark):
    assert values(log_views.mean_time_between_failures(failures(spark, 0, 1, 5, 9))) == [(4, 3.0)]
    assert values(log_views.mean_time_between_failures(failures(spark, 3))) == [(1, None)]
    assert values(log_views.mean_time_between_failures(failures(spark))) == [(0, None)]


def test_gaps(spark):
    hours = [0, 0, 2, 30, 31, 400]
    gaps = log_views.failure_gaps(failures(spark, *hours)).orderBy("ts").collect()
    assert sorted((r.abstand_stunden for r in gaps), key=lambda x: (x is not None, x)) == [None, 0.0, 1.0, 2.0, 28.0, 369.0]


def test_nameless_goods_take_channels_of_their_own(spark):
    stock = stock_of(spark, ("10000001", None, None), ("10000002", None, None), ("10000003", "a", "Kanal 1"),
                     ("10000004", "b", ""), ("10000005", "b", None))
    stock = stock.withColumn("ort", F.when(F.col("barcode") == "10000004", "Automat").otherwise(F.col("ort")))
    requests = spark.createDataFrame([(1, "10000002"), (2, "10000001"), (3, "10000005"), (4, "10000002")], S.BARCODE_REQUESTS)
    result = Fill(stock, requests, TODAY)
    assert values(result.outcomes.select("seq", "code", "detail")) == [
        (1, "OK", "Kanal 2"), (2, "OK", "Kanal 3"), (3, "OK", "Kanal 4"), (4, "OK", "Kanal 2")]


def test_log_is_read_as_it_was_written(spark, tmp_path):
    path = str(tmp_path / "log")
    assert values(action_log.read_log(spark, path)) == []
    rows = [("2024-01-01 10:00:00", "K1", 'sagt "Hallo", geht'), ("2024-01-01 10:00:01", None, "a\\b"), ("x", "K", "zwei\nZeilen"),
            ("y", " K ", "  a  b "), ("z", "", ""), ("z", "K", '"')]
    action_log.append_log(spark.createDataFrame(rows[:2], S.ACTION_LOG), path)
    action_log.append_log(spark.createDataFrame(rows[2:], S.ACTION_LOG), path)
    assert values(action_log.read_log(spark, path)) == sorted(
        [rows[0], ("2024-01-01 10:00:01", "Unbekannt", "a\\b"), ("x", "K", "zwei Zeilen"), *rows[3:]], key=repr)
    assert action_log.with_moments(action_log.read_log(spark, path)).count() == 2
    plain = tmp_path / "plain.csv"
    plain.write_text('2024-01-01 10:00:00,K1,"sagt ""Hallo"", geht"\n', encoding="utf-8")
    assert values(action_log.read_log(spark, str(plain))) == [rows[0]]
    empty = tmp_path / "empty.csv"
    empty.touch()
    assert values(action_log.read_log(spark, str(empty))) == []


def test_defaults(spark, tmp_path):
    path = str(tmp_path / "stock")
    tables.write_table(spark.createDataFrame([("1", "a", 1, LATER, None, None)], S.STOCK), "stock", path)
    assert values(tables.read_table(spark, "stock", path).select("ort")) == [("Lager",)]
    assert tables.read_table(spark, "stock", path).schema == S.STOCK


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.version() is None
    store.create_if_absent()
    store.create_if_absent()
    assert store.version() == 1 and store.read("stock").isEmpty()
    store.commit({"stock": stock_of(spark, ("1", "a", None))})
    store.commit({"stock": store.read("stock").union(stock_of(spark, ("2", "b", None)))})
    store.stage({"stock": stock_of(spark)})
    assert store.version() == 3 and store.read("stock").count() == 2 and store.read("orders").isEmpty()


def test_requests_stream_into_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    store.create_if_absent()
    source = str(tmp_path / "requests")
    stream = request_batches.RequestStream("intake", store, request_batches.intake(TODAY), str(tmp_path / "outcomes"))
    for i in range(3):
        rows = [(10 * i + k, f"1000000{k + i}", "a", "2001-01-01", None) for k in range(2)]
        spark.createDataFrame(rows, S.INTAKE_REQUESTS).coalesce(1).write.mode("append").parquet(source)
    incoming = spark.readStream.schema(S.INTAKE_REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
    stream.start(incoming, str(tmp_path / "state")).awaitTermination()
    assert values(store.read("stock").select("barcode")) == [(f"1000000{k}",) for k in range(4)]
    outcomes = spark.read.parquet(str(tmp_path / "outcomes"))
    assert values(outcomes.groupBy("code").count()) == [("IN_STOCK", 2), ("OK", 4)]
    before = store.version()
    stream.apply(spark.createDataFrame([(99, "10000099", "a", "2001-01-01", None)], S.INTAKE_REQUESTS), 2)
    assert store.version() == before


def test_log_streams_into_days(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("csv", "days", "state"))
    rows = [(f"2024-01-0{1 + i % 3} 10:00:0{i}", "K", f"a{i}") for i in range(6)] + [("kaputt", "K", "b")]
    for half in (rows[:4], rows[4:]):
        action_log.append_log(spark.createDataFrame(half, S.ACTION_LOG), source)
        log_ingest.ingest_log(action_log.stream_log(spark, source), target, state).awaitTermination()
    stored = log_ingest.read_ingested(spark, target)
    assert stored.count() == 6
    one_day = log_views.log_review_stored(stored, "2024-01-02")
    assert values(one_day.select("Aktion")) == [("a1",), ("a4",)]
    assert "PartitionFilters: [isnotnull(tag" in one_day._jdf.queryExecution().toString()


@pytest.fixture
def chain(spark):
    requests = [(i, f"900000{i:03d}", f"TestMedikament{i}", "2001-01-01", "Lager") for i in range(100)]
    intake = Intake(spark.createDataFrame([], S.STOCK), spark.createDataFrame([], S.ORDERS),
                    spark.createDataFrame(requests, S.INTAKE_REQUESTS), TODAY)
    barcodes = spark.createDataFrame([(r[0], r[1]) for r in requests], S.BARCODE_REQUESTS)
    fill = Fill(intake.stock, barcodes, TODAY)
    scans = CartScans(fill.stock, barcodes.select(F.col("seq").alias("cart_id"), F.lit(1).cast("long").alias("line_no"), "barcode"), TODAY)
    carts = barcodes.select(F.col("seq").alias("cart_id"), F.lit("99999999").alias("kundennummer"))
    return Checkout(fill.stock, intake.orders, carts, scans.cart_lines.select("cart_id", "line_no", "barcode"), NOON)


def test_from_intake_to_order(spark, chain):
    """A hundred goods are taken in, put into the dispenser, scanned and ordered; none is left in stock."""
    assert chain.stock.isEmpty()
    orders = chain.orders.orderBy("id").collect()
    assert [o.id for o in orders] == list(range(1, 101))
    assert [o.bestellgruppe_id for o in orders] == list(range(100000, 100100))
    log = values(audit.checkout_log(chain, "2000-01-01 12:00:00"))
    assert len(log) == 100
    assert log[0] == ("2000-01-01 12:00:00", "99999999", "📦 Bestellung 100000 aufgegeben mit Medikamenten: TestMedikament0")


def test_answers(spark):
    outcomes = spark.createDataFrame([("1", "IN_STOCK", "a"), ("2", "OK", "b")], "barcode string, code string, detail string")
    assert values(audit.answers("intake", outcomes).select("antwort")) == [
        ("✅ Erfolg: b hinzugefügt.",), ("🚫 Fehler: Barcode 1 existiert bereits im Lager!",)]
    assert audit.audit_log("intake", outcomes, NOON).count() == 1


def test_one_random_row(spark):
    stock = stock_of(spark, *[(str(i), "a", None) for i in range(50)])
    assert len({stock_views.random_stock_row(stock, seed).first().barcode for seed in range(10)}) > 1


def test_extension(spark):
    """A new view is a function on tables."""
    stock = stock_of(spark, ("1", "a", None), ("2", "b", None))
    assert stock.transform(lambda df: df.where("name = 'a'")).transform(stock_views.article_totals).count() == 1




def test_all_operations_on_snapshots(spark, tmp_path):
    """A day at the counter, each step a micro-batch."""
    store = Snapshots(spark, str(tmp_path / "store"), buckets=2)
    store.create_if_absent()
    barcodes = [f"1000000{i}" for i in range(6)]
    seq = spark.createDataFrame(list(enumerate(barcodes)), S.BARCODE_REQUESTS)
    cart = [(1, 1, barcodes[0], "K"), (1, 2, barcodes[1], "K"), (2, 1, barcodes[1], "K"), (3, None, None, "")]
    steps = [
        (request_batches.intake(TODAY), spark.createDataFrame([(i, b, "a", "2001-01-01", None) for i, b in enumerate(barcodes)], S.INTAKE_REQUESTS)),
        (request_batches.fill(TODAY), seq.where("seq < 4")),
        (request_batches.give_back(), seq.where("seq = 3")),
        (request_batches.removal(), seq.where("seq = 5")),
        (request_batches.checkout(NOON), spark.createDataFrame(cart, "cart_id long, line_no long, barcode string, kundennummer string")),
        (request_batches.status_change(), spark.createDataFrame([(1, 100001, "Genehmigt")], S.STATUS_REQUESTS)),
        (request_batches.cancellation(TODAY), spark.createDataFrame([(1, 100000, "K")], S.CANCEL_REQUESTS)),
    ]
    for i, (operation, requests) in enumerate(steps):
        stream = request_batches.RequestStream(f"step {i}", store, operation, str(tmp_path / f"outcomes{i}"))
        stream.apply(requests, 0)
    assert values(store.read("stock").select("barcode", "menge", "ort", "kanal")) == [
        (barcodes[0], 1, "Lager", None), (barcodes[1], 1, "Lager", None), (barcodes[2], 1, "Automat", "Kanal 1"),
        (barcodes[3], 1, "Lager", None), (barcodes[4], 1, "Lager", None)]
    assert values(store.read("orders").select("bestellgruppe_id", "status").distinct()) == [(100000, "Storniert")]
    checkout = spark.read.parquet(str(tmp_path / "outcomes4"))
    assert values(checkout.select("cart_id", "code", "detail")) == [
        (1, "OK", "100000"), (2, "LINE_UNAVAILABLE", barcodes[1]), (3, "NO_CUSTOMER", None)]


def files_of(df):
    return {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def test_a_small_batch_rewrites_its_pieces_only(spark, tmp_path):
    """Ten barcodes of thousands: few files are read, few are written, all others stay in place."""
    store = Snapshots(spark, str(tmp_path / "store"), pieces=64)
    stock = spark.range(5000).select(
        (F.col("id") + 10000000).cast("string").alias("barcode"), F.lit("a").alias("name"), F.lit(1).alias("menge"),
        F.lit(LATER).alias("verfallsdatum"), F.lit("Lager").alias("ort"), F.lit(None).cast("string").alias("kanal"))
    store.commit({"stock": stock})
    before = store.manifest().parts["stock"]
    assert len(before) == 64 and all(len(paths) == 1 for paths in before.values())
    gone = [str(10000000 + 37 * i) for i in range(10)]
    requests = spark.createDataFrame(list(enumerate(gone)), S.BARCODE_REQUESTS)
    near, pieces = store.near("stock", requests)
    assert 1 < len(pieces) <= 10 and len(near.inputFiles()) == len(pieces)
    stream = request_batches.RequestStream("removal", store, request_batches.removal(), str(tmp_path / "outcomes"))
    stream.apply(requests, 0)
    after = store.manifest().parts["stock"]
    assert {p for p in before if before[p] != after.get(p)} == set(pieces)
    assert {f for f in files_of(store.read("stock"))} >= {f for f in files_of(store.read("stock", set(before) - set(pieces)))}
    left = {r.barcode for r in store.read("stock").collect()}
    assert left == {str(10000000 + i) for i in range(5000)} - set(gone)


def test_added_rows_lie_beside_the_old_ones(spark, tmp_path):
    """Additions write no old rows again, until a piece has many parts."""
    store = Snapshots(spark, str(tmp_path / "store"), pieces=1)
    store.create_if_absent()
    most = []
    for i in range(12):
        store.commit({"stock": Append(stock_of(spark, (str(10000000 + i), "a", None)))})
        most.append(len(store.manifest().parts["stock"][0]))
    assert most == [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4]
    assert values(store.read("stock").select("barcode")) == [(str(10000000 + i),) for i in range(12)]


def test_a_writer_that_died_leaves_no_trace(spark, tmp_path):
    root = tmp_path / "store"
    store = Snapshots(spark, str(root))
    store.commit({"stock": stock_of(spark, ("1", "a", None))})
    (root / "published" / "version=2").mkdir()
    assert store.version() == 1 and Snapshots(spark, str(root)).read("stock").count() == 1
    assert store.commit({"stock": stock_of(spark)}) == 2 and store.read("stock").isEmpty()
    emptied = store.manifest()
    assert emptied.parts["stock"] == {} and Snapshots(spark, str(root)).manifest().entries() == emptied.entries()


def test_a_reader_stays_with_its_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    store.commit({"stock": stock_of(spark, ("1", "a", None))})
    old = store.read("stock")
    store.commit({"stock": stock_of(spark, ("2", "b", None), (None, "c", None))})
    assert values(old.select("barcode")) == [("1",)] and values(store.read("stock").select("barcode")) == [("2",), (None,)]


def test_numbers_are_never_given_twice(spark, tmp_path):
    """A user who never ordered is removed; after a restart the next one gets a new number and id."""
    root = str(tmp_path / "store")

    def apply(name, operation, rows, schema, batch=0):
        store = Snapshots(spark, root)
        store.create_if_absent()
        request_batches.RequestStream(name, store, operation, str(tmp_path / name)).apply(spark.createDataFrame(rows, schema), batch)
        return {r.username: (r.id, r.kundennummer, r.role) for r in store.read("users").collect()}

    ask = request_batches.registration
    first = apply("register", ask(), [(1, "a", None), (2, "b", None), (3, "a", None), (4, None, None)], S.USER_REQUESTS)
    assert first == {"a": (1, "10000000", "admin"), "b": (2, "10000001", "user")}
    assert apply("leave", request_batches.user_removal(), [("b",), ("nobody",)], "username string").keys() == {"a"}
    again = apply("register", ask(), [(5, "c", None), (6, "b", None)], S.USER_REQUESTS, 1)
    assert again == {"a": first["a"], "c": (3, "10000002", "user"), "b": (4, "10000003", "user")}
    assert apply("leave", request_batches.user_removal(), [("a",), ("b",), ("c",)], "username string", 1) == {}
    assert apply("register", ask(), [(7, "d", "user")], S.USER_REQUESTS, 2) == {"d": (5, "10000004", "admin")}
    codes = spark.read.parquet(str(tmp_path / "register")).groupBy("code").count()
    assert values(codes) == [("MISSING_FIELD", 1), ("OK", 5), ("TAKEN", 1)]


def test_order_numbers_go_on_from_the_manifest(spark, tmp_path):
    """Orders are added to the pieces of their group; none of the old ones is read for the next number."""
    store = Snapshots(spark, str(tmp_path / "store"), pieces=4)
    store.create_if_absent()
    schema = "cart_id long, line_no long, barcode string, kundennummer string"
    for batch in range(2):
        goods = [str(10000000 + 10 * batch + i) for i in range(3)]
        store.commit({"stock": Append(stock_of(spark, *[(b, "a", "Kanal 1") for b in goods]))})
        lines = [(10 * batch + i, 1, b, "K") for i, b in enumerate(goods)]
        request_batches.RequestStream("checkout", store, request_batches.checkout(NOON), str(tmp_path / "out")).apply(
            spark.createDataFrame(lines, schema), batch)
    assert values(store.read("orders").select("id", "bestellgruppe_id")) == [(i + 1, 100000 + i) for i in range(6)]
    assert store.counters() == {"order_id": 6, "order_group": 100005}
    assert store.read("stock").isEmpty()


def test_streams_write_the_action_log(spark, tmp_path):
    """Entries of all micro-batches, each once though one is handed over again before it was published."""
    store = Snapshots(spark, str(tmp_path / "store"))
    store.create_if_absent()
    log = str(tmp_path / "log")
    stream = request_batches.RequestStream("intake", store, request_batches.intake(TODAY), str(tmp_path / "outcomes"), log, NOON)
    for batch in range(2):
        rows = [(k, f"1000000{k + batch}", "a", "2001-01-01", None) for k in range(2)]
        requests = spark.createDataFrame(rows, S.INTAKE_REQUESTS)
        publish, store.commit = store.commit, lambda *a: None  # dies before it publishes
        stream.apply(requests, batch)
        store.commit = publish
        stream.apply(requests, batch)
    entries = values(action_log.read_log(spark, log))
    assert entries == [("2000-01-01 12:00:00", "Unbekannt", f"📦 Medikament hinzugefügt: a (Barcode: 1000000{k})") for k in range(3)]
    streamed = action_log.stream_log(spark, log)
    log_ingest.ingest_log(streamed, str(tmp_path / "days"), str(tmp_path / "state")).awaitTermination()
    assert log_ingest.read_ingested(spark, str(tmp_path / "days")).count() == 3


def test_days_are_compacted(spark, tmp_path):
    """Many micro-batches, one folder a day; what came since, a late entry and a replayed micro-batch are seen."""
    source, target, state = (str(tmp_path / n) for n in ("csv", "days", "state"))
    rows = [(f"2024-01-0{1 + i % 3} 10:00:0{i % 10}", "K", f"a{i}") for i in range(12)]
    for i, row in enumerate(rows):
        action_log.append_log(spark.createDataFrame([row, rows[0]], S.ACTION_LOG), source)
        log_ingest.ingest_log(action_log.stream_log(spark, source), target, state).awaitTermination()
        if i in (4, 7, 11):
            log_ingest.compact_days(spark, target)
    now = log_ingest.compacted(spark, target)
    assert now.upto == 10 and sorted(f.rsplit("/", 1)[1] for f in now.folders) == [f"tag=2024-01-0{d}" for d in (1, 2, 3)]
    stored = log_ingest.read_ingested(spark, target)
    assert values(stored.select("aktion")) == sorted([(f"a{i}",) for i in range(12)] + [("a0",)] * 12, key=repr)
    # The last micro-batch is handed over again.
    last = log_ingest.by_day(action_log.read_log(spark, source)).where("aktion = 'a11'")
    last.write.mode("overwrite").partitionBy("tag").parquet(f"{target}/batches/batch=11")
    assert log_ingest.read_ingested(spark, target).where("aktion = 'a11'").count() == 1
    log_ingest.compact_days(spark, target, whole=True)
    log_ingest.drop_merged(spark, target)
    after = log_ingest.read_ingested(spark, target)
    assert after.count() == 23 and len(after.inputFiles()) == 3
    day = log_views.log_review_stored(after, "2024-01-02")
    assert day.count() == 4
    assert "PartitionFilters: [isnotnull(tag" in day._jdf.queryExecution().toString()
    assert log_ingest.compact_days(spark, target).upto == 11 and log_ingest.read_ingested(spark, target).count() == 23


def test_log_without_entries(spark, tmp_path):
    assert log_ingest.read_ingested(spark, str(tmp_path / "none")).isEmpty()
    assert log_ingest.compact_days(spark, str(tmp_path / "none")).version == 0


def test_daily_refresh_equals_a_full_one(spark, tmp_path):
    """Thirty days, goods coming and going: the stored warnings are those of a full refresh on every day."""
    import random
    rng = random.Random(4)
    store = Snapshots(spark, str(tmp_path / "store"), pieces=16)
    good = lambda i: (str(10000000 + i), f"n{i}", 1, TODAY + dt.timedelta(days=rng.randrange(-20, 60)), rng.choice(["Lager", "Automat"]), None)
    stock = [good(i) for i in range(120)] + [("20000000", "x", 1, None, "Lager", None)]
    warnings = [(str(10000000 + 7 * i), "alt", LATER, "Lager", "Offen") for i in range(25)]
    full = spark.createDataFrame(warnings, S.WARNINGS)
    store.commit({"stock": spark.createDataFrame(stock, S.STOCK), "warnings": full})
    written = []
    for d in range(0, 30, 5):
        day = TODAY + dt.timedelta(days=d)
        if d % 10 == 5:
            store.commit({"stock": Append(spark.createDataFrame([good(200 + d)], S.STOCK))})
            gone = spark.createDataFrame([(stock[d][0],)], "barcode string")
            near, pieces = store.near("stock", gone)
            store.commit({"stock": Rewrite(near.join(gone, "barcode", "left_anti").select(*S.STOCK.names), pieces)})
        before = store.manifest().parts.get("warnings", {})
        expiry.refresh_stored(store, day)
        after = store.manifest().parts["warnings"]
        written.append(sum(before.get(p) != after.get(p) for p in {*before, *after}))
        full = expiry.refresh_warnings(full, store.read("stock"), day).checkpoint()
        assert values(store.read("warnings")) == values(full)
    assert max(written[1:]) < 16
    version = store.version()
    expiry.refresh_stored(store, TODAY)  # back in time: everything is looked at
    assert store.version() == version + 1
    scan = expiry.newly_expired(store.read("stock"), TODAY, LATER)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(verfallsdatum," in scan and "LessThan(verfallsdatum," in scan


def test_running_mean_time_equals_the_batch(spark, tmp_path):
    """After every micro-batch, restarts and late entries included; the old figures go after a while."""
    source, target, state = (str(tmp_path / n) for n in ("csv", "figures", "state"))
    assert values(running_figures.running_mean_time(spark, target)) == [(0, None)]
    times = ["2024-01-05 10:00:00", "2024-01-09 10:00:00", "2024-01-01 08:00:00", "kaputt"]
    for i, at in enumerate(times):
        rows = [(at, "K", "Systemfehler: ❌"), (at, "K", "alles gut"), ("2024-01-07 00:00:00", "K", f"App-Absturz {i}")]
        action_log.append_log(spark.createDataFrame(rows, S.ACTION_LOG), source)
        running_figures.follow_failures(action_log.stream_log(spark, source), target, state).awaitTermination()
        whole = log_views.mean_time_between_failures(action_log.with_moments(action_log.read_log(spark, source)))
        assert values(running_figures.running_mean_time(spark, target)) == values(whole)


def test_rates_are_published_with_the_tables(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    store.create_if_absent()
    assert request_batches.published_rates(store).isEmpty()
    stream = request_batches.RequestStream("intake", store, request_batches.intake(TODAY), str(tmp_path / "outcomes"))
    for batch, barcodes in enumerate([["10000000", "10000001"], ["10000001", "bad"], []]):
        rows = [(i, b, "a", "2001-01-01", None) for i, b in enumerate(barcodes)]
        requests = spark.createDataFrame(rows, S.INTAKE_REQUESTS)
        stream.apply(requests, batch)
        stream.apply(requests, batch)
    again = Snapshots(spark, str(tmp_path / "store"))
    assert values(request_batches.published_rates(again)) == [("intake", 4, 50.0, 50.0)]
