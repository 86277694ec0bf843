"""Ids, repeated ids and clashing columns through all operators of documents; workers without the package."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pillflow.llm import packing
from pillflow.llm.common import unused
from pillflow.llm.queries import QUERIES

BIG = 1 << 60
CLASHING = ["_id", "_tid", "_kept", "_found", "_toxicity", "_language", "_share", "_key", "_row", "_item", "_group", "identifiers", "score"]
OF_DOCUMENTS = [n for n in QUERIES if n not in ("op6_kd_trees", "op9_collision_lines", "op11_son_phrases", "op12_jacobi_davidson")]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    say = lambda n: " ".join("".join(rng.choice(list("abcdeilmnorst"), rng.integers(2, 8))) for _ in range(n))
    ids = [None, BIG + 1, BIG + 3, BIG + 5, None, BIG + 7, 7, 7, 8, 9]
    out = [(i, say(30 + 9 * k), "en" if k % 2 else "de", None, 0, *[f"mine{k}"] * len(CLASHING)) for k, i in enumerate(ids)]
    return [*out, out[1], (10, out[1][1], "en", "s", 0, *["mine"] * len(CLASHING))]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("keys"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/documents.parquet")
    labels = [(7, 1, 1), (8, 1, 0), (9, 0, 0), (BIG + 1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_ids_come_back(spark, folder, rows, name):
    found = QUERIES[name](spark, folder).select("doc_id").collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)


def test_stages_keep_clashing_columns(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r[1]: r[5:] for r in rows[:10]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        kept = after.collect()
        assert kept and all(tuple(r)[5:] == before.get(r.text, ("mine",)) or r.doc_id == 10 for r in kept), name
        expected = len(rows) - 2 if name == "near_duplicates" else len(rows)
        assert len(kept) == expected or name == "toxicity"
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in kept) == Counter(10 if r[0] == BIG + 1 else r[0] for r in rows[:10])


def test_unused_names():
    assert unused(["_ID", "a", "_id_"], "_id", "_id", "b") == ["_id__", "_id___", "b"]


@pytest.mark.parametrize("length,capacity", [(3, 4096), (2, 4096), (5, 4096), (4095, 4096), (1, 50), (4096, 4096)])
def test_many_equal_pieces_are_packed(spark, length, capacity):
    """Groups whose bins are few and none of them full; each level must shrink."""
    n = 100_000 if length < 50 else 3_000
    pieces = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(length).cast("long").alias("length"))
    found = packing.pack(pieces, capacity, per_group=max(500, n // 5))
    bins = found.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    figures = bins.agg(F.sum("n"), F.max("fill"), F.count("*"), F.count_if(F.col("fill") != F.col("end"))).first()
    assert figures[0] == n and figures[1] <= capacity and figures[3] == 0
    assert figures[2] == -(-n // (capacity // length))


def test_each_level_shrinks():
    rng = np.random.default_rng(2)
    for lengths in ([3] * 5000, [1] * 9, rng.integers(1, 4097, 3000).tolist(), [4096] * 30, [7]):
        bins = packing.pack_lengths(lengths, 4096)
        again = packing.opened_again(bins, lengths, 4096)
        assert len(again) <= len(lengths) / 2 and len(set(again)) == len(again)


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pillflow.session import build_session
from pillflow.llm.queries import QUERIES
spark = build_session("apart", **{{"spark.master": "local[2]", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
                                   "spark.checkpoint.dir": {scratch!r}}})
for name in {names!r}:
    assert QUERIES[name](spark, {folder!r}).count() > 0, name
print("done")
"""


def test_workers_need_no_package(folder, tmp_path):
    """The package is on the path of the driver alone. Operators that broadcast objects of its classes still need it."""
    repo = str(Path(corpus_pipeline.__file__).parent)
    names = ["op7_piece_bpe", "op8_swap_packing", "op13_offset_transducers"]
    script = SCRIPT.format(repo=repo, scratch=str(tmp_path / "scratch"), names=names, folder=folder)
    (tmp_path / "apart.py").write_text(script, encoding="utf-8")
    import os
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    env["PYTHONPATH"] = ":".join(p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != Path(repo))
    done = subprocess.run([sys.executable, str(tmp_path / "apart.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "done" in done.stdout, done.stderr[-3000:]
