"""The eigenpairs against a dense solver, the query against brute force, exact figures against whole-number arithmetic."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from pillflow.llm import whitening
from pillflow.llm.queries import QUERIES

EMBEDDINGS = "vec_id long, embedding array<float>, x int, whitened string"


@pytest.mark.parametrize("width,wanted,n,kind", [
    (64, 32, 4000, "flat"), (64, 32, 20, "flat"), (200, 12, 3000, "decay"), (200, 32, 1000, "gap"), (10, 32, 300, "flat"),
    (40, 8, 0, "equal"), (1, 1, 30, "flat"), (150, 5, 6000, "flat")])
def test_pairs_equal_a_dense_solver(width, wanted, n, kind):
    rng = np.random.default_rng(width + n)
    x = np.floor(64 * rng.standard_normal((n, width)))
    if kind == "decay":
        x = np.floor(20 * x * np.exp(-np.arange(width) / 10))
    if kind == "gap":
        x[:, :3] *= 1000
    if kind == "equal":
        x = np.vstack([np.eye(width), -np.eye(width)]) * 64
    c = x - x.mean(axis=0)
    found = whitening.leading_pairs(lambda b: c.T @ (c @ b) / len(c), width, wanted)
    dense = c.T @ c / len(c)
    values = np.linalg.eigvalsh(dense)[::-1][:wanted]
    assert np.abs(found.values - values).max() <= 1e-13 * values[0]
    assert np.linalg.norm(dense @ found.vectors - found.vectors * found.values, axis=0).max() <= 1e-12 * values[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(found.values))).max() < 1e-13


def test_minres_solves():
    a = np.random.default_rng(0).standard_normal((30, 30))
    b = np.random.default_rng(1).standard_normal((30, 4))
    b[:, 3] = 0
    found = whitening._minres(lambda t: (a + a.T) @ t, b, 60)
    assert np.abs((a + a.T) @ found - b).max() < 1e-9


def brute(rows):
    """(n, sums, vectors by id) in whole numbers."""
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in used]
    return [i for i, _ in used], x, [sum(c) for c in zip(*x)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    spread = rng.standard_normal((40, 40))
    vectors = (rng.standard_normal((700, 40)) @ spread / 6).tolist()
    ids = [*range(600), *[3] * 50, *[None] * 49, (1 << 60) + 1]
    odd = [None, [1.0, None] + [0.0] * 38, [float("nan")] * 40, [float("inf")] * 40, [-float("inf")] + [0.0] * 39]
    return [*zip(ids, vectors), *((1000 + i, v) for i, v in enumerate(odd))]


def test_query(spark, rows, tmp_path):
    frame = spark.createDataFrame([(i, v, 1, "mine") for i, v in rows], EMBEDDINGS)
    frame.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op12_jacobi_davidson"](spark, str(tmp_path)).toPandas()
    ids, x, sums = brute(rows)
    n = len(x)
    assert len(found) == n * 32 and (found.n == n).all()
    away = [[n * a - s for a, s in zip(row, sums)] for row in x]
    deviations = sorted(sum(d * d for d in row) for row in away)
    assert sorted(found[found.component == 1].deviation.tolist()) == deviations
    centred = np.array(away, float) / n
    dense = centred.T @ centred / n
    values, vectors = np.linalg.eigh(dense)
    values, vectors = values[::-1], vectors[:, ::-1]
    for k in range(32):
        own = found[found.component == k + 1]
        assert np.allclose(own.explained, values[k] / np.trace(dense), rtol=1e-10)
        expected = centred @ vectors[:, k] / np.sqrt(values[k])
        got = own.sort_values("deviation", kind="stable").whitened.to_numpy()
        expected = expected[np.argsort([sum(d * d for d in row) for row in away], kind="stable")]
        sign = np.sign(got @ expected)
        assert np.abs(np.sort(sign * got) - np.sort(expected)).max() < 1e-8
    assert found.identity_error.nunique() == 1 and 0 <= found.identity_error[0] < 1e-10
    wide = found[found.vec_id == (1 << 60) + 1].sort_values("component").whitened.to_numpy()
    expected = centred[ids.index((1 << 60) + 1)] @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(wide) - np.abs(expected)).max() < 1e-8
    assert found.vec_id.isna().sum() == 49 * 32 and (found.vec_id == 3).sum() == 51 * 32


@pytest.mark.parametrize("vectors,components", [
    ([], 0), ([None], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 7, 0), ([[]], 0),
    ([[1.0, 0.0], [3.0, 0.0], [1.0, 0.0]], 1), ([[1.0, 2.0], [3.0], [0.5, 7.0]], 2), ([[1e30, 1.0], [1.0, 2.0], [2.0, 5.0]], 1)])
def test_small_tables(spark, vectors, components):
    frame = spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(vectors)], EMBEDDINGS)
    whitened, model = whitening.whiten(frame, 32)
    found = whitening.by_component(whitened, model).collect()
    used = [v for v in vectors if v is not None and max(v, default=0) < 1e12]
    assert len(found) == len(used) * components and {r.component for r in found} == set(range(1, components + 1))
    if components:
        assert abs(sum({r.component: r.explained for r in found}.values()) - 1) < 1e-12


def test_deviations_beyond_64_bits_raise(spark):
    frame = spark.createDataFrame([(i, [1e12 * (i % 2)], 0, "") for i in range(10)], EMBEDDINGS)
    whitened, model = whitening.whiten(frame, 1)
    with pytest.raises(PythonException, match="64|range|int64|long"):
        whitened.collect()
