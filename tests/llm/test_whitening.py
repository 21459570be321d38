import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.llm import whitening

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


def by_hand(vectors: list[list[float]], components: int = 16):
    """n, S, covariance and eigenpairs of the distinct grid vectors, from numpy's own solver."""
    x = np.unique([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], axis=0)
    n, sums = len(x), x.sum(axis=0)
    off = (n * x - sums) / n
    cov = off.T @ off / n
    values, axes = np.linalg.eigh(cov)
    return n, sums, cov, values[::-1][:components], axes[:, ::-1][:, :components]


def check(rows, given, components=16):
    usable = [(i, v) for i, v in given if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, cov, values, axes = by_hand([v for _, v in usable], components)
    kept = int((values > 1e-12 * values[0]).sum())
    assert len(rows) == len(usable) * kept
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for i, v in usable:
        x = np.array([int(np.floor(64 * c)) + 1_000_000 for c in v])
        want = ((x - sums / n) @ axes[:, :kept]) / np.sqrt(values[:kept])
        own = [got[i][k + 1] for k in range(kept)]
        have = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.where(np.abs(have - want) <= np.abs(have + want), 1, -1)
        assert np.allclose(have * signs, want, rtol=1e-6, atol=1e-7)
        assert {r["deviation"] for r in own} == {int(((n * x - sums) ** 2).sum())}
        assert {r["n"] for r in own} == {n}
        assert np.allclose([r["explained"] for r in own], values[:kept] / np.trace(cov), rtol=1e-9)
        assert max(r["identity_error"] for r in own) < 1e-9


def test_given_vectors(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    given = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    check(whitening.whiten_embeddings(frame).collect(), given)


@pytest.mark.parametrize("dims", [1, 2, 5, 40])
def test_against_eigh(table, dims):
    rng = np.random.default_rng(dims)
    rows = (rng.standard_normal((300, dims)) * np.geomspace(1, 40, dims)).tolist()
    given = list(enumerate(rows))
    check(whitening.whiten_embeddings(table(given)).collect(), given)


def test_fewer_vectors_than_components(table):
    rng = np.random.default_rng(3)
    given = [(i, v) for i, v in enumerate(rng.standard_normal((6, 30)).tolist())]
    check(whitening.whiten_embeddings(table(given)).collect(), given)


def test_odd_rows(spark, table):
    rng = np.random.default_rng(9)
    given = [(i, v) for i, v in enumerate(rng.standard_normal((40, 4)).tolist())]
    given += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0])]
    frame = table(given + [given[3], (None, given[4][1]), (104, [0.0, -0.0, 0.0, 0.0]), (105, [0.0, 0.0, 0.0, 0.0])])
    frame = frame.withColumn("whitened", F.lit("x")).withColumn("n", F.lit(0)).withColumn("x", F.lit(1))
    rows = whitening.whiten_embeddings(frame).collect()
    assert {r["n"] for r in rows} == {41}  # repeats count once
    assert sum(r["vec_id"] == 3 for r in rows) == 8 and sum(r["vec_id"] is None for r in rows) == 4
    assert not {100, 101, 102, 103} & {r["vec_id"] for r in rows}
    a, b = ([r["whitened"] for r in rows if r["vec_id"] == i] for i in (104, 105))
    assert a == b


def test_short_and_huge_entries(table):
    given = [(1, [1.0]), (2, [1.0, 0.0]), (3, [0.5, 2.0]), (4, [1e300, 3.0]), (5, []), (6, [-1e300, 1.0])]
    rows = whitening.whiten_embeddings(table(given)).collect()
    assert {r["vec_id"] for r in rows} == {1, 2, 3, 4, 5, 6}
    one, two = ([r["whitened"] for r in rows if r["vec_id"] == i] for i in (1, 2))
    assert one == two and all(np.isfinite([r["whitened"] for r in rows]))
    assert all(r["deviation"] is None for r in rows if r["vec_id"] == 4)


@pytest.mark.parametrize("given", [[], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_tell_apart(table, given):
    frame = whitening.whiten_embeddings(table(given))
    assert frame.columns == ["vec_id", *whitening.RESULTS] and frame.collect() == []


def matrix_of(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 50, 50),
        np.concatenate((np.ones(30), np.full(6, 2.0), [3.0])),  # repeated eigenvalues
        np.concatenate((np.linspace(60, 60.001, 20), [1e-6] * 20)),  # crowded ones
        np.geomspace(1e-10, 1e8, 40),
        np.concatenate((np.zeros(30), [5.0, 4.0])),
    ],
)
def test_feast_finds_what_inertia_counts(spark, values):
    matrix, _ = matrix_of(np.asarray(values, float))
    matrix = (matrix + matrix.T) / 2
    want = np.linalg.eigvalsh(matrix)[::-1]
    kept = min(16, int((want > 1e-12 * want[0]).sum()))
    found, vectors = whitening.leading_components(spark, matrix)
    assert np.allclose(found, want[:kept], rtol=1e-9, atol=1e-12 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(kept)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * want[0]


def test_inertia_counts():
    matrix, _ = matrix_of(np.array([-2.0, 0.0, 1.0, 1.0, 3.0, 7.5]))
    diagonal, off = whitening.tridiagonal(matrix)
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))), [-2, 0, 1, 1, 3, 7.5])
    assert whitening.above(diagonal, off, [-3, -1, 0.5, 2, 5, 8]).tolist() == [6, 5, 4, 2, 1, 0]
    parts = whitening.fences(diagonal, off, 3)
    assert sum(p[2] for p in parts) >= 3 and all(a[0] >= b[1] for a, b in zip(parts, parts[1:], strict=False))
