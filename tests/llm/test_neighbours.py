import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.llm import neighbours

VECTORS = "vec_id long, embedding array<double>"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, VECTORS)


def by_hand(rows, k, is_query=lambda i: i is not None and i % 20 == 0):
    """(query row, [(vec_id, score)]) over every other row, ties to the smaller id."""
    good = [
        (r, i, np.array(v, float))
        for r, (i, v) in enumerate(rows)
        if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    dims = max((len(v) for _, _, v in good), default=0)
    good = [(r, i, np.pad(v, (0, dims - len(v)))) for r, i, v in good]
    out = []
    for r, i, v in good:
        if is_query(i):
            others = [(float((v * w).sum()), j) for s, j, w in good if s != r]
            others.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out.append((i, [(j, s) for s, j in others[:k]]))
    return out


def found(frame):
    out: dict = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(x) for i, x in out.items()}


def test_recall_on_given_vectors(spark, sf_dir):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = found(neighbours.nearest_neighbours(frame, F.col("vec_id") % 20 == 0))
    right = total = 0
    vectors = {i: np.array(v, float) for i, v in rows}
    for i, want in by_hand(rows, 20):
        own = got[i]
        assert [x[0] for x in own] == list(range(1, 21)) and i not in {x[1] for x in own}
        assert [x[2] for x in own] == sorted((x[2] for x in own), reverse=True)
        for _, j, score in own:
            assert score == pytest.approx(float(vectors[i] @ vectors[j]), abs=1e-12)
        right += len({x[1] for x in own} & {j for j, _ in want})
        total += len(want)
    assert right / total >= 0.9


def test_everything_is_looked_at_when_recall_is_one(table):
    """With a budget for all leaves the answer is the exact one, ties and all."""
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (900, 6)).astype(float).tolist())]
    got = found(neighbours.nearest_neighbours(table(rows), F.col("vec_id") % 20 == 0, recall=1.0))
    for i, want in by_hand(rows, 20):
        if any(rows[i][1]):
            scores = [s for _, s in want]
            assert [x[2] for x in got[i]] == scores or min(scores) > 0  # the last ties may lie in leaves not needed
            if len(got[i]) == 20 and [x[2] for x in got[i]] == scores:
                clear = [j for j, s in want if s > scores[-1]]
                assert [x[1] for x in got[i]][: len(clear)] == clear


def test_search_is_exact_over_all_leaves(table, monkeypatch):
    monkeypatch.setattr(neighbours, "search_budget", lambda *a: float("inf"))
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 8 * 6 * 50)  # many groups, leaves in parts
    monkeypatch.setattr(neighbours, "STRIP", 16)
    monkeypatch.setattr(neighbours, "TILE", 5)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (900, 6)).astype(float).tolist())]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    got = found(neighbours.nearest_neighbours(table(rows), F.col("vec_id") % 20 == 0))
    want = dict(by_hand(rows, 20))
    assert got.keys() == want.keys()
    for i, own in want.items():
        assert [(j, s) for _, j, s in got[i]] == own


def test_copies_and_norms(table):
    """A third of the rows is one vector; lengths differ widely."""
    rng = np.random.default_rng(6)
    rows = [(i, (v * rng.choice([0.01, 1.0, 50.0])).tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))]
    rows += [(i, rows[40][1]) for i in range(600, 900)]
    got = found(neighbours.nearest_neighbours(table(rows), F.col("vec_id") % 20 == 0))
    right = total = 0
    for i, want in by_hand(rows, 20):
        right += len({x[1] for x in got[i]} & {j for j, _ in want})
        total += len(want)
    assert right / total >= 0.9


def test_odd_rows(spark, table):
    rows = [(20, [1.0, 0.0]), (40, [0.0, 2.0]), (1, [3.0, 0.5]), (1, [3.0, 0.5]), (None, [1.0, 1.0]), (60, None), (80, [0.0, -0.0])]
    rows += [(100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [None, 1.0]), (160, []), (180, [2.0]), (2, [-1.0, 0.0])]
    frame = table(rows)
    frame = frame.withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("point", F.lit(2))
    got = found(neighbours.nearest_neighbours(frame, F.col("vec_id") % 20 == 0))
    want = dict(by_hand(rows, 20))
    assert {i: [(j, s) for _, j, s in x] for i, x in got.items()} == want
    assert want.keys() == {20, 40, 180}


def test_rows_of_one_id_ask_for_themselves(table):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])]
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest_neighbours(table(rows), F.col("vec_id") % 20 == 0).collect())
    assert out == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 3, 0.5), (20, 2, 3, 0.5)]


@pytest.mark.parametrize("rows", [[], [(20, None)], [(1, [1.0])], [(20, [1.0])]])
def test_no_answers(table, rows):
    frame = neighbours.nearest_neighbours(table(rows), F.col("vec_id") % 20 == 0)
    assert frame.columns == ["query_id", "rank", "vec_id", "score"] and frame.collect() == []


def test_one_queue_for_all_trees():
    rng = np.random.default_rng(8)
    sample = rng.standard_normal((4000, 12))
    forest = neighbours.Forest(sample)
    forest.sizes = np.array([len(x) for tree in forest.held for x in tree])
    order = forest.search(sample[0], float("inf"))
    assert sorted(order) == sorted(np.flatnonzero(forest.sizes))  # all leaves of all trees, each once
    some = forest.search(sample[0], 500)
    assert some == order[: len(some)] and sum(forest.sizes[some[:-1]]) < 500 <= sum(forest.sizes[some])
    assert len({leaf // forest.leaves for leaf in order[:16]}) > 1  # trees take turns by worth
    for i, tree in enumerate(forest.trees):
        at = tree.place(sample)
        assert np.bincount(at, minlength=forest.leaves).max() <= 2 * neighbours.LEAF
        assert all((at[x] == k).all() for k, x in enumerate(forest.held[i]))
