import numpy as np
import pytest
from pyspark.sql import types as T

from grantlens.llm import embeddings, queries
from grantlens.llm.embeddings import CoverTree, Links, dual_traversal, link_embeddings

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, threshold=0.95):
    """(links, component) of each usable row, all pairs compared in double precision."""
    ids = [i for i, _ in rows]
    points = np.array([v for _, v in rows], np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    near = points @ points.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        wider = np.array([min([label[k], *label[near[k]]]) for k in range(len(ids))])
        if (wider == label).all():
            break
        label = wider
    smallest = {k: min(i for i, x in zip(ids, label, strict=True) if x == k) for k in set(label)}
    return {i: (int(n), smallest[k]) for i, n, k in zip(ids, near.sum(axis=1), label, strict=True)}


def clouds(seed, sizes, spread, d=16):
    rng = np.random.default_rng(seed)
    out = []
    for size, s in zip(sizes, spread, strict=True):
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        out.append(centre + s * rng.standard_normal((size, d)))
    return np.concatenate(out).astype(np.float32)


def check_tree(tree):
    assert sorted(tree.order.tolist()) == list(range(len(tree.points)))
    for i, kids in enumerate(tree.children):
        own = tree.order[tree.begin[i] : tree.end[i]]
        gaps = np.linalg.norm(tree.points[own] - tree.points[tree.centre[i]], axis=1)
        assert gaps.max() <= tree.radius[i] + 1e-7
        if kids:
            inside = np.concatenate([tree.order[tree.begin[k] : tree.end[k]] for k in kids])
            assert sorted(inside) == sorted(own)
            # the node's centre goes on, and what its children cover is half as wide
            assert tree.centre[i] in {tree.centre[k] for k in kids}
            width = 2.0 ** np.floor(np.log2(tree.radius[i]) + 1e-12)
            assert all(tree.radius[k] <= width / 2 + 1e-7 for k in kids)


@pytest.mark.parametrize("spread", [0.0, 0.005, 0.03, 0.08, 0.3])
def test_dual_traversal_finds_what_all_pairs_find(spread):
    points = clouds(1, [60, 300, 5], [spread, spread / 2, 0.5])
    points = points.astype(np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = CoverTree(points, leaf=8)
    check_tree(tree)
    links = Links(np.ones(len(points), np.int64))
    at = np.arange(len(points))
    dual_traversal(tree, tree, at, at, links, 0.95)
    two = Links(np.ones(len(points), np.int64))
    half = len(points) // 2
    a, b = CoverTree(points[:half], leaf=8), CoverTree(points[half:], leaf=8)
    dual_traversal(a, a, at[:half], at[:half], two, 0.95)
    dual_traversal(b, b, at[half:], at[half:], two, 0.95)
    dual_traversal(a, b, at[:half], at[half:], two, 0.95)
    want = brute(list(zip(at.tolist(), points, strict=True)))
    for found in (links, two):
        assert found.linked.tolist() == [want[i][0] for i in at]
        assert [found.root(i) for i in at] == [want[i][1] for i in at]


@pytest.mark.parametrize("block,anchors", [(4096, 512), (25, 6)])
def test_against_all_pairs(spark, block, anchors):
    points = clouds(2, [80, 60, 40, 30], [0.01, 0.04, 0.08, 0.4])
    rows = [(i, p.tolist()) for i, p in enumerate(np.concatenate((points, points[:20], 2 * points[5:9])))]
    found = link_embeddings(spark.createDataFrame(rows, SCHEMA), block=block, anchors=anchors).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == brute(rows)


def test_given_embeddings(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op5_embedding_near_dedup(spark, sf_dir).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, "a"),
        (2, [0.0, 0.0], "a"),
        (3, [1.0, None], "a"),
        (4, [nan, 1.0], None),
        (5, [inf, 1.0], "a"),
        (6, [1.0, 0.0], "a"),
        (7, [2.0, -0.0], "a"),
        (8, [1.0, 0.0], "a"),
        (8, [1.0, 0.0], "a"),
        (9, [1.0, 0.0, 0.0], "a"),
        (None, [0.0, 1.0], "a"),
        (10, [], "a"),
        (11, [1e-30, 0.0], "a"),
    ]
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("point", T.StringType()),
        ]
    )
    frame = spark.createDataFrame(rows, schema)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in link_embeddings(frame).collect())
    alone = [(str(i), 0, i) for i in (1, 2, 3, 4, 5, 9, 10)]
    linked = [(str(i), 4, 6) for i in (6, 7, 8, 8, 11)]
    assert got == sorted([*alone, *linked, ("None", 0, None)])
    assert link_embeddings(frame.limit(0)).count() == 0


def test_net_covers_the_sample():
    points = np.eye(20)
    assert len(embeddings.choose_anchors(points, 8)) == 8
    assert len(embeddings.choose_anchors(points[:0], 8)) == 0
