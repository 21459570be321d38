"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then placed in a leaf of each. A query searches
all trees through one priority queue: of all nodes met so far, the one that leads to the leaf whose centre
has the largest inner product with the query is opened next, until the leaves taken hold as many vectors
as the search budget says. The budget is not guessed: some queries are answered exactly, and the budget is what the wanted
recall takes on them. Queries meet the vectors of their leaves in groups of bounded size, where inner
products are computed exactly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.tables import cut_lineage

NEIGHBOURS = 20
TREES = 4
SAMPLE_ROWS = 32_768  # vectors that trees are fitted on, at most
SAMPLE_BYTES = 1 << 24  # and their volume in double precision, at most
LEAF = 32  # sample vectors of a leaf, about
TRIES = 4  # random directions of a node, of which the one that spreads most is taken
RECALL = 0.95  # share of true neighbours that the budget is set for
PROBES = 128  # queries answered exactly to set it
GROUP_BYTES = 1 << 22  # vectors of one group, in double precision
STRIP = 2048  # queries of one group
TILE = 256  # queries multiplied at a time
SLACK = 1e-9  # relative error allowed to a product before it is worked out once more

SEED = 12


def usable(vector: F.Column) -> F.Column:
    """Whether a vector takes part: not null, not zero, every component there and finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda c: c != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of ``dims`` doubles each as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dims)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in one order whatever else is computed beside them."""
    return (x * y).sum(axis=1)


# --- the forest -------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A full binary tree of random projections; node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    depth: int
    directions: np.ndarray  # of inner nodes
    limits: np.ndarray
    centres: np.ndarray  # of leaves: mean of their sample vectors

    @classmethod
    def fit(cls, sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, len(sample) / leaf)))))
        dims = sample.shape[1]
        directions, limits = np.zeros(((1 << depth) - 1, dims)), np.zeros((1 << depth) - 1)
        centres = np.zeros((1 << depth, dims))
        stack = [(0, np.arange(len(sample)))]
        while stack:
            node, rows = stack.pop()
            if node >= len(limits):
                if len(rows):
                    centres[node - len(limits)] = sample[rows].mean(axis=0)
                continue
            path, up = [], node
            while up:
                up = (up - 1) // 2
                path.append(directions[up])
            tried = rng.standard_normal((TRIES, dims))
            for one in path:  # at right angles to the directions above, as long as there are any
                tried -= np.outer(tried @ one, one)
            length = np.linalg.norm(tried, axis=1, keepdims=True)
            tried = np.where(length > 1e-9, tried / np.maximum(length, 1e-300), np.eye(1, dims, node % dims))
            at = sample[rows] @ tried.T
            k = int(at.std(axis=0).argmax()) if len(rows) else 0
            directions[node] = tried[k]
            limits[node] = np.median(at[:, k]) if len(rows) else 0.0
            high = at[:, k] > limits[node] if len(rows) else np.zeros(0, bool)
            stack += [(2 * node + 1, rows[~high]), (2 * node + 2, rows[high])]
        return cls(depth, directions, limits, centres)

    def worth(self, query: np.ndarray) -> np.ndarray:
        """For each node, the largest inner product of the query with the centre of a leaf below it."""
        levels = [self.centres @ query]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).max(axis=1))
        return np.concatenate(levels[::-1])

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf number (from 0) of each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            high = products(points, self.directions[node]) > self.limits[node]
            node = 2 * node + 1 + high
        return node - (1 << self.depth) + 1


class Forest:
    """Trees over one sample, with one queue to search them all."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        rng = np.random.default_rng(SEED)
        self.trees = [Tree.fit(sample, leaf, rng) for _ in range(trees)]
        self.leaves = 1 << self.trees[0].depth  # of each tree
        self.sample = sample
        held = [t.place(sample) for t in self.trees]
        self.held = [[np.flatnonzero(h == k) for k in range(self.leaves)] for h in held]
        self.sizes = np.zeros(trees * self.leaves, np.int64)  # vectors of all leaves, once placed

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every point in every tree; leaves of all trees are numbered through."""
        return np.stack([t.place(points) + i * self.leaves for i, t in enumerate(self.trees)], axis=1)

    def search(self, query: np.ndarray, budget: float) -> list[int]:
        """Leaves in the order the queue yields them, until they hold ``budget`` vectors."""
        worth = [t.worth(query) for t in self.trees]
        first = self.leaves - 1  # the first node that is a leaf
        queue = [(-worth[i][0], i, 0) for i in range(len(self.trees))]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < budget:
            _, tree, node = heapq.heappop(queue)
            if node >= first:
                leaf = tree * self.leaves + node - first
                if self.sizes[leaf]:
                    out.append(leaf)
                    held += self.sizes[leaf]
                continue
            for child in (2 * node + 1, 2 * node + 2):
                heapq.heappush(queue, (-worth[tree][child], tree, child))
        return out

    def least(self, query: np.ndarray, leaves: list[int], k: int) -> float:
        """The k-th largest inner product among the sample's own vectors in these leaves."""
        rows = np.unique(np.concatenate([self.held[x // self.leaves][x % self.leaves] for x in leaves])) if leaves else []
        if len(rows) < k:
            return -np.inf
        return float(np.partition(self.sample[rows] @ query, len(rows) - k)[len(rows) - k])


# --- tables -----------------------------------------------------------------------------------------


def point_table(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(point, vector, first): every distinct vector; (point, row, vec_id): up to ``k`` rows of each.

    Of the rows of one vector no more than the ``k`` with the smallest ids can be among ``k`` nearest.
    """
    points = rows.groupBy("point").agg(F.any_value("vector").alias("vector"), F.min("vec_id").alias("first"))
    order = Window.partitionBy("point").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    ids = rows.select("point", "row", "vec_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    return points, ids.drop("_k")


def fit_forest(points: DataFrame, dims: int, trees: int = TREES) -> Forest:
    """Trees over the points of least hash: a sample that is bounded in rows and bytes."""
    rows = max(2 * LEAF, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    sample = points.orderBy(F.xxhash64("point", F.lit(SEED)), "point").limit(rows).select("vector").toArrow()
    return Forest(matrix(sample.column("vector"), dims), trees)


def place_points(points: DataFrame, forest: Forest, dims: int) -> DataFrame:
    """``points`` with ``leaves``, one of each tree."""

    def place(column: pa.Array) -> pa.Array:
        leaves = [forest.place(matrix(column[at : at + 4096], dims)) for at in range(0, len(column), 4096)]
        flat = np.concatenate(leaves).astype(np.int32) if leaves else np.zeros((0, len(forest.trees)), np.int32)
        ends = np.arange(len(flat) + 1, dtype=np.int32) * len(forest.trees)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    placed = F.arrow_udf(place, "array<int>").asNondeterministic()(F.col("vector"))
    return points.select("point", "vector", "first", placed.alias("leaves"))


def exact_neighbours(placed: DataFrame, queries: np.ndarray, dims: int, k: int) -> DataFrame:
    """(query, point, leaves, score): the ``k`` points of largest product with each of a few queries."""

    def nearest(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), dims)
            if not len(x):
                continue
            score = queries @ x.T
            top = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
            which = np.repeat(np.arange(len(queries)), top.shape[1])
            rows = pa.array(top.ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(which, pa.int32()),
                    batch.column("point").take(rows),
                    batch.column("leaves").take(rows),
                    pa.array(score[which, top.ravel()]),
                ],
                ["query", "point", "leaves", "score"],
            )

    rows = placed.select("point", "leaves", "vector").mapInArrow(
        nearest, "query int, point long, leaves array<int>, score double"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def search_budget(placed: DataFrame, queries: DataFrame, forest: Forest, dims: int, k: int, recall: float) -> float:
    """Vectors that a search must look through to find ``recall`` of the true neighbours.

    ``PROBES`` queries, those of least hash, are answered exactly over all vectors; the cost of a true
    neighbour is what the queue has yielded when its leaf comes up. At most PROBES x (k + 1) rows reach
    the driver.
    """
    probes = queries.orderBy(F.xxhash64("row", F.lit(SEED)), "row").limit(PROBES).select("point", "vector").toArrow()
    if not len(probes):
        return 0.0
    vectors, own = matrix(probes.column("vector"), dims), probes.column("point").to_pylist()
    truth = exact_neighbours(placed, vectors, dims, k + 1).collect()
    costs = []
    passed = [np.full(len(forest.sizes), np.inf) for _ in own]
    for q, vector in enumerate(vectors):
        leaves = forest.search(vector, np.inf)
        passed[q][leaves] = np.cumsum(forest.sizes[leaves])
    for r in truth:
        if r["point"] != own[r["query"]]:
            costs.append(passed[r["query"]][r["leaves"]].min())
    return float(np.quantile(costs, recall, method="higher")) if costs else float(forest.sizes.sum())


def groups_of(forest: Forest, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of every leaf, and the parts of every group: neighbouring leaves of a tree of ``most`` vectors.

    A leaf of more vectors is a group of its own, dealt into parts.
    """
    group, parts, held = np.zeros(len(forest.sizes), np.int32), [], 0
    for leaf, size in enumerate(forest.sizes):
        if not parts or leaf % forest.leaves == 0 or held + size > most:
            parts.append(0)
            held = 0
        held += size
        group[leaf] = len(parts) - 1
        parts[-1] = max(1, -(-int(held) // most))
    return group, np.array(parts, np.int32)


def _routing(forest: Forest, group: np.ndarray, budget: float, dims: int, k: int):
    def route(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), 1024):
            for query in matrix(column[at : at + 1024], dims):
                leaves = forest.search(query, budget)
                least = forest.least(query, leaves, k + 1)
                visits: dict[int, list[int]] = {}
                for leaf in leaves:
                    visits.setdefault(int(group[leaf]), []).append(leaf)
                out.append([{"group": g, "leaves": x, "least": least} for g, x in visits.items()])
        kind = pa.struct([("group", pa.int32()), ("leaves", pa.list_(pa.int32())), ("least", pa.float64())])
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(route, "array<struct<group:int,leaves:array<int>,least:double>>").asNondeterministic()


FOUND = "query long, point long, first long, score double"


def _nearest(dims: int, k: int):
    """Per query of a group, the k + 1 vectors of largest product in the leaves that it visits."""

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        vectors = matrix(table.column("vector"), dims)
        ids = table.column("id").to_numpy()
        first = table.column("first")
        leaves = table.column("leaves").combine_chunks()
        which = np.repeat(np.arange(len(ids)), leaves.value_lengths().to_numpy())
        flat = leaves.flatten().to_numpy()
        # rows by leaf, vectors and visitors apart
        visitor = is_query[which]
        homes, home_leaf = which[~visitor], flat[~visitor]
        calls, call_leaf = which[visitor], flat[visitor]
        by = np.argsort(home_leaf, kind="stable")
        homes, home_leaf = homes[by], home_leaf[by]
        by = np.argsort(call_leaf, kind="stable")
        calls, call_leaf = calls[by], call_leaf[by]
        floor = table.column("least").to_numpy()
        size = np.abs(vectors).max(axis=1) * dims
        hits = []
        for leaf in np.unique(call_leaf):
            own = homes[slice(*np.searchsorted(home_leaf, [leaf, leaf + 1]))]
            asked = calls[slice(*np.searchsorted(call_leaf, [leaf, leaf + 1]))]
            if not len(own):
                continue
            error = SLACK * float(size[own].max())
            for at in range(0, len(asked), TILE):
                some = asked[at : at + TILE]
                score = vectors[some] @ vectors[own].T
                least = floor[some]
                if len(own) > k + 1:
                    least = np.maximum(least, np.partition(score, len(own) - k - 1, axis=1)[:, len(own) - k - 1])
                slack = error * np.abs(vectors[some]).max(axis=1)
                row, column = np.nonzero(score >= (least - slack)[:, None])
                hits.append((some[row], own[column]))
        query = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
        point = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
        score = np.concatenate(
            [products(vectors[query[at : at + 8192]], vectors[point[at : at + 8192]]) for at in range(0, len(query), 8192)]
            or [np.zeros(0)]
        )
        # the best k + 1 of each query; of equal ones those with the smallest ids, ids that are null last
        least_id = first.to_numpy() if not first.null_count else first.fill_null(np.iinfo(np.int64).max).to_numpy()
        order = np.lexsort((ids[point], least_id[point], -score, query))
        query, point, score = query[order], point[order], score[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = query[1:] != query[:-1]
        rank = np.arange(len(query)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(query) else np.zeros(0, int)
        keep = rank <= k
        return pa.table(
            {
                "query": pa.array(ids[query[keep]], pa.int64()),
                "point": pa.array(ids[point[keep]], pa.int64()),
                "first": first.take(pa.array(point[keep])),
                "score": pa.array(score[keep]),
            }
        )

    return search


def candidates(placed: DataFrame, routed: DataFrame, group: np.ndarray, parts: np.ndarray, dims: int, k: int) -> DataFrame:
    """(query, point, first, score): the best of each group that a query visits, every pair once."""
    spark = placed.sparkSession
    # one row for each leaf and for each group: bounded by the forest and by what a group may hold
    leaf_table = spark.createDataFrame(
        [(i, int(g), int(parts[g])) for i, g in enumerate(group)], "leaf int, group int, parts int"
    )
    calls = routed.select("row", "vector", F.inline("visits"))
    strips = calls.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / STRIP).cast("int").alias("strips"))
    homes = placed.select("point", "vector", "first", F.explode("leaves").alias("leaf")).join(leaf_table, "leaf")
    homes = homes.join(strips, "group")  # groups that no query visits go
    part = F.pmod(F.xxhash64("point", F.lit(1)), F.col("parts")).cast("int")
    homes = homes.select(
        "group", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"),
        F.col("point").alias("id"), "vector", "first", F.array("leaf").alias("leaves"),
        F.lit(None).cast("double").alias("least"), F.lit(False).alias("is_query"),
    )
    strip = F.pmod(F.xxhash64("row", F.lit(2)), F.col("strips")).cast("int")
    group_table = leaf_table.select("group", "parts").distinct()
    calls = calls.join(strips, "group").join(group_table, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), strip.alias("strip"),
        F.col("row").alias("id"), "vector", F.lit(None).cast("long").alias("first"), "leaves",
        "least", F.lit(True).alias("is_query"),
    )
    met = homes.unionByName(calls).groupBy("group", "part", "strip").applyInArrow(_nearest(dims, k), FOUND)
    # a pair met in several trees has the same score each time
    return met.repartition("query").dropDuplicates(["query", "point"])


def nearest_neighbours(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = NEIGHBOURS,
    recall: float = RECALL,
    trees: int = TREES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row where ``is_query`` holds.

    Nearness is the inner product in double precision; every row but the query's own is a candidate, so
    a query's copies are found, and rows that repeat an id are rows of their own. Ties go to the smaller
    vec_id, null ids last. Null and zero vectors, and those with null or non-finite components, take no
    part; shorter vectors count as filled up with zeros. Where fewer than ``k`` candidates are there, all
    that are found are returned. ``is_query`` may use vec_id; a null counts as false. Other columns are
    not looked at. An empty table, or one without queries, gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(usable(F.col("embedding")))
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # -0.0 becomes 0.0, so that equal vectors are equal
    filled = F.concat(
        F.transform("embedding", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))),
        F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("embedding")),
    )
    rows = rows.select("vec_id", "is_query", filled.alias("vector"))
    rows = rows.select("vec_id", "is_query", "vector", F.xxhash64("vector").alias("point"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))  # written, so that rows keep their numbers
    points, ids = point_table(rows, k + 1)
    points = cut_lineage(points)
    queries = rows.where("is_query")
    forest = fit_forest(points, dims, trees)
    placed = cut_lineage(place_points(points, forest, dims))
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        forest.sizes[r["leaf"]] = r["count"]
    budget = search_budget(placed, queries, forest, dims, k, recall)
    group, parts = groups_of(forest, max(1, GROUP_BYTES // (8 * dims)))
    visits = _routing(forest, group, budget, dims, k)(F.col("vector"))
    routed = cut_lineage(queries.select("row", "vector", visits.alias("visits")))
    found = candidates(placed, routed, group, parts, dims, k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("first"), "point")
    found = found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1).drop("_k", "first")
    found = cut_lineage(found)
    named = found.join(ids, "point").where("row != query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return named.join(asked, "query").select("query_id", "rank", "vec_id", "score")
