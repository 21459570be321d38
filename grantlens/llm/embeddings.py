"""Exact threshold pairs of embeddings by cover trees.

Equal vectors are one point. Points are dealt to cells around anchors (a cover-tree net of a bounded
sample); a point visits every other cell that could hold a neighbour, by the triangle inequality on
distances to the anchors. A cell is cut into blocks of bounded size. Each block, and each pair of
blocks, builds cover trees (nested levels of halving radii) and traverses them two at a time: a pair
of nodes whose covering balls are too far apart is dropped, one whose balls lie wholly within reach
is counted as a whole, and only what lies between is taken apart.

Points within half the reach of their anchor are all linked to each other; such cores are counted
and never compared among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.graph import components
from grantlens.llm.tables import cut_lineage

THRESHOLD = 0.95
SAMPLE = 2048  # points that anchors are chosen from
ANCHORS = 512  # at most; one for each BLOCK points before that
BLOCK = 4096  # points of one block of a cell
LEAF = 64  # points of a node that is not taken apart further
SPARSE = 32
TILE = 1024  # points compared at a time
SINGLE = 1e-5  # error of a cosine in single precision, generously
EPS = 1e-6  # bounds within this distance of the limit are settled by the cosine itself


def reach_of(threshold: float) -> float:
    """Distance of unit vectors at the threshold."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of unit vectors from one of them; right to about 1e-8, which ``EPS`` allows for."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ centre)))


class CoverTree:
    """Nested nets of halving radii over unit vectors; ``order`` lists points leaf by leaf.

    Node ``i`` has a centre, the exact radius that covers its points, its points
    ``order[begin[i]:end[i]]``, and its children. A node whose points keep apart at half its radius
    (a net of more than one in ``SPARSE``) stays whole: taking it apart would prune little.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.children: list[list[int]] = []
        self.order = np.arange(len(points))
        if not len(points):
            return
        self._add(0, 0, len(points), _distances(points, points[0]))
        stack = [(0, 2.0)]
        while stack:
            node, width = stack.pop()
            lo, hi = self.begin[node], self.end[node]
            if hi - lo <= leaf or self.radius[node] <= 1e-7:
                continue
            width = min(width, 2.0 ** np.floor(np.log2(self.radius[node]) + 1e-12))
            own = self.order[lo:hi]
            # the node's centre is a centre of the next level as well (nested levels)
            cell = np.full(len(own), -1)
            best = np.full(len(own), np.inf)
            centres, distances = [], []
            while len(centres) <= 8 + len(own) / SPARSE:
                if not centres:
                    c = self.centre[node]
                else:
                    # the next centre is the farthest point not covered at half the radius
                    k = int(best.argmax())
                    if best[k] <= width / 2:
                        break
                    c = int(own[k])
                d = _distances(points[own], points[c])
                nearer = d < best
                cell[nearer], best[nearer] = len(centres), d[nearer]
                centres.append(c)
                distances.append(d)
            if best.max() > width / 2:
                continue
            by = np.argsort(cell, kind="stable")
            self.order[lo:hi] = own[by]
            counts = np.bincount(cell, minlength=len(centres))
            at = lo
            for k, c in enumerate(centres):
                if counts[k]:
                    child = self._add(c, at, at + counts[k], distances[k][cell == k])
                    self.children[node].append(child)
                    stack.append((child, width / 2))
                    at += counts[k]

    def _add(self, centre: int, begin: int, end: int, distances: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(distances.max()))
        self.begin.append(int(begin))
        self.end.append(int(end))
        self.children.append([])
        return len(self.centre) - 1


class Links:
    """Weights of linked points, and links that connect the same points as all of them."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes  # rows that a point stands for
        self.linked = np.zeros(len(sizes), np.int64)
        self.parent = np.arange(len(sizes))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def join_all(self, members: np.ndarray) -> None:
        for i in members[1:]:
            self.join(int(members[0]), int(i))


def dual_traversal(
    a: CoverTree, b: CoverTree, at_a: np.ndarray, at_b: np.ndarray, links: Links, threshold: float
) -> None:
    """All links between the points of two trees (``a is b``: within one tree).

    ``at_a`` and ``at_b`` are the numbers of the trees' points in ``links``.
    """
    if not len(a.points) or not len(b.points):
        return
    reach, same = reach_of(threshold), a is b
    connected: set[tuple[int, int]] = set()  # nodes whose points are known to be connected

    def take_all(tree: int, node: int, members: np.ndarray) -> np.ndarray:
        if (tree, node) in connected:
            return members[:1]
        connected.add((tree, node))
        return members

    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        own_a = a.order[a.begin[i] : a.end[i]]
        own_b = b.order[b.begin[j] : b.end[j]]
        rows, others = at_a[own_a], at_b[own_b]
        if same and i == j:
            if 2 * a.radius[i] <= reach - EPS:
                links.linked[rows] += links.sizes[rows].sum() - links.sizes[rows]
                links.join_all(take_all(0, i, rows))
            elif not a.children[i]:
                _compare_within(a.points[own_a], rows, links, threshold)
            else:
                kids = a.children[i]
                stack += [(x, y) for n, x in enumerate(kids) for y in kids[n:]]
            continue
        gap = float(np.linalg.norm(a.points[a.centre[i]] - b.points[b.centre[j]]))
        cover = a.radius[i] + b.radius[j]
        if gap - cover > reach + EPS:
            continue
        if gap + cover <= reach - EPS:
            links.linked[rows] += links.sizes[others].sum()
            links.linked[others] += links.sizes[rows].sum()
            tree_b = 0 if same else 1
            links.join_all(np.concatenate((take_all(0, i, rows), take_all(tree_b, j, others))))
        elif (not a.children[i] and not b.children[j]) or len(own_a) * len(own_b) <= LEAF * LEAF:
            _compare(a.points[own_a], b.points[own_b], rows, others, links, threshold)
        elif b.children[j] and (not a.children[i] or b.radius[j] > a.radius[i]):
            stack += [(i, y) for y in b.children[j]]
        else:
            stack += [(x, j) for x in a.children[i]]


def _compare_within(points: np.ndarray, rows: np.ndarray, links: Links, threshold: float) -> None:
    for p in range(0, len(points), TILE):
        one = slice(p, p + TILE)
        near = _near(points[one], points[one], threshold)
        np.fill_diagonal(near, False)
        if near.any():
            links.linked[rows[one]] += near @ links.sizes[rows[one]]
            _connect(near, rows[one], rows[one], links)
        for q in range(p + TILE, len(points), TILE):
            two = slice(q, q + TILE)
            _compare(points[one], points[two], rows[one], rows[two], links, threshold)


def _compare(x, y, at_x: np.ndarray, at_y: np.ndarray, links: Links, threshold: float) -> None:
    for p in range(0, len(x), TILE):
        for q in range(0, len(y), TILE):
            one, two = slice(p, p + TILE), slice(q, q + TILE)
            near = _near(x[one], y[two], threshold)
            if near.any():
                links.linked[at_x[one]] += near @ links.sizes[at_y[two]]
                links.linked[at_y[two]] += near.T @ links.sizes[at_x[one]]
                _connect(near, at_x[one], at_y[two], links)


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, in double precision; single precision rules out most."""
    near = x.astype(np.float32) @ y.astype(np.float32).T >= threshold - SINGLE
    if near.any():
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near[np.ix_(rows, columns)] = x[rows] @ y[columns].T >= threshold
    return near


def _connect(near: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, links: Links) -> None:
    """Join what a tile of links connects, a component at a time."""
    open_ = near.any(axis=1)
    while open_.any():
        rows = np.zeros(len(near), bool)
        rows[int(open_.argmax())] = True
        while True:
            columns = near[rows].any(axis=0)
            wider = near[:, columns].any(axis=1)
            if (wider == rows).all():
                break
            rows = wider
        links.join_all(np.concatenate((at_x[rows], at_y[columns])))
        open_ &= ~rows


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    points = flat.reshape(len(column), -1)
    # scaled first, so that squares of very small or large components do not vanish or overflow
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def choose_anchors(sample: np.ndarray, anchors: int = ANCHORS) -> np.ndarray:
    """A net of the sample: the farthest point from all anchors so far is the next."""
    if not len(sample):
        return sample
    chosen, gap = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(anchors, len(sample)) and gap.max() > 1e-6:
        k = int(gap.argmax())
        chosen.append(k)
        gap = np.minimum(gap, np.linalg.norm(sample - sample[k], axis=1))
    return sample[chosen]


PLACE = "struct<cell:int,core:boolean,visits:array<int>>"


def _placing(anchors: np.ndarray, reach: float):
    """Home cell of each vector, whether it lies in the core, and the lower cells it must visit.

    A neighbour within reach has its home at b only if b is at most 2 reaches farther than the own
    home. Of two cells the higher one's points visit the lower one.
    """

    def place(column: pa.Array) -> pa.Array:
        cells, cores, visits = [], [], []
        for at in range(0, len(column), 4096):
            points = unit(column[at : at + 4096])
            gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ anchors.T)))
            home = gaps.argmin(axis=1)
            near = gaps[np.arange(len(home)), home]
            lower = np.arange(len(anchors))[None, :] < home[:, None]
            goes = lower & (gaps <= (near + 2 * reach)[:, None] + 1e-6)
            cells += home.tolist()
            cores += (near <= reach / 2 - 1e-6).tolist()
            visits += [np.flatnonzero(row).tolist() for row in goes]
        return pa.array(
            [{"cell": c, "core": k, "visits": v} for c, k, v in zip(cells, cores, visits, strict=True)],
            pa.struct([("cell", pa.int32()), ("core", pa.bool_()), ("visits", pa.list_(pa.int32()))]),
        )

    return F.arrow_udf(place, PLACE).asNondeterministic()


LINKS = "point long, other long, linked long"


def _block_pair(threshold: float):
    """Links of one group: two blocks of a cell, a block with itself, or a block and its visitors."""

    def links(group: pa.Table) -> pa.Table:
        points = unit(group.column("vector"))
        ids = group.column("point").to_numpy()
        side = group.column("side").to_numpy()
        core = group.column("core").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = Links(group.column("size").to_numpy())
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        if low != high:
            whole = high >= 0
            sides = [(one[~core[one]], one[core[one]]) for one in (left, right)]
            trees = [[CoverTree(points[x]) for x in one] for one in sides]
            for p in (0, 1):
                for q in (0, 1):
                    if not (whole and p and q):  # cores of one cell are counted elsewhere
                        dual_traversal(trees[0][p], trees[1][q], sides[0][p], sides[1][q], out, threshold)
        else:
            x, y = left[~core], left[core]
            a = CoverTree(points[x])
            dual_traversal(a, a, x, x, out, threshold)
            dual_traversal(a, CoverTree(points[y]), x, y, out, threshold)
        roots = np.array([out.root(i) for i in range(len(ids))], np.int64)
        some = (out.linked > 0) | (roots != np.arange(len(ids)))
        return pa.table(
            {
                "point": pa.array(ids[some], pa.int64()),
                "other": pa.array(ids[roots[some]] if len(ids) else [], pa.int64()),
                "linked": pa.array(out.linked[some], pa.int64()),
            }
        )

    return links


def link_embeddings(
    vectors: DataFrame, threshold: float = THRESHOLD, anchors: int = ANCHORS, block: int = BLOCK
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` and ``component_id``.

    Vectors are linked if their cosine in double precision is at least ``threshold``; ``n_links``
    counts the other rows linked directly and ``component_id`` is the smallest vec_id reachable.
    Null and zero vectors, and those with null or non-finite components, are linked with nothing, as
    are vectors of different lengths with each other. Rows without a vec_id count as links of
    others; a component without any id has a null id. Repeated vectors and rows are linked with
    each other. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    reach = reach_of(threshold)
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(usable, vector).alias("vector"))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))  # -0.0 is 0.0
    rows = rows.withColumn("point", F.xxhash64(F.size("vector"), "vector"))
    points = cut_lineage(
        rows.where("vector is not null")
        .groupBy("point")
        .agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("size"))
    )
    lengths = [r[0] for r in points.select(F.size("vector")).distinct().collect()]  # dimensions in use
    found = spark.createDataFrame([], LINKS)
    for length in sorted(lengths):
        own = points.where(F.size("vector") == length)
        sample = own.orderBy(F.xxhash64("point")).limit(SAMPLE).select("vector").toArrow()
        cells = min(anchors, -(-own.count() // block))
        net = choose_anchors(unit(sample.column("vector")), cells)
        found = found.union(_cell_links(own, net, reach, threshold, block))
    found = cut_lineage(found)
    counts = found.groupBy("point").agg(F.sum("linked").alias("linked"))
    parts = components(found, "point", "other")
    per_point = (
        points.select("point", "size")
        .join(counts, "point", "left")
        .join(parts.withColumnRenamed("node", "point"), "point", "left")
        .select(
            "point",
            (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "point").alias("component"),
        )
    )
    marked = rows.where("vector is not null").select("vec_id", "point").join(per_point, "point")
    smallest = marked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = marked.join(smallest, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone)


def _cell_links(own: DataFrame, net: np.ndarray, reach: float, threshold: float, block: int) -> DataFrame:
    placed = own.withColumn("_p", _placing(net, reach)(F.col("vector")))
    placed = cut_lineage(
        placed.select(
            "point", "vector", "size",
            F.col("_p.cell").alias("cell"), F.col("_p.core").alias("core"), F.col("_p.visits").alias("visits"),
        )
    )
    # one row per cell: at most as many as there are anchors
    cells = cut_lineage(
        placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    )
    part = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    home = placed.join(F.broadcast(cells), "cell").withColumn("part", part)
    steps = F.sequence(F.lit(0), F.col("blocks") - 1)
    carried = ("point", "vector", "size", "core")
    # within a cell: each block with itself and with every other one, the lower block on the left
    inside = home.select(
        *carried, "cell", "part", F.explode(steps).alias("other")
    ).select(
        *carried,
        "cell",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        F.lit(0).alias("strip"),
    )
    # visitors meet every block of the cell; they come in strips of bounded size themselves
    calls = placed.select(*carried, F.explode("visits").alias("cell"))
    strips = cut_lineage(
        calls.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("strips"))
    )
    calls = calls.join(F.broadcast(cells), "cell").join(F.broadcast(strips), "cell")
    calls = calls.select(
        *carried,
        "cell",
        F.explode(steps).alias("low"),
        F.lit(-1).alias("high"),
        F.lit(1).alias("side"),
        F.pmod(F.xxhash64("point", F.lit(1)), F.col("strips")).cast("int").alias("strip"),
    )
    hosts = home.join(F.broadcast(strips), "cell").select(
        *carried,
        "cell",
        F.col("part").alias("low"),
        F.lit(-1).alias("high"),
        F.lit(0).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"),
    )
    groups = inside.unionByName(calls).unionByName(hosts)
    found = groups.groupBy("cell", "low", "high", "strip").applyInArrow(_block_pair(threshold), LINKS)
    # cores: everything in one is linked with everything else
    cores = placed.where("core").groupBy("cell").agg(
        F.sum("size").alias("_all"), F.min("point").alias("_first")
    )
    core = (
        placed.where("core")
        .join(F.broadcast(cores), "cell")
        .select("point", F.col("_first").alias("other"), (F.col("_all") - F.col("size")).alias("linked"))
    )
    return found.union(core)
