"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. Tokens flow from each pattern (first
use, then a dearer repetition) to the sources of the pattern, up to each source's quota; the cheapest
flow repeats as little as it can. The flow fixes how many tokens each pattern gives; which documents
give them is decided by a seeded hash: every document as often as all of them fit, then those below
a threshold of the hash once more, then a few that fill the remainder. The flow is solved one connected
group of sources at a time, each in a task; a source that no pattern shares is a group of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlens.llm.graph import components
from grantlens.llm.tables import cut_lineage
from grantlens.scaling import number_rows

WEIGHTS = (5.0, 2.0, 1.0)  # by code point of the source's name, repeating
SHARE = 1.5  # words of the mix against words of the input
MAX_USES = 2  # of one document
BUCKETS = 4096  # of the seeded hash
RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str = "text") -> F.Column:
    """Runs of characters other than the space and U+0009 to U+000D; null has none."""
    return F.coalesce(
        F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")
    )


def targets(
    sizes: dict[str | None, int],
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MAX_USES,
) -> dict[str | None, float]:
    """Words wanted of each source: by weight, none above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(
    tokens: Sequence[tuple[tuple, int]], quotas: dict, uses: int = MAX_USES
) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each of its sources, by cheapest augmenting paths.

    Using a pattern's tokens for the ``u``-th time costs 2u - 1 a token, so the marginal cost rises
    and a token is repeated only where nothing unrepeated reaches the quota.
    """
    sources = list(quotas)
    n = 2 + len(tokens) + len(sources)
    graph: list[list[_Arc]] = [[] for _ in range(n)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))

    place = {s: 2 + len(tokens) + i for i, s in enumerate(sources)}
    for i, (pattern, size) in enumerate(tokens):
        for use in range(1, uses + 1):
            arc(0, 2 + i, size, 2 * use - 1)
        for s in pattern:
            arc(2 + i, place[s], uses * size, 0)
    for s in sources:
        arc(place[s], 1, quotas[s], 0)
    while True:
        cost, came = [None] * n, [None] * n
        cost[0], queue, queued = 0, deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k, x in enumerate(graph[a]):
                if x.room > 0 and (cost[x.to] is None or cost[a] + x.cost < cost[x.to]):
                    cost[x.to], came[x.to] = cost[a] + x.cost, (a, k)
                    if x.to not in queued:
                        queued.add(x.to)
                        queue.append(x.to)
        if cost[1] is None:
            break
        path, at = [], 1
        while at:
            a, k = came[at]
            path.append(graph[a][k])
            at = a
        flow = min(x.room for x in path)
        for x in path:
            x.room -= flow
            graph[x.to][x.back].room += flow
    return {
        pattern: {
            s: graph[x.to][x.back].room
            for x in graph[2 + i]
            for s in pattern
            if x.to == place[s] and graph[x.to][x.back].room
        }
        for i, (pattern, _) in enumerate(tokens)
    }


def membership(docs: DataFrame, source: str) -> F.Column:
    """The sorted sources of a document; no source is a source of its own."""
    own = F.col(f"`{source}`")
    if isinstance(docs.schema[source].dataType, T.ArrayType):
        return F.array_sort(F.array_distinct(F.coalesce(own, F.array(F.lit(None).cast("string")))))
    return F.array(own.cast("string"))


def mix(
    docs: DataFrame,
    source: str = "source",
    size: F.Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = 7,
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``copies`` (0 to 2) and ``taken``.

    ``source`` is a string, or an array of strings where sources overlap; ``size`` defaults to the
    words of ``text``. Null sources are a source of their own (so is a null array). ``source_size`` and
    ``target`` add up over the sources of an overlapping document. A document's draw is a hash of its
    whole row; of rows equal in every column as many are used once more as fit. Empty documents have size 0
    and take nothing. Columns named like a result are replaced; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    size = word_count() if size is None else size
    hashable = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]).alias("_row"),
        membership(docs, source).alias("_pattern"),
        size.alias("_size"),
        F.xxhash64(F.lit(seed), *hashable).alias("_draw"),
    )
    rows = rows.withColumn("_name", _name(F.col("_pattern")))
    narrow = cut_lineage(rows.select("_name", "_pattern", "_size", "_draw"))
    sums = cut_lineage(narrow.groupBy("_name", "_pattern").agg(F.sum("_size").alias("words")))
    members = sums.select("_name", "words", F.posexplode("_pattern").alias("_at", "_source"))
    sizes = members.groupBy("_source").agg(F.sum("words").alias("size"))
    wanted = _targets(sizes, weights, share).withColumn("quota", F.bround("target").cast("long"))
    wanted = wanted.select(_name(F.array("_source")).alias("node"), "size", "target", "quota")
    members = members.withColumn("node", _name(F.array("_source"))).drop("_source")
    members = cut_lineage(members.join(wanted, "node"))
    known = members.groupBy("_name", "words").agg(
        F.sum("size").alias("source_size"), F.sum("target").alias("target")
    )
    known = cut_lineage(known.join(_flow(members), "_name"))
    # one row per pattern; null names cannot be joined on, hence the text key
    plan = cut_lineage(_choose(narrow, known))
    offers = plan.select("_name", F.inline("extra")).select("_name", F.col("draw").alias("_draw"), "rows")
    chosen = narrow.join(offers, ["_name", "_draw"]).groupBy("_name", "_draw", "rows").agg(F.count(F.lit(1)).alias("_n"))
    chosen = cut_lineage(chosen)  # at most 253 draws of a pattern
    partly = chosen.where("rows < _n").drop("_n")
    once_more = (F.col("_draw") < F.col("below")) | F.array_contains("extra.draw", F.col("_draw"))
    once_more = F.coalesce(once_more, F.lit(False)).cast("int")
    placed = rows.join(plan, "_name")
    if not partly.isEmpty():
        alike = _number_alike(placed.join(partly, ["_name", "_draw"]))
        whole = placed.join(partly, ["_name", "_draw"], "left_anti").withColumn("_more", once_more)
        placed = whole.unionByName(alike.withColumn("_more", (F.col("_at") <= F.col("rows")).cast("int")).drop("_at", "rows"))
    else:
        placed = placed.withColumn("_more", once_more)
    copies = (F.col("base") + F.col("_more")).alias("copies")
    return placed.select(
        "_row.*", F.col("_size").alias("size"), "source_size", "target", copies
    ).withColumn("taken", F.col("copies") * F.col("size"))


def _number_alike(rows: DataFrame, chunk: int = 1024) -> DataFrame:
    """Rows with equal (_name, _draw), which are equal in every column, numbered ``_at`` from 1.

    One of them stands for all with their number, merged on the map side, and is multiplied again in
    chunks that are dealt out, so a mass of equal rows never meets in a task.
    """
    others = [F.any_value(c).alias(c) for c in rows.columns if c not in ("_name", "_draw")]
    one = rows.groupBy("_name", "_draw").agg(F.count(F.lit(1)).alias("_n"), *others)
    starts = one.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(chunk).cast("long"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.least(F.col("_from") + chunk - 1, F.col("_n"))
    dealt = starts.repartition(parts, "_draw", "_from").withColumn("_at", F.explode(F.sequence("_from", upto)))
    return dealt.drop("_n", "_from")


def _name(pattern: F.Column) -> F.Column:
    return F.to_json(F.struct(pattern.alias("pattern")))


def _targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float = MAX_USES) -> DataFrame:
    """:func:`targets` for a table of (_source, size) of any length; one small aggregation a round."""
    ranked = number_rows(sizes, [F.col("_source").isNull(), F.col("_source")], "_rank")
    at = ((F.col("_rank") - 1) % len(weights) + 1).cast("int")
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at))
    ranked = cut_lineage(ranked)
    full, unit, before = F.lit(False), 0.0, -1
    while True:
        total, stopped, left, number = ranked.agg(
            F.sum("size"),
            F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)),
            F.sum(F.when(~full, F.col("_weight"))),
            F.count(F.when(full, 1)),
        ).first()
        if not left or number <= before:
            break
        unit, before = (share * total - most * stopped) / left, number
        full = F.col("_weight") * unit > most * F.col("size")
    target = F.when(full, F.col("size") * float(most)).otherwise(F.col("_weight") * unit)
    return ranked.select("_source", "size", target.alias("target"))


def _flow(members: DataFrame) -> DataFrame:
    """(_name, given) of every pattern, one connected group of sources a task."""
    wide = members.where("_at > 0").select("_name", F.col("node").alias("b"))
    links = members.where("_at = 0").select("_name", F.col("node").alias("a")).join(wide, "_name")
    grouped = members.join(components(links.select("a", "b")), "node", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    return grouped.select("component", "_name", "_at", "node", "words", "quota").groupBy("component").applyInArrow(
        _group_flow, "_name string, given long"
    )


def _group_flow(group: pa.Table) -> pa.Table:
    sources, words, quota = {}, {}, {}
    for r in group.sort_by([("_name", "ascending"), ("_at", "ascending")]).to_pylist():
        sources.setdefault(r["_name"], []).append(r["node"])
        words[r["_name"]] = r["words"]
        quota[r["node"]] = r["quota"]
    names = sorted(sources, key=sources.get)
    order = dict.fromkeys(s for n in names for s in sources[n])
    flow = min_cost_flow([(tuple(sources[n]), words[n]) for n in names], {s: quota[s] for s in order})
    given = [sum(flow[tuple(sources[n])].values()) for n in names]
    return pa.table({"_name": pa.array(names, pa.string()), "given": pa.array(given, pa.int64())})


def _choose(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each pattern: uses of every document, the draw below which one more, further draws."""
    some = F.col("words") > 0
    wanted = wanted.withColumn("base", F.when(some, F.expr("given div words")).otherwise(0).cast("int"))
    wanted = wanted.withColumn("_left", F.when(some, F.expr("given % words")).otherwise(0))
    left_rows = wanted.where("_left > 0").select("_name", "_left")
    draws = narrow.select("_name", "_size", "_draw").join(left_rows, "_name")
    # the high bits of the draw in order, as a signed number
    draws = draws.withColumn("_bucket", F.shiftright("_draw", 52))
    buckets = draws.groupBy("_name", "_left", "_bucket").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy("_name").orderBy("_bucket")  # at most BUCKETS rows of a pattern
    # the bucket in which the remainder ends is looked at row by row; it holds one of BUCKETS parts
    buckets = buckets.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum"))
    ends = buckets.where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_sum") > F.col("_left")))
    ends = cut_lineage(ends.select("_name", "_bucket", "_before"))  # one row per pattern
    edge = draws.join(ends, ["_name", "_bucket"]).groupBy("_name", "_left", "_before", "_draw", "_size").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    rank = Window.partitionBy("_name").orderBy("_draw").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("_size") * F.col("_rows")
    edge = edge.withColumn("_room", F.col("_left") - F.col("_before") - F.coalesce(F.sum(words).over(rank), F.lit(0)))
    # the first draw whose rows do not all fit, and how many of them do
    stop = F.min(F.struct("_draw", F.expr("_room div _size").alias("_fit"), "_size"))
    stops = edge.where((words > F.col("_room")) & (F.col("_room") >= 0)).groupBy("_name").agg(stop.alias("_stop"))
    stops = cut_lineage(
        stops.select("_name", F.col("_stop._draw").alias("_below"), "_stop._fit", F.col("_stop._size").alias("_stop_size"))
    )
    # what stays short of the target is filled from large documents to small, one of each size class (four to an octave)
    stopped = draws.join(stops, "_name")
    later = stopped.where((F.col("_draw") > F.col("_below")) & (F.col("_size") > 0))
    spare = later.groupBy("_name", F.floor(4 * F.log2("_size")).alias("_class")).agg(
        F.min(F.struct("_draw", "_size")).alias("_one")
    )
    one = F.struct("_class", F.col("_one._draw").alias("draw"), F.col("_one._size").cast("long").alias("words"))
    # at most 252 size classes of a pattern
    spare = spare.groupBy("_name").agg(F.sort_array(F.collect_list(one), asc=False).alias("_offered"))
    under = stopped.where(F.col("_draw") < F.col("_below")).groupBy("_name").agg(F.sum("_size").alias("_given"))
    plan = wanted.join(stops, "_name", "left").join(under, "_name", "left").join(spare, "_name", "left")
    short = (F.col("_left") - F.coalesce("_given", F.lit(0)) - F.coalesce(F.col("_fit") * F.col("_stop_size"), F.lit(0))).cast("long")
    none = F.array().cast("array<struct<draw:long,rows:long>>")
    first = F.when(
        F.col("_fit") > 0, F.array(F.struct(F.col("_below").alias("draw"), F.col("_fit").cast("long").alias("rows")))
    ).otherwise(none)

    def take(state, offer):
        fits = offer["words"] <= state["short"]
        return F.struct(
            F.when(fits, state["short"] - offer["words"]).otherwise(state["short"]).alias("short"),
            F.when(fits, F.concat(state["extra"], F.array(F.struct(offer["draw"].alias("draw"), F.lit(1).cast("long").alias("rows")))))
            .otherwise(state["extra"]).alias("extra"),
        )

    start = F.struct(short.alias("short"), first.alias("extra"))
    extra = F.coalesce(F.aggregate("_offered", start, take, lambda state: state["extra"]), first)
    below = F.coalesce("_below", F.lit(-(1 << 63)).cast("long"))
    return plan.select(
        "_name", "base", below.alias("below"), extra.alias("extra"), "source_size", "target"
    )


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as many times as it is used."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return mixed.where("copies > 0").select(F.explode(F.array_repeat(row, F.col("copies"))).alias("_row")).select("_row.*")
