"""Near-duplicate documents by DartMinHash signatures and banded joining.

Every element (a word shingle with its weight) owns a strip of the plane weight x rank. A fixed
random process throws darts on the plane, one per unit area on average, and only darts that land
under the element's weight and early enough count. Each dart has a coordinate; a text keeps the
earliest dart of each coordinate. Two texts agree in a coordinate with the probability of their
(weighted) Jaccard similarity, and the work for a text depends on its elements and the number of
coordinates only by their sum.

Bands of coordinates put texts in buckets. Buckets are first joined to one member each, which is
verified exactly; what is linked then falls into components. Members of other components of a bucket
are compared with the whole bucket, in strips against blocks and strips, so that no link is lost and
no bucket is written out as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.graph import components
from grantlens.llm.words import Block, blocks, mix64, shingles, words
from grantlens.llm.tables import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 30
ROWS = 5  # coordinates of a band; 30 bands of 5 miss one pair in 150,000 at similarity 0.8
STAR_ROUNDS = 2
BLOCK_SHINGLES = 1 << 20  # of one block of a bucket
SCAN_BYTES = 1 << 18

_U64 = np.uint64
# Poisson distribution with mean 1: chance of at most k darts in a unit cell
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U64(11)).astype(np.float64) * 2.0**-53


def elements(block: Block, n: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their texts (in order) and weights: 1, or how often they occur."""
    hashes, text = shingles(words(block), n)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(hashes))).astype(np.float64)
    return hashes[first], text[first], counts if weighted else np.ones(len(first))


def _repeat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the repeated item, and the number of the repetition, for each repetition."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def dart_signatures(
    hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, texts: int, k: int
) -> np.ndarray:
    """Signatures (texts x k) of weighted elements; texts without elements keep zeros."""
    out = np.zeros((texts, k), _U64)
    total = np.bincount(text, weights=weights, minlength=texts)
    # so many darts are expected in all that hardly a coordinate stays empty
    latest = np.where(total > 0, k * (np.log(k) + 4) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[text])
        cells_w = np.ceil(weights[own]).astype(np.int64)
        cells_r = np.ceil(latest[text[own]]).astype(np.int64)
        owner, cell = _repeat(cells_w * cells_r)
        w_cell, r_cell = cell // cells_r[owner], cell % cells_r[owner]
        element = own[owner]
        seed = mix64(
            hashes[element]
            + w_cell.astype(_U64) * _U64(0x9E3779B97F4A7C15)
            + r_cell.astype(_U64) * _U64(0xC2B2AE3D27D4EB4F)
            + _U64(1)
        )
        thrown, nth = _repeat(np.searchsorted(_POISSON, _uniform(seed)))
        dart = mix64(seed[thrown] + (nth.astype(_U64) + _U64(1)) * _U64(0x165667B19E3779F9))
        at_weight = w_cell[thrown] + _uniform(mix64(dart + _U64(1)))
        rank = r_cell[thrown] + _uniform(mix64(dart + _U64(2)))
        element = element[thrown]
        lands = (at_weight < weights[element]) & (rank < latest[text[element]])
        dart, rank, owner = dart[lands], rank[lands], text[element[lands]]
        place = owner * k + (mix64(dart + _U64(3)) % _U64(k)).astype(np.int64)
        order = np.lexsort((rank, place))
        place, dart = place[order], dart[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        filled = np.bincount(place[first] // k, minlength=texts) == k
        done = filled[place // k] & first
        out.reshape(-1)[place[done]] = dart[done]
        todo &= ~filled
        latest[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key * _U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _bands(n: int, bands: int, rows: int, weighted: bool):
    def keys(column: pa.Array) -> pa.Array:
        out = []
        for block in blocks(column, SCAN_BYTES):
            hashes, text, weights = elements(block, n, weighted)
            signed = band_keys(
                dart_signatures(hashes, text, weights, block.texts, bands * rows), bands, rows
            )
            some = np.bincount(text, minlength=block.texts) > 0
            ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(signed[some].reshape(-1))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(keys, "array<long>").asNondeterministic()


def _pair_similarity(n: int, weighted: bool):
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left))
        at = 0
        while at < len(left):  # a few thousand pairs' worth of text at a time
            stop = min(len(left), at + 64)
            both = pa.concat_arrays([left[at:stop].cast(pa.large_string()), right[at:stop].cast(pa.large_string())])
            (block,) = blocks(both, 1 << 62)
            hashes, text, weights = elements(block, n, weighted)
            half = stop - at
            pair = text % half
            order = np.lexsort((hashes, pair))
            h, p, w = hashes[order], pair[order], weights[order]
            twice = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
            common = np.bincount(p[1:][twice], weights=np.minimum(w[1:], w[:-1])[twice], minlength=half)
            total = np.bincount(pair, weights=weights, minlength=half) - common
            out[at:stop] = np.where(total > 0, common / np.maximum(total, 1e-300), 0.0)
            at = stop
        return pa.array(out)

    return F.arrow_udf(similarity, "double").asNondeterministic()


def _block_links(n: int, weighted: bool, threshold: float):
    """Links of the texts of a group that ask to those that answer, in other components."""

    def links(group: pa.Table) -> pa.Table:
        column = group.column("text").combine_chunks()
        node = group.column("node").to_numpy()
        part = group.column("component").to_numpy()
        asks = np.flatnonzero(group.column("asks").to_numpy(zero_copy_only=False))
        answers = group.column("answers").to_numpy(zero_copy_only=False)
        sets = [elements(block, n, weighted) for block in blocks(column)]
        firsts = [block.first for block in blocks(column)]
        hashes = np.concatenate([s[0] for s in sets])
        owner = np.concatenate([s[1] + f for s, f in zip(sets, firsts, strict=True)])
        weights = np.concatenate([s[2] for s in sets])
        _, number = np.unique(hashes, return_inverse=True)
        bounds = np.searchsorted(owner, np.arange(len(node) + 1))
        total = np.bincount(owner, weights=weights, minlength=len(node))
        # where each shingle occurs among the texts that answer
        place = np.flatnonzero(answers[owner])
        place = place[np.argsort(number[place], kind="stable")]
        begin = np.searchsorted(number[place], np.arange(number.max() + 2 if len(number) else 1))
        a, b = [], []
        for u in asks:
            own = np.arange(bounds[u], bounds[u + 1])
            low = begin[number[own]]
            mine, nth = _repeat(begin[number[own] + 1] - low)
            met = place[low[mine] + nth]
            shared = np.minimum(weights[own][mine], weights[met])
            common = np.bincount(owner[met], weights=shared, minlength=len(node))
            near = common >= threshold * (total + total[u] - common) - 1e-9
            near &= answers & (part != part[u])
            _, one = np.unique(part[near], return_index=True)  # one link for each component is enough
            to = node[near][one]
            a.extend([node[u]] * len(to))
            b.extend(to.tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _text_hash() -> F.Column:
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def _one_text(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, bytes) of the given nodes, one row each, written once for all that follows.

    Texts are dealt out by their hash for this, at any size: the nodes grow with the input.
    """
    rows = docs.select("node", "text").join(nodes.distinct().hint("merge"), "node", "left_semi")
    texts = rows.groupBy("node").agg(F.any_value("text").alias("text"))
    return cut_lineage(texts.withColumn("bytes", F.octet_length("text")))


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    weighted: bool = False,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``class_id`` (smallest id of its class), ``kept``.

    Documents are linked if the Jaccard similarity of their shingles (weighted by their counts on
    request) is at least ``threshold``, or if their texts are equal; classes are what links connect.
    A text of fewer words than a shingle is one shingle. Texts without words, empty ones among them,
    are linked to equal texts only. A null text is alone in its class. Rows without an id belong to
    the class of their text; a class without any id has a null ``class_id``. Of rows that repeat id
    and text every copy is ``kept`` or none; :func:`keep_one` leaves one. Texts are told apart by a
    64-bit hash. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text", _text_hash().alias("node"))
    keys = _bands(shingle, bands, rows, weighted)
    signed = (
        docs.where("text is not null")
        .select("node", keys(F.col("text")).alias("keys"))
        .groupBy("node")
        .agg(F.any_value("keys").alias("keys"))
    )
    banded = cut_lineage(signed.select("node", F.explode("keys").alias("key")))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = cut_lineage(banded.join(shared, "key"))
    texts = _one_text(docs, live.select("node"))
    first = live.withColumn("component", F.col("node"))
    links = cut_lineage(_star_links(texts, first, 0, shingle, weighted, threshold))
    for turn in range(1, STAR_ROUNDS + 1):
        parts = components(links)
        placed = live.where("members > 2").join(
            parts.withColumnRenamed("component", "_part"), "node", "left"
        )
        placed = cut_lineage(
            placed.select("key", "node", "members", F.coalesce("_part", "node").alias("component"))
        )
        if turn < STAR_ROUNDS:
            more = _star_links(texts, placed, turn, shingle, weighted, threshold)
        else:
            more = _remaining_links(texts, placed, shingle, weighted, threshold)
        links = cut_lineage(links.union(more))
    parts = components(links)
    members = docs.select("doc_id", "node").join(parts, "node", "left")
    members = members.select(
        "doc_id", F.col("node").alias("text_hash"), F.coalesce("component", "node").alias("component")
    )
    classes = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    found = members.join(classes, "component", "left")
    class_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select(
        "doc_id",
        "text_hash",
        class_id.alias("class_id"),
        F.col("doc_id").eqNullSafe(class_id).alias("kept"),
    )


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    return (
        placed.groupBy("key")
        .agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
        .where("_least != _most")
        .select("key")
    )


def _star_links(
    texts: DataFrame, placed: DataFrame, turn: int, shingle: int, weighted: bool, threshold: float
) -> DataFrame:
    """Verified links from members of a bucket to one of them, where they are not yet connected."""
    draw = F.xxhash64("node", "key", F.lit(turn))
    centres = placed.groupBy("key").agg(F.min(F.struct(draw.alias("_d"), "node", "component")).alias("_c"))
    pairs = (
        placed.join(centres.where(F.col("_c").isNotNull()), "key")
        .where(F.col("component") != F.col("_c.component"))
        .select(F.least("node", "_c.node").alias("a"), F.greatest("node", "_c.node").alias("b"))
        .distinct()
    )
    pairs = cut_lineage(pairs)
    texts = texts.select("node", "text")
    compared = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    alike = _pair_similarity(shingle, weighted)(F.col("left"), F.col("right"))
    return compared.select("a", "b", alike.alias("s")).where(F.col("s") >= threshold - 1e-12).select("a", "b")


def _remaining_links(
    texts: DataFrame, placed: DataFrame, shingle: int, weighted: bool, threshold: float
) -> DataFrame:
    """Links between the components that still share a bucket.

    The members of a bucket's largest component are dealt out in blocks, all others (strangers) in
    strips, both of bounded volume. Each strip is compared with each block and each other strip, and
    with itself beside block 0: every pair meets in one group, and no group grows with the bucket.
    """
    placed = placed.join(_mixed_buckets(placed), "key")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("_main"))
    rows = placed.select("key", "node", "component").join(main, "key")
    rows = rows.withColumn("stranger", F.col("component") != F.col("_main"))
    # the volume decides on the number of blocks and strips; each holds about BLOCK_SHINGLES shingles
    rows = rows.join(texts.select("node", "bytes"), "node")

    def parts(stranger: bool) -> F.Column:
        volume = F.sum(F.when(F.col("stranger") == stranger, F.col("bytes")))
        return F.greatest(F.ceil(volume / (6 * BLOCK_SHINGLES)).cast("int"), F.lit(1))

    counts = rows.groupBy("key").agg(parts(False).alias("_blocks"), parts(True).alias("_strips"))
    strips = F.when(F.col("stranger"), F.col("_strips")).otherwise(F.col("_blocks"))
    rows = rows.join(counts, "key").withColumn("_own", F.pmod(F.xxhash64("node"), strips).cast("int"))
    own, yes, no = F.col("_own"), F.lit(True), F.lit(False)

    def meet(strip: F.Column, other: F.Column, asks: F.Column, answers: F.Column) -> F.Column:
        return F.struct(strip.alias("strip"), other.alias("other"), asks.alias("asks"), answers.alias("answers"))

    # a group is a strip and a block, or two strips (the later one as a negative number)
    of_block = F.transform(
        F.sequence(F.lit(0), F.col("_strips") - 1), lambda s: meet(s, own, no, yes)
    )
    of_strip = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: meet(own, b, yes, b == 0)),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("_strips") - 1), lambda s: s != own),
            lambda s: meet(F.least(s, own), -F.greatest(s, own), own < s, own > s),
        ),
    )
    met = rows.select(
        "key", "node", "component", F.explode(F.when(F.col("stranger"), of_strip).otherwise(of_block)).alias("_m")
    )
    dealt = met.select("key", "node", "component", "_m.*").join(texts.select("node", "text"), "node")
    return dealt.groupBy("key", "strip", "other").applyInArrow(
        _block_links(shingle, weighted, threshold), "a long, b long"
    )


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class of :func:`near_duplicates`."""
    kept = found.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count(F.lit(1)).alias("_times")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & _text_hash().eqNullSafe(F.col("_hash"))
    marked = rows.join(kept, same)
    once = marked.where("_times = 1").select("_row.*")
    several = marked.where("_times > 1").dropDuplicates(["doc_id", "text"]).select("_row.*")
    return once.union(several)
