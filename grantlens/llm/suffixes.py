"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes (from a word to the end of its text) are kept only where a minimiser stands: the least hash
of ``KEY`` neighbouring words among those of ``LENGTH`` words. Every run of ``LENGTH`` words holds such
a position, and equal runs hold the same ones. Suffixes whose first ``KEY`` words occur in one text
only are dropped; the others are sorted by their words, neighbours are compared for the length of
their common prefix, and matches are extended to the left. A word is repeated if it lies in a run of
``LENGTH`` words that occurs in another document, whose text may be equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.words import blocks, grams, mix64, words
from grantlens.llm.tables import cut_lineage, discard

LENGTH = 50  # words of the shortest passage
KEY = 10  # words that suffixes are first matched by
GROUP = 20_000  # suffixes sorted in one piece; more that begin alike are told apart by more words first

_U64 = np.uint64


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every window of ``size`` values."""
    out, span = values, 1
    while 2 * span <= size:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(hashes: np.ndarray, text: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash of ``key`` words is least in some run of ``length`` words, and the hashes."""
    window = length - key + 1
    runs = grams(hashes, key)
    if len(runs) < window:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    runs = np.maximum(runs, _U64(1))
    least = _sliding(runs, window, np.minimum)
    inside = text[: len(least)] == text[length - 1 :][: len(least)]
    least = np.where(inside, least, _U64(0))  # windows that leave their text choose nothing
    padded = np.concatenate((np.zeros(window - 1, _U64), least, np.zeros(window - 1, _U64)))
    chosen = _sliding(padded, window, np.maximum) == runs
    at = np.flatnonzero(chosen)
    return at, runs[at]


def _suffixes(length: int, key: int):
    def find(column: pa.Array) -> pa.Array:
        sizes, positions, keys = [], [], []
        for block in blocks(column):
            found = words(block)
            at, hashes = minimisers(found.hashes, found.text, length, key)
            sizes.append(np.bincount(found.text[at], minlength=block.texts))
            positions.append(at - found.bounds[found.text[at]])
            keys.append(hashes.view(np.int64))
        if not sizes:
            return pa.array([], pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64())])))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        rows = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(positions), pa.int32()), pa.array(np.concatenate(keys), pa.int64())],
            ["pos", "key"],
        )
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return F.arrow_udf(find, "array<struct<pos:int,key:long>>").asNondeterministic()


CONTEXT = "struct<pos:int,key:long,left:binary,right:binary>"


def _contexts(length: int, key: int):
    """The words around given positions, as 32-bit hashes, nearest first."""

    def find(column: pa.Array, asked: pa.Array) -> pa.Array:
        out, asked = [], asked.to_pylist()
        for block in blocks(column):
            found = words(block)
            short = (found.hashes >> _U64(32)).astype(">u4")
            for t in range(block.texts):
                lo, hi = found.bounds[t], found.bounds[t + 1]
                out.append(
                    [
                        {
                            "pos": x["pos"],
                            "key": x["key"],
                            "left": short[max(lo, lo + x["pos"] - (length - key)) : lo + x["pos"]][::-1].tobytes(),
                            "right": short[lo + x["pos"] : min(hi, lo + x["pos"] + length)].tobytes(),
                        }
                        for x in asked[block.first + t]
                    ]
                )
        kind = pa.struct(
            [("pos", pa.int32()), ("key", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]
        )
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(find, f"array<{CONTEXT}>").asNondeterministic()


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit words of a binary column as rows of ``width``, zeros at the end, and their numbers."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // 4
    flat = np.frombuffer(data, ">u4") if data is not None else np.zeros(0, ">u4")
    n = np.diff(ends)
    out = np.zeros((len(column), width), np.uint32)
    row = np.repeat(np.arange(len(column)), n)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], n)] = flat[ends[0] : ends[-1]]
    return out, n


def _prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2 .. words of each row."""
    out = np.zeros((len(matrix), matrix.shape[1] + 1), _U64)
    for j in range(matrix.shape[1]):
        out[:, j + 1] = mix64(out[:, j] * _U64(0x9E3779B97F4A7C15) + matrix[:, j] + _U64(1))
    return out


def _in_two_texts(group: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """Which rows are in a group whose rows, of texts ``least`` to ``greatest``, are of two texts."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    starts = np.flatnonzero(first)
    several = np.minimum.reduceat(least[order], starts) != np.maximum.reduceat(greatest[order], starts)
    out = np.zeros(len(g), bool)
    out[order] = several[np.cumsum(first) - 1]
    return out


MATCHED = "key long, context long, least int, most int"


def _match(length: int, key: int):
    """For the suffixes of one piece, how far the shortest and the longest match reach to the right."""

    def match(piece: pa.Table) -> pa.Table:
        group = piece.column("group").to_numpy()
        right, n_right = _matrix(piece.column("right").combine_chunks(), length)
        left, n_left = _matrix(piece.column("left").combine_chunks(), length - key)
        # the suffix array: by group, then word by word
        spelled = np.ascontiguousarray(right.astype(">u4")).view(f"S{4 * length}").ravel()
        order = np.lexsort((spelled, group))
        own = {c: piece.column(c).to_numpy()[order] for c in ("key", "context", "a", "b", "lo", "hi")}
        group, right, n_right, left, n_left = group[order], right[order], n_right[order], left[order], n_left[order]
        # words that neighbours have in common
        same = right[1:] == right[:-1]
        common = np.where(same.all(axis=1), length, (~same).argmax(axis=1))
        common = np.minimum(common, np.minimum(n_right[1:], n_right[:-1]))
        common[group[1:] != group[:-1]] = 0
        extended = _prefix_hashes(left)
        least, most = np.full(len(group), length + 1), np.full(len(group), -1)
        for r in range(key, length + 1):
            before = length - r
            fits = np.flatnonzero((n_right >= r) & (n_left >= before) & (own["lo"] <= r) & (r <= own["hi"]))
            if not len(fits):
                continue
            run = np.concatenate(([0], np.cumsum(common < r)))
            alike = mix64(extended[fits, before] + run[fits].astype(_U64) * _U64(0xD6E8FEB86659FD93))
            hit = fits[_in_two_texts(alike, own["a"][fits], own["b"][fits])]
            least[hit] = np.minimum(least[hit], r)
            most[hit] = np.maximum(most[hit], r)
        some = most >= 0
        return pa.table(
            {
                "key": pa.array(own["key"][some], pa.int64()),
                "context": pa.array(own["context"][some], pa.int64()),
                "least": pa.array(least[some], pa.int32()),
                "most": pa.array(most[some], pa.int32()),
            }
        )

    return match


def _matches(contexts: DataFrame, length: int, key: int, most: int) -> DataFrame:
    """(key, context, least, most) of the contexts that hold a run of ``length`` words of another text.

    ``contexts`` has (key, context, left, right, a, b), ``a`` and ``b`` the least and the greatest text.
    A group is to be matched for runs that reach ``lo`` to ``hi`` words to the right: its members have
    the first ``lo`` words of that side in common, and ``length - hi`` of the other. A group too large to
    be sorted in one piece falls in two by halving that range, which adds words to what members share;
    where it is down to one length the group is a run itself, and counting its texts is enough.
    """
    right = F.substring(F.col("right"), F.lit(1), 4 * F.col("lo"))
    left = F.substring(F.col("left"), F.lit(1), 4 * (length - F.col("hi")))
    shared = F.xxhash64("key", "lo", "hi", right, left)
    level = contexts.select(
        "*", F.lit(key).alias("lo"), F.lit(length).alias("hi"), F.xxhash64("key").alias("group")
    )
    found = []
    while True:
        sizes = level.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > most).select("group"))
        pieces = max(1, -(-level.count() // most))
        piece = F.pmod(F.xxhash64("group"), F.lit(pieces)).alias("piece")
        small = level.join(large, "group", "left_anti")
        found.append(cut_lineage(small.groupBy(piece).applyInArrow(_match(length, key), MATCHED)))
        if large.isEmpty():
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(
            F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi"))
        )
        halved = level.join(large, "group", "left_semi").withColumn("_half", F.explode(halves))
        halved = halved.select("key", "context", "left", "right", "a", "b", "_half.lo", "_half.hi")
        fits = (F.length("right") >= 4 * F.col("lo")) & (F.length("left") >= 4 * (length - F.col("hi")))
        halved = cut_lineage(halved.where(fits).withColumn("group", shared))
        runs = halved.where("lo = hi")
        repeated = runs.groupBy("group").agg(F.min("a").alias("_a"), F.max("b").alias("_b")).where("_a != _b")
        found.append(
            runs.join(repeated.select("group"), "group", "left_semi").select(
                "key", "context", F.col("lo").alias("least"), F.col("hi").alias("most")
            )
        )
        level = halved.where("lo < hi")
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.groupBy("key", "context").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def find_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_repeated``, ``spans``, ``repeated``.

    ``spans`` are merged runs of words (first, end; counted from 0) that lie in a passage of
    ``length`` words found in another document too; ``n_repeated`` counts their words. Repeats within
    one text alone do not count. Null and empty texts, and those of fewer words, have no spans. Rows
    with equal text count as different documents, whatever their ids. Texts are told apart by a 64-bit
    hash. An empty table gives an empty one. ``group`` bounds the suffixes that are sorted in one task.
    """
    docs = docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"))
    texts = docs.where("text is not null")
    found = texts.select("node", _suffixes(length, key)(F.col("text")).alias("s"))
    # equal texts have equal suffixes: one row for each text
    kept = found.where(F.size("s") > 0).groupBy("node").agg(F.any_value("s").alias("s"))
    suffixes = cut_lineage(kept.select("node", F.inline("s")))
    shared = suffixes.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"))
    wanted = suffixes.join(shared.where("_a != _b").select("key"), "key")
    asked = cut_lineage(
        wanted.groupBy("node").agg(F.collect_list(F.struct("pos", "key")).alias("asked"))
    )  # a text's own positions
    discard(suffixes)
    # texts are dealt out by their hash at any size: the nodes grow with the input
    one = texts.select("node", "text").join(asked.select("node").hint("merge"), "node", "left_semi")
    one = one.groupBy("node").agg(F.any_value("text").alias("text"))
    around = one.join(asked, "node").select(
        "node", F.explode(_contexts(length, key)(F.col("text"), F.col("asked"))).alias("c")
    )
    around = around.select("node", "c.*")
    around = cut_lineage(around.withColumn("context", F.xxhash64("left", "right")))
    discard(asked)
    contexts = cut_lineage(
        around.groupBy("key", "context", "left", "right").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    )
    matches = cut_lineage(_matches(contexts, length, key, group))
    discard(contexts)
    spans = cut_lineage(
        around.select("node", "pos", "key", "context")
        .join(matches, ["key", "context"])
        .select(
            "node",
            (F.col("pos") - (length - F.col("least"))).cast("int").alias("first"),
            (F.col("pos") + F.col("most")).cast("int").alias("end"),
        )
    )
    discard(around, matches)
    by_text = spans.groupBy("node").agg(
        F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans")
    )
    copies = docs.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    own = docs.select("doc_id", "node", F.coalesce(_word_number(F.col("text")), F.lit(0)).alias("n_words"))
    own = own.join(by_text, "node", "left").join(copies.where("copies > 1"), "node", "left")
    kind = "array<struct<first:int,end:int>>"
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))
    is_copy = F.col("node").isNotNull() & (F.col("copies") > 1) & (F.col("n_words") >= length)
    merged = F.when(is_copy, whole).otherwise(_merged(F.coalesce("spans", F.array().cast(kind))))
    out = own.select("doc_id", F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long"))
    return out.select("doc_id", "n_words", total.alias("n_repeated"), "spans", (F.size("spans") > 0).alias("repeated"))


def _word_number(text: F.Column) -> F.Column:
    return F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))


def _merged(spans: F.Column) -> F.Column:
    """Sorted spans with those that touch or overlap made one."""

    def merge(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            own: list[dict] = []
            for s in row or []:
                if own and s["first"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], s["end"])
                else:
                    own.append(dict(s))
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(merge, "array<struct<first:int,end:int>>").asNondeterministic()(spans)
