"""Benchmark decontamination: broadcast windows of test words, scan training words, verify, remove.

The benchmark's windows (10 consecutive words of an item; items of fewer words are one window) are
hashed into sorted arrays. Training texts are hashed window by window in the tasks; a hit counts
after all its words' hashes have been compared. A benchmark beyond ``BLOCK_BYTES`` is cut into blocks
of items that fit, and the texts are scanned once per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.words import blocks, grams, mix64, words

WINDOW = 10
BLOCK_BYTES = 32 << 20  # of item texts broadcast at a time

HITS = "struct<n_words:long, spans:array<struct<first:int,end:int>>, items:array<string>>"
_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)
RESULTS = ("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")


def _runs(hashes: np.ndarray, m: int) -> np.ndarray:
    return mix64(hashes) if m == 1 else grams(hashes, m)


class WindowIndex:
    """Windows of a block of items: by length, sorted hashes with word hashes and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        column = pa.array([text for _, text in items], pa.string())
        rows: dict[int, list] = {}
        for block in blocks(column):
            found = words(block)
            for t in range(block.texts):
                own = found.hashes[found.bounds[t] : found.bounds[t + 1]]
                m = min(window, len(own))
                if not m:
                    continue
                runs = _runs(own, m)
                for i, h in enumerate(runs):
                    rows.setdefault(m, []).append((h, own[i : i + m], block.first + t))
        self.by_length = {}
        for m, found in rows.items():
            found.sort(key=lambda x: int(x[0]))
            hashes = np.array([x[0] for x in found], np.uint64)
            self.by_length[m] = (
                hashes,
                np.array([x[1] for x in found], np.uint64).reshape(len(found), m),
                np.array([x[2] for x in found], np.int64),
            )

    def hits(self, found) -> list[tuple[int, int, int, int]]:
        """(text, first word, end word, item) of every verified occurrence."""
        out = []
        for m, (hashes, exact, item) in self.by_length.items():
            runs = _runs(found.hashes, m)
            if not len(runs):
                continue
            at = np.searchsorted(hashes, runs)
            at[at == len(hashes)] = 0
            maybe = np.flatnonzero(
                (hashes[at] == runs) & (found.text[: len(runs)] == found.text[m - 1 :][: len(runs)])
            )
            for w in maybe:
                k = at[w]
                while k < len(hashes) and hashes[k] == runs[w]:
                    if np.array_equal(exact[k], found.hashes[w : w + m]):
                        out.append((int(found.text[w]), int(w), int(w) + m, int(item[k])))
                    k += 1
        return out


def _scan(index: WindowIndex):
    def scan(column: pa.Array) -> pa.Array:
        out = []
        for block in blocks(column):
            found = words(block)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for text, first, end, item in index.hits(found):
                spans.setdefault(text, []).append((first, end))
                if index.names[item] is not None:
                    items.setdefault(text, set()).add(index.names[item])
                else:
                    items.setdefault(text, set())
            counts = np.diff(found.bounds)
            for t in range(block.texts):
                merged: list[list[int]] = []
                for first, end in sorted(spans.get(t, [])):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([first, end])
                base = int(found.bounds[t])
                out.append(
                    {
                        "n_words": int(counts[t]),
                        "spans": [{"first": a - base, "end": b - base} for a, b in merged],
                        "items": sorted(items.get(t, ())),
                    }
                )
        return pa.array(out, _HITS)

    return F.arrow_udf(scan, HITS).asNondeterministic()  # so that it is never worked out twice


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks of at most about ``block_bytes``, by a hash of the item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    return [rows.where(part == p) for p in range(parts)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All rows with ``n_words``, ``n_hit``, ``hit_spans``, ``hit_items`` and ``contaminated``.

    ``hit_spans`` are merged runs of hit words (first, end) counted from 0; ``hit_items`` the sorted
    distinct item_ids as strings. Null and empty texts have no words and no hits; items with null or
    wordless text have no windows, and those without an id mark words but are not listed. Repeated
    items and documents are each looked at as they are. Columns named like a result are replaced.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    out = docs.select(
        F.struct(*own).alias("_row"), F.col("text").alias("_text"), F.lit(None).cast(HITS).alias("_hits")
    )
    for part in _item_blocks(benchmark, block_bytes):
        index = WindowIndex([tuple(r) for r in part.collect()], window)  # at most block_bytes of text
        out = out.withColumn("_now", _scan(index)(F.col("_text")))
        out = out.withColumn(
            "_hits",
            F.struct(
                F.col("_now.n_words").alias("n_words"),
                _union(F.col("_hits.spans"), F.col("_now.spans")).alias("spans"),
                F.array_sort(F.array_union(_or_empty("_hits.items", "array<string>"), F.col("_now.items"))).alias("items"),
            ),
        ).drop("_now")
    length = F.aggregate(
        "_hits.spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long")
    )
    return out.select(
        "_row.*",
        F.col("_hits.n_words").alias("n_words"),
        length.alias("n_hit"),
        F.col("_hits.spans").alias("hit_spans"),
        F.col("_hits.items").alias("hit_items"),
        (F.size("_hits.spans") > 0).alias("contaminated"),
    )


def _or_empty(name: str, kind: str) -> F.Column:
    return F.coalesce(F.col(name), F.array().cast(kind))


def _union(a: F.Column, b: F.Column) -> F.Column:
    """Spans of both, overlapping or touching ones merged."""
    kind = "array<struct<first:int,end:int>>"
    both = F.array_sort(F.concat(F.coalesce(a, F.array().cast(kind)), b))
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, s):
        wider = F.struct(
            last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], s["end"]).alias("end")
        )
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["first"])
        return F.when(F.size(acc) == 0, F.array(s)).when(touches, joined).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(both, F.array().cast(kind), add)
    return F.when(a.isNull() | (F.size(a) == 0), b).when(F.size(b) == 0, a).otherwise(merged)


def remove_documents(found: DataFrame) -> DataFrame:
    """Rows of :func:`find_contamination` that hold no benchmark window."""
    return found.where(~F.col("contaminated")).drop(*RESULTS)


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    out: list[str | None] = []
    column = spans.to_pylist()
    valid = text.is_valid().to_pylist()
    for block in blocks(text):
        found = words(block)
        for t in range(block.texts):
            row = block.first + t
            if not valid[row]:
                out.append(None)
                continue
            at, kept = int(block.offsets[t]), []
            for s in column[row] or []:
                base = found.bounds[t]
                kept.append(block.data[at : found.start[base + s["first"]]].tobytes())
                at = int(found.end[base + s["end"] - 1])
            kept.append(block.data[at : block.offsets[t + 1]].tobytes())
            out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def remove_spans(found: DataFrame) -> DataFrame:
    """Rows of :func:`find_contamination` with the hit words cut out of their texts."""
    cut = F.arrow_udf(_cut, "string")
    return found.withColumn("text", cut(F.col("text"), F.col("hit_spans"))).drop(*RESULTS)
