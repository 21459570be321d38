"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed counts of its words, of its tokens' shapes (runs of capitals, small
letters and digits, signs as they are) and of how tokens repeat. A bounded sample of labelled texts is
weighted by inverse document frequency and reduced to latent dimensions; its vectors are broadcast.
Every text is projected and compared with all of them, a block of texts at a time; the nearest vote
with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.words import Block, blocks, mix64, powers, words

SAMPLE = 1500  # labelled texts of each label, about; bounds what is broadcast
WORD_BINS, SHAPE_BINS, REPEAT_BINS = 2048, 1024, 8
GROUP_WEIGHTS = (0.5, 1.0, 1.0)  # words, shapes, repeats
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 4  # power of the similarity in a vote
SCAN_BYTES = 1 << 18

BINS = WORD_BINS + SHAPE_BINS + REPEAT_BINS

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# shape of a byte: capitals, small letters (with all beyond ASCII) and digits by kind, signs as they are
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:], _SHAPE[0x30:0x3A] = 1, 2, 2, 3


def _tokens(block: Block):
    """Start, end and text of each run of other characters than white space."""
    inside = ~_SPACE[block.data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = block.offsets[:-1]
    begins = begins[begins < len(inside)]
    starts[begins] = inside[begins]
    ends = np.zeros(len(inside) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:] | starts[1:]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(block.offsets, start, side="right") - 1


def _run_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.append(first, len(values)))
    within = np.arange(len(values)) - np.repeat(first, lengths)
    h = (values.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[within]
    return mix64(np.add.reduceat(h, first) + lengths.astype(np.uint64))


def features(block: Block) -> np.ndarray:
    """Counts of a block's texts in ``BINS`` bins: words, shapes, repeats."""
    out = np.zeros((block.texts, BINS), np.float32)
    found = words(block)
    n = block.texts

    def count(bins: np.ndarray, text: np.ndarray, size: int, at: int) -> None:
        own = np.bincount(text * size + bins, minlength=n * size).reshape(n, size)
        out[:, at : at + size] += own

    count((found.hashes % np.uint64(WORD_BINS)).astype(np.int64), found.text, WORD_BINS, 0)
    start, end, text = _tokens(block)
    if len(start):
        shape = _SHAPE[block.data]
        inside = ~_SPACE[block.data]
        token = np.zeros(len(shape), bool)
        token[start] = True
        kept = inside.copy()
        kept[1:] &= (shape[1:] != shape[:-1]) | (shape[1:] > 3) | token[1:]
        first = (np.cumsum(kept) - 1)[start]
        shapes = _run_hashes(shape[kept], first)
        count((shapes % np.uint64(SHAPE_BINS)).astype(np.int64), text, SHAPE_BINS, WORD_BINS)
        raw = _run_hashes(block.data[inside], (np.cumsum(inside) - 1)[start])
        # a token is like none, like the last, the last but one or the one before that
        near = np.zeros(len(raw), np.int64)
        for back in (3, 2, 1):
            same = np.zeros(len(raw), bool)
            same[back:] = (raw[back:] == raw[:-back]) & (text[back:] == text[:-back])
            near[same] = back
        count(near, text, REPEAT_BINS, WORD_BINS + SHAPE_BINS)
    return out


@dataclass
class NeighbourModel:
    """Latent vectors of labelled texts, and how to project others."""

    weight: np.ndarray  # inverse document frequency of each bin
    axes: np.ndarray  # bins x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, of length 1
    votes: np.ndarray  # vote for each label (texts x 2), corrected for how labels were sampled
    prior: float  # share of label 1

    @staticmethod
    def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * weight
        at = 0
        for size, share in zip((WORD_BINS, SHAPE_BINS, REPEAT_BINS), GROUP_WEIGHTS, strict=True):
            part = x[:, at : at + size]
            part *= share / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
            at += size
        return x

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, shares: tuple[float, float]) -> NeighbourModel:
        """``shares``: how large a part of all rows of label 0 and 1 the texts are."""
        counts = np.concatenate([features(b) for b in blocks(pa.array(texts, pa.string()), SCAN_BYTES)])
        df = (counts > 0).sum(axis=0)
        weight = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        x = cls.weighted(counts, weight)
        k = min(DIMENSIONS, *x.shape)
        basis = np.random.default_rng(11).standard_normal((x.shape[1], k + 8)).astype(np.float32)
        for _ in range(3):  # subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        axes = (basis @ turn.T)[:, :k].astype(np.float32)
        vectors = x @ axes
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        rows = np.array([(labels == y).sum() / max(shares[y], 1e-9) for y in (0, 1)])
        votes = np.zeros((len(labels), 2))
        for y in (0, 1):
            votes[labels == y, y] = 1 / max(shares[y], 1e-9)
        return cls(weight, axes, vectors, votes / votes.max(), float(rows[1] / rows.sum()))

    def score(self, column: pa.Array) -> pa.Array:
        out = []
        for block in blocks(column, SCAN_BYTES):
            x = self.weighted(features(block), self.weight) @ self.axes
            length = np.linalg.norm(x, axis=1)
            x /= np.maximum(length, 1e-9)[:, None]
            for at in range(0, len(x), 256):
                near = x[at : at + 256] @ self.vectors.T
                k = min(NEIGHBOURS, near.shape[1])
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0) ** SHARPNESS
                both = np.einsum("tk,tkl->tl", weight, self.votes[top])
                total = both.sum(axis=1)
                share = both[:, 1] / np.maximum(total, 1e-300)
                known = (total > 1e-12) & (length[at : at + 256] > 0)
                out.append(np.where(known, share, self.prior))
        scores = np.concatenate(out) if out else np.zeros(0)
        return pa.array(np.clip(scores.astype(np.float64), 0.0, 1.0))


def train(
    docs: DataFrame, labels: DataFrame, training: F.Column | None = None, sample: int = SAMPLE
) -> NeighbourModel | None:
    """Model of ``labels.quality`` (0 or 1) from documents where ``training`` holds.

    At most about ``sample`` texts of each label are used, chosen by a hash of the doc_id. Null texts,
    ids and labels are left out; of several labels of a document the lowest counts. Without any
    labelled text there is no model.
    """
    training = F.lit(True) if training is None else training
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where(training)
    )
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not totals:
        return None
    shares = tuple(min(1.0, sample / totals[y]) if y in totals else 1.0 for y in (0, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))
    limit = F.when(F.col("quality") == 1, shares[1]).otherwise(shares[0]) * (1 << 20)
    chosen = known.where(draw < limit)  # about twice `sample` ids, whatever the input
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(chosen), "doc_id")  # ids only, bounded by the sample
        .select("doc_id", "text", "quality")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    quality = np.array([r["quality"] for r in rows])
    return NeighbourModel.fit([r["text"] for r in rows], quality, shares)


def score(docs: DataFrame, model: NeighbourModel | None) -> DataFrame:
    """All rows with ``quality_score`` (0 to 1, higher is better).

    Null, empty and blank texts, and those unlike all labelled ones, get the share of label 1 among
    the labelled rows; without a model every score is 0.5. A column of that name is replaced.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != "quality_score"]
    if model is None:
        return docs.select(*own, F.lit(0.5).alias("quality_score"))
    scored = F.arrow_udf(lambda column: model.score(column), "double").asNondeterministic()
    return docs.select(*own, scored(F.col("text")).alias("quality_score"))
