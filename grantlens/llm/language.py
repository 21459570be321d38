"""Language identification by character language models.

One interpolated Kneser-Ney model per language over folded letters; runs of anything else are one
boundary sign. The n-grams of all languages lie in sorted arrays of their hashes, one array per
order, with the languages' log-probabilities beside them; a text is scored by looking its n-grams up,
backing off where they are missing. The lowest cross-entropy per character wins. Texts whose
cross-entropy is far above what their language's calibration texts show are rejected.

Models are fitted on a bounded sample (``PER_LANGUAGE`` texts of each language, chosen by a hash);
n-grams are counted in the tasks and merged by Spark. Every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.words import blocks, mix64

ORDER = 4
PER_LANGUAGE = 1200  # texts that a model is fitted on, about; bounds the model
CALIBRATION = 4  # one in so many of them calibrates the rejection and is not counted
REJECTED = 0.001  # share of calibration texts that may lie beyond the limit
SLACK = 2.0  # further widening of the limit
LEAST_LIMIT = 8.0  # spreads that no text is rejected within, however alike the calibration texts are
DISCOUNT = 0.75
PIECE = 1 << 17  # positions scored at a time
UNKNOWN = "und"

VERDICT = "struct<lang:string,score:double,bits:double,letters:long,rejected:boolean>"
_VERDICT = pa.struct(
    [
        ("lang", pa.string()),
        ("score", pa.float64()),
        ("bits", pa.float64()),
        ("letters", pa.int64()),
        ("rejected", pa.bool_()),
    ]
)
RESULTS = ("lang_pred", "score", "bits", "letters", "rejected")

_TABLED = 0x20000
_fold: np.ndarray | None = None


def _folds() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is none."""
    global _fold
    if _fold is None:
        _fold = np.array(
            [ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(_TABLED)], np.int32
        )
    return _fold


def letter_sequence(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a block's texts, each text after ``ORDER - 1`` boundary signs and before one.

    Returns the signs, the text of each, and the number of letters of each text.
    """
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    text = np.repeat(np.arange(block.texts), np.diff(leads[block.offsets]))
    signs = np.where(points < _TABLED, _folds()[np.minimum(points, _TABLED - 1)], points).astype(np.int32)
    letters = np.bincount(text[signs > 0], minlength=block.texts)
    kept = signs > 0
    # of a run of other signs the first stays, unless the text begins with it
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    kept[1:] |= (signs[1:] == 0) & (signs[:-1] > 0) & ~first[1:]
    signs, text = signs[kept], text[kept]
    counts = np.bincount(text, minlength=block.texts)
    pad = ORDER - 1
    starts = np.concatenate(([0], np.cumsum(counts + pad + 1)))
    out = np.zeros(starts[-1], np.int32)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out[np.arange(len(signs)) - begin[text] + starts[:-1][text] + pad] = signs
    owner = np.repeat(np.arange(block.texts), counts + pad + 1)
    return out, owner, letters


def hash_signs(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = h * np.uint64(0x100000001B3) + c.astype(np.uint64) + np.uint64(1)
    return mix64(h)


def _windows(signs: np.ndarray, owner: np.ndarray, begin: int, end: int):
    """The n-grams that end at positions begin .. end - 1 and do not leave their text."""
    at = np.arange(max(begin, ORDER - 1), end)
    at = at[owner[at] == owner[at - (ORDER - 1)]]
    return at, [signs[at - (ORDER - 1) + k] for k in range(ORDER)]


@dataclass
class LanguageModel:
    """Log-probabilities of n-grams for all languages, in arrays sorted by hash.

    ``keys[n]`` are the hashes of n-grams; ``logp[n][i, l]`` is the log-probability of its last sign
    after the others in language ``l``; ``backoff[n][i, l]`` the log-weight of the next lower order
    after the whole n-gram.
    """

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray | None = None  # log-probability of a sign never seen
    typical: np.ndarray | None = None  # mean cross-entropy, and its spread for short and long texts
    short_spread: np.ndarray | None = None
    long_spread: np.ndarray | None = None
    limit: np.ndarray | None = None

    @classmethod
    def fit(cls, languages: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        """``grams`` has the signs of each distinct n-gram of the highest order by language."""
        model, L = cls(languages), len(languages)
        level = {ORDER: (lang, grams, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            l, g, _ = level[n + 1]
            # continuation counts: in how many ways a shorter n-gram is preceded
            own, inverse = np.unique(np.column_stack([l, g[:, 1:]]), axis=0, return_inverse=True)
            level[n] = (own[:, 0], own[:, 1:], np.bincount(inverse.ravel()).astype(np.float64))
        # below all n-grams: every sign alike
        signs = len(np.unique(grams[:, -1])) + 1
        model.floor = np.full(L, -np.log(signs))
        for n in range(1, ORDER + 1):
            l, g, c = level[n]
            hashes = hash_signs([g[:, k] for k in range(n)])
            keys, row = np.unique(hashes, return_inverse=True)
            sample = np.zeros((len(keys), n), np.int64)
            sample[row] = g
            if n == 1:
                context = np.zeros(len(g), np.int64)
                contexts = np.zeros(1, np.uint64)
            else:
                contexts, context = np.unique(hash_signs([g[:, k] for k in range(n - 1)]), return_inverse=True)
            total = np.zeros((len(contexts), L))
            kinds = np.zeros((len(contexts), L))
            np.add.at(total, (context, l), c)
            np.add.at(kinds, (context, l), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            if n == 1:
                lower = np.exp(np.broadcast_to(model.floor, (len(keys), L)))
                own_context = np.zeros(len(keys), np.int64)
                model.floor = model.floor + np.log(weight[0])
            else:
                below = hash_signs([sample[:, k] for k in range(1, n)])
                lower = np.exp(model.logp[n - 1][np.searchsorted(model.keys[n - 1], below)])
                own_context = np.searchsorted(contexts, hash_signs([sample[:, k] for k in range(n - 1)]))
            p = weight[own_context] * lower
            np.add.at(p, (row, l), np.maximum(c - DISCOUNT, 0) / total[context, l])
            model.keys[n], model.logp[n] = keys, np.log(p).astype(np.float32)
            if n > 1:
                model.keys[-n], model.backoff[n] = contexts, np.log(weight).astype(np.float32)
        return model

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(self.languages)), np.float32)
        open_ = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            own = [c[open_] for c in columns[ORDER - n :]]
            hashes = hash_signs(own)
            at = np.searchsorted(self.keys[n], hashes)
            at[at == len(self.keys[n])] = 0
            seen = self.keys[n][at] == hashes
            out[open_[seen]] += self.logp[n][at[seen]]
            open_, own = open_[~seen], [c[~seen] for c in own]
            if not len(open_):
                break
            if n == 1:
                out[open_] += self.floor
                break
            contexts, before = self.keys[-n], hash_signs(own[:-1])
            at = np.searchsorted(contexts, before)
            at[at == len(contexts)] = 0
            known = contexts[at] == before
            out[open_[known]] += self.backoff[n][at[known]]
        return out

    def cross_entropy(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per sign by text and language, signs and letters of each text."""
        signs, owner, letters = letter_sequence(block)
        sums = np.zeros((block.texts, len(self.languages)))
        n = np.zeros(block.texts)
        for begin in range(0, len(signs), PIECE):
            at, columns = _windows(signs, owner, begin, min(begin + PIECE, len(signs)))
            logp = self.log_probabilities(columns)
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owner[at], weights=logp[:, k], minlength=block.texts)
            n += np.bincount(owner[at], minlength=block.texts)
        return -sums / np.log(2) / np.maximum(n, 1)[:, None], n, letters

    def excess(self, best: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far above its language's typical cross-entropy a text lies, in its own spread."""
        spread = np.sqrt(self.short_spread[best] / np.maximum(n, 1) + self.long_spread[best])
        return (bits - self.typical[best]) / spread

    def judge(self, column: pa.Array) -> pa.Array:
        lang, score, bits_, letters_, rejected = [], [], [], [], []
        for block in blocks(column, 1 << 18):
            bits, n, letters = self.cross_entropy(block)
            best = bits.argmin(axis=1)
            own = bits[np.arange(len(best)), best]
            # odds from at most 32 signs' worth of evidence, as neighbouring signs are not independent
            odds = np.exp2(-(bits - own[:, None]) * np.minimum(n, 32)[:, None])
            known = letters > 0
            far = self.excess(best, own, n) > self.limit[best] if self.limit is not None else ~known
            lang += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            score += np.where(known, 1 / odds.sum(axis=1), 0.0).tolist()
            bits_ += np.where(known, own, 0.0).tolist()
            letters_ += letters.tolist()
            rejected += (far | ~known).tolist()
        return pa.StructArray.from_arrays(
            [
                pa.array(lang, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(bits_, pa.float64()),
                pa.array(letters_, pa.int64()),
                pa.array(rejected, pa.bool_()),
            ],
            fields=list(_VERDICT),
        )


def _count(batches):
    """n-grams of each batch with their counts, as rows (lang, s0 .., n)."""
    names = [f"s{k}" for k in range(ORDER)]
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for block in blocks(batch.column("text")):
            signs, owner, _ = letter_sequence(block)
            at, columns = _windows(signs, owner, 0, len(signs))
            if not len(at):
                continue
            own = langs[block.first : block.first + block.texts]
            kinds, lang = np.unique(own.astype(str), return_inverse=True)
            hashes = mix64(hash_signs(columns) + lang[owner[at]].astype(np.uint64))
            _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds[lang[owner[at]][first]].tolist(), pa.string())]
                + [pa.array(c[first], pa.int32()) for c in columns]
                + [pa.array(counts, pa.int64())],
                names=["lang", *names, "n"],
            )


def training_sample(docs: DataFrame, training: F.Column, per_language: int) -> DataFrame:
    """About ``per_language`` rows (lang, text, _part) of each language, by a hash of the row's id."""
    spark = docs.sparkSession
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row per language
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    shares = [(r["lang"], min(1.0, per_language / r["n"])) for r in totals]
    shares = spark.createDataFrame(shares, "lang string, _share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return (
        rows.select("lang", "text", draw.alias("_draw"))
        .join(F.broadcast(shares), "lang")
        .where(F.col("_draw") < F.col("_share") * (1 << 20))
        .select("lang", "text", F.pmod(F.xxhash64("_draw"), F.lit(CALIBRATION)).alias("_part"))
    )


def train(
    docs: DataFrame, training: F.Column | None = None, per_language: int = PER_LANGUAGE
) -> LanguageModel | None:
    """Models of the languages in ``docs.lang``, from the rows where ``training`` holds.

    Null texts and languages are left out; without any row there is no model.
    """
    training = F.lit(True) if training is None else training
    sample = training_sample(docs, training, per_language)
    fields = ", ".join(f"s{k} int" for k in range(ORDER))
    counted = sample.where("_part > 0 or lang is null").select("lang", "text")
    grams = (
        counted.mapInArrow(_count, f"lang string, {fields}, n long")
        .groupBy("lang", *[f"s{k}" for k in range(ORDER)])
        .agg(F.sum("n").alias("n"))
        .toArrow()  # bounded by the sample
    )
    if not grams.num_rows:
        return None
    languages, lang = np.unique(np.array(grams.column("lang").to_pylist()), return_inverse=True)
    signs = np.column_stack([grams.column(f"s{k}").to_numpy() for k in range(ORDER)]).astype(np.int64)
    order = np.lexsort((*signs.T, lang))  # the same model whatever the order of the rows
    model = LanguageModel.fit(
        languages.tolist(), lang[order], signs[order], grams.column("n").to_numpy()[order]
    )
    _calibrate(model, sample)
    return model


def _calibrate(model: LanguageModel, sample: DataFrame) -> None:
    """Typical cross-entropies and rejection limits from texts that were not counted."""
    judged = sample.where("_part = 0").select("lang", _judge(model)("text").alias("v"))
    rows = judged.where("v.lang = lang").select("lang", "v.bits", "v.letters").collect()  # bounded
    shape = len(model.languages)
    bits = {k: [] for k in range(shape)}
    sizes = {k: [] for k in range(shape)}
    for r in sorted(rows, key=lambda r: (r["lang"], r["bits"], r["letters"])):
        k = model.languages.index(r["lang"])
        bits[k].append(r["bits"])
        sizes[k].append(r["letters"])
    everything = [b for own in bits.values() for b in own] or [8.0]
    model.typical, model.short_spread = np.zeros(shape), np.zeros(shape)
    model.long_spread, model.limit = np.zeros(shape), np.zeros(shape)
    for k in range(shape):
        own, n = np.array(bits[k] or everything), np.array(sizes[k] or [100.0] * len(everything))
        model.typical[k] = np.median(own)
        off = (own - model.typical[k]) ** 2
        model.short_spread[k] = max(np.mean(off * n) / 2, 4.0)
        model.long_spread[k] = max(np.mean(off) / 2, 0.01)
    for k in range(shape):
        if bits[k]:
            far = model.excess(np.full(len(bits[k]), k), np.array(bits[k]), np.array(sizes[k]))
            model.limit[k] = max(LEAST_LIMIT, SLACK * np.quantile(far, 1 - REJECTED))
        else:
            model.limit[k] = LEAST_LIMIT


def _judge(model: LanguageModel):
    return F.arrow_udf(lambda column: model.judge(column), VERDICT).asNondeterministic()


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All rows with ``lang_pred``, ``score``, ``bits``, ``letters`` and ``rejected``.

    ``lang_pred`` is the language of the lowest cross-entropy, ``und`` for null and empty texts and
    those without a letter (score 0, rejected). Ties go to the first language by name. Without a
    model every text is ``und``. Columns named like a result are replaced.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    if model is None:
        nothing = F.struct(
            F.lit(UNKNOWN).alias("lang"),
            F.lit(0.0).alias("score"),
            F.lit(0.0).alias("bits"),
            F.lit(0).cast("long").alias("letters"),
            F.lit(True).alias("rejected"),
        )
        judged = docs.select(F.struct(*own).alias("_row"), nothing.alias("_v"))
    else:
        judged = docs.select(F.struct(*own).alias("_row"), _judge(model)(F.col("text")).alias("_v"))
    return judged.select(
        "_row.*",
        F.col("_v.lang").alias("lang_pred"),
        F.col("_v.score").alias("score"),
        F.col("_v.bits").alias("bits"),
        F.col("_v.letters").alias("letters"),
        F.col("_v.rejected").alias("rejected"),
    )
