"""Spelling variants: words one edit apart, found by scanning sorted word lists.

One edit lies in the first or in the last half of a word, so two words one edit apart share the other
half. Words are dealt out by (length class, half); words that share a last half are read backwards, so
that the shared half always comes first. Every list is sorted, and the edit table of a word against the
whole list is worked out from the top: neighbours share the table's rows up to their common prefix
(LCP), so a row is computed once for each range of words that begin alike, three diagonals wide. A
range is skipped for all words whose row exceeds one edit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.tables import cut_lineage

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
SHORTEST = 5  # code points of the shortest word
RAREST = 3  # occurrences of the rarest word
SPOILED = 97  # one run in so many loses a code point
DOMINANT = 2  # a form occurs at least so many times as often as the word
LIST = 16_384  # words of one sorted list; longer lists are cut into parts that meet pairwise
BUCKET_CHARS = 1 << 18  # characters of the lists that one call works on
STRIP = 4_096  # words looked up in a list at a time
MATRIX = 1 << 25  # characters of lists of like length in memory at once

DEEP = 64  # characters after which a single word left is compared at once

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FAR = 3  # any distance above the limit


def spoiled_runs(docs: DataFrame) -> DataFrame:
    """(word) for every run of letters of every text, A-Z lower-cased, some with a code point deleted.

    A run loses its code point ``h % length`` if 97 divides ``h``, the crc32 of ``<doc_id>:<run>``; a
    null id is written as nothing. Null and empty texts have no runs.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_prefix"),
        F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(RUN), F.lit(0))).alias("_run"),
    )
    h = F.crc32(F.concat("_prefix", "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    spoiled = F.concat(F.substring("_run", F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    return runs.select(F.when(h % SPOILED == 0, spoiled).otherwise(F.col("_run")).alias("word"))


def vocabulary(runs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points that occur ``rarest`` times or more."""
    counted = runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= rarest)


def _listed(words: DataFrame, longest: int) -> DataFrame:
    """(backwards, size, part, other, oriented, n, is_list, is_query): words in their lists.

    A list of class ``size`` holds words of ``size`` and ``size + 1`` characters that share a half; those
    of ``size`` are looked up in it. Lists of more than ``longest`` words are dealt into parts by a hash,
    and each part's words are looked up in every part.
    """
    n_chars = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(n_chars, n_chars - 1)).alias("size"))
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backwards"))
    head = F.floor(F.col("size") / 2).cast("int")
    shared = F.when(F.col("backwards"), F.col("size") - head).otherwise(head)
    rows = rows.withColumn("oriented", F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word")))
    rows = rows.withColumn("half", F.substring(F.col("oriented"), F.lit(1), shared))
    key = ["backwards", "size", "half"]
    long = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / longest).cast("int").alias("parts"))
    rows = rows.join(long.where("parts > 1"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    is_query = F.length("word") == F.col("size")
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    carried = [*key, "oriented", "n"]
    as_list = rows.select(
        *carried,
        F.col("own").alias("part"),
        F.explode(each).alias("other"),
        F.lit(True).alias("is_list"),
        (is_query & (F.col("own") == F.col("other"))).alias("is_query"),
    )
    elsewhere = rows.where((F.col("parts") > 1) & is_query).select(
        *carried, F.explode(each).alias("part"), F.col("own").alias("other"),
        F.lit(False).alias("is_list"), F.lit(True).alias("is_query"),
    )
    return as_list.union(elsewhere.where("part != other"))


NEAR = "a string, n_a long, b string, n_b long"


class SortedLists:
    """Sorted lists of like length class, one below the other, and the words to look up in them."""

    def __init__(self, words: np.ndarray, shared: np.ndarray, group: np.ndarray, is_list, is_query):
        """``words``: rows of Latin-1 characters, zeros at the end; rows sorted by group, then word."""
        self.words = words
        self.shared = shared  # characters that all words of the row's list have in common
        self.length = (words != 0).sum(axis=1) - shared
        fresh = np.ones(len(words), bool)
        fresh[1:] = group[1:] != group[:-1]
        number = np.cumsum(fresh) - 1
        self.lists = np.flatnonzero(is_list)  # rows of the lists
        starts = np.searchsorted(number[self.lists], np.arange(number[-1] + 2))
        self.queries = np.flatnonzero(is_query)
        self.first = starts[number[self.queries]]  # the query's list: positions in self.lists
        self.end = starts[number[self.queries] + 1]
        rows = self.lists
        self.size = self.length[rows]
        # adjacent common prefixes, less the shared half; a new list has none
        self.lcp = np.full(len(rows), -1)
        if len(rows) > 1:
            alike = words[rows[1:]] == words[rows[:-1]]
            common = np.where(alike.all(axis=1), words.shape[1], (~alike).argmax(axis=1)) - shared[rows[1:]]
            same = number[rows[1:]] == number[rows[:-1]]
            self.lcp[1:] = np.where(same, np.minimum(common, np.minimum(self.size[1:], self.size[:-1])), -1)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (query, word) exactly one edit apart, by strips of queries."""
        useful = self.end > self.first
        queries, first, end = self.queries[useful], self.first[useful], self.end[useful]
        for at in range(0, len(queries), STRIP):
            strip = slice(at, at + STRIP)
            yield from self._scan(queries[strip], first[strip], end[strip])

    def _scan(self, query, first, end) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # the table's row before any character: 0 in the middle, 1 to the right of it
        below = np.full(len(query), _FAR, np.int8)
        middle = np.zeros(len(query), np.int8)
        above = np.where(self.length[query] >= 1, 1, _FAR).astype(np.int8)
        depth = 0
        while len(query):
            if depth >= DEEP:
                # long words: a range of one word shares its rows with nothing
                alone = end - first == 1
                one = np.array([self._one_edit(q, self.lists[f]) for q, f in zip(query[alone], first[alone], strict=True)], bool)
                if one.any():
                    yield query[alone][one], self.lists[first[alone][one]]
                query, first, end = query[~alone], first[~alone], end[~alone]
                below, middle, above = below[~alone], middle[~alone], above[~alone]
            # a range's first word may end here; its distance stands where the query ends
            ends = self.size[first] == depth
            if ends.any():
                offset = self.length[query] - depth
                distance = np.where(offset == 0, middle, np.where(offset == 1, above, np.where(offset == -1, below, _FAR)))
                hit = ends & (distance == 1)
                if hit.any():
                    yield query[hit], self.lists[first[hit]]
            # each range falls into ranges of words whose next character is the same
            borders = np.append(np.flatnonzero(self.lcp <= depth), len(self.lcp))
            begins = borders[:-1][self.size[borders[:-1]] > depth]
            lo, hi = np.searchsorted(begins, first), np.searchsorted(begins, end)
            counts = hi - lo
            parent = np.repeat(np.arange(len(query)), counts)
            if not len(parent):
                return
            child = np.repeat(lo - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(parent))
            first = begins[child]
            end = borders[np.searchsorted(borders, first, side="right")]
            query = query[parent]
            below, middle, above = self._next_row(query, first, depth, below[parent], middle[parent], above[parent])
            alive = np.minimum(np.minimum(below, middle), above) <= 1
            query, first, end = query[alive], first[alive], end[alive]
            below, middle, above = below[alive], middle[alive], above[alive]
            depth += 1

    def _one_edit(self, query: int, word: int) -> bool:
        """Whether a word is one edit from a query that is as long or shorter by one."""
        a = self.words[query, : self.shared[query] + self.length[query]]
        b = self.words[word, : self.shared[word] + self.length[word]]
        off = np.flatnonzero(a != b[: len(a)])
        if not len(off):
            return len(b) > len(a)
        k = int(off[0])
        return bool((a[k + len(a) + 1 - len(b) :] == b[k + 1 :]).all())

    def _next_row(self, query, first, depth, below, middle, above):
        """The row after one more character of the list's words, on three diagonals."""
        row, base, length = self.lists[first], self.shared[query], self.length[query]
        char = self.words[row, self.shared[row] + depth]

        def differs(column: int) -> np.ndarray:  # from the query's character that ends this column
            at = base + column - 1
            inside = at < self.words.shape[1]
            own = self.words[query, np.where(inside, at, 0)]
            return np.where(inside, own != char, True).astype(np.int8)

        far = np.int8(_FAR)
        new_below = middle + np.int8(1)
        if depth >= 1:
            new_below = np.minimum(new_below, below + differs(depth))
        new_below = np.where(length >= depth, np.minimum(new_below, far), far)
        new_middle = np.minimum(middle + differs(depth + 1), np.minimum(above, new_below) + np.int8(1))
        new_middle = np.where(length >= depth + 1, np.minimum(new_middle, far), far)
        new_above = np.minimum(above + differs(depth + 2), new_middle + np.int8(1))
        new_above = np.where(length >= depth + 2, np.minimum(new_above, far), far)
        return new_below, new_middle, new_above


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one run of Latin-1 characters, and where each begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    texts = [w.encode("latin-1") for w in column.to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _find_near(bucket: pa.Table) -> pa.Table:
    """Pairs one edit apart of the lists of a bucket, each pair once."""
    flat, offsets = _characters(bucket.column("oriented"))
    lengths = np.diff(offsets)
    back = bucket.column("backwards").to_numpy(zero_copy_only=False)
    size = bucket.column("size").to_numpy()
    part, other = bucket.column("part").to_numpy(), bucket.column("other").to_numpy()
    is_list = bucket.column("is_list").to_numpy(zero_copy_only=False)
    is_query = bucket.column("is_query").to_numpy(zero_copy_only=False)
    n = bucket.column("n").to_numpy()
    by_size = np.argsort(size, kind="stable")
    a, b = [], []
    at = 0
    while at < len(by_size):
        # rows of like length, as many as fit
        width = int(size[by_size[at]]) + 1
        stop = int(np.searchsorted(size[by_size], size[by_size[at]], side="right"))
        if stop - at <= MATRIX // width:
            while stop < len(by_size):
                wider = int(size[by_size[stop]]) + 1
                more = int(np.searchsorted(size[by_size], size[by_size[stop]], side="right"))
                if (more - at) * wider > MATRIX or wider > 2 * width:
                    break
                stop, width = more, wider
        rows = by_size[at:stop]
        at = stop
        words = np.zeros((len(rows), width), np.uint8)
        line = np.repeat(np.arange(len(rows)), lengths[rows])
        column = np.arange(len(line)) - np.repeat(np.cumsum(lengths[rows]) - lengths[rows], lengths[rows])
        words[line, column] = flat[np.repeat(offsets[rows], lengths[rows]) + column]
        head = size[rows] // 2
        shared = np.where(back[rows], size[rows] - head, head)
        spelled = np.ascontiguousarray(words).view(f"S{width}").ravel()
        order = np.lexsort((spelled, other[rows], part[rows], size[rows], back[rows]))
        rows, words, shared, head = rows[order], words[order], shared[order], head[order]
        # a list: the same class, direction, parts and shared half
        same = np.ones(len(rows), bool)
        for column in (back, size, part, other):
            same[1:] &= column[rows][1:] == column[rows][:-1]
        alike = words[1:] == words[:-1]
        common = np.where(alike.all(axis=1), width, (~alike).argmax(axis=1))
        same[1:] &= common >= shared[1:]
        same[:1] = False
        lists = SortedLists(words, shared, np.cumsum(~same), is_list[rows], is_query[rows])
        for query, word in lists.near():
            x, y = rows[query], rows[word]
            # words of one length meet both ways round: once is enough
            within = part[x] == other[x]
            keep = (lengths[x] < lengths[y]) | np.where(within, query < word, part[x] < other[x])
            # a pair that shares the first half as well is found where that one leads
            again = back[x] & keep
            last = head[query]
            for k in range(int(last[again].max()) if again.any() else 0):
                own = words[query, np.maximum(lengths[x] - 1 - k, 0)]
                met = words[word, np.maximum(lengths[y] - 1 - k, 0)]
                again &= (k >= last) | (own == met)
            keep &= ~again
            a.append(x[keep])
            b.append(y[keep])
    a = np.concatenate(a) if a else np.zeros(0, np.int64)
    b = np.concatenate(b) if b else np.zeros(0, np.int64)

    def spelled_out(rows: np.ndarray) -> pa.Array:
        out = []
        for r in rows:
            word = flat[offsets[r] : offsets[r + 1]].tobytes()
            out.append((word[::-1] if back[r] else word).decode("latin-1"))
        return pa.array(out, pa.string())

    return pa.table({"a": spelled_out(a), "n_a": pa.array(n[a], pa.int64()), "b": spelled_out(b), "n_b": pa.array(n[b], pa.int64())})


def near_words(words: DataFrame, longest: int = LIST) -> DataFrame:
    """(a, n_a, b, n_b): every pair of ``words`` (word, n) exactly one edit apart, once, in any order.

    Words are of at least two characters, none above U+00FF, and different from each other.
    """
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(1, -(-4 * chars // BUCKET_CHARS))
    bucket = F.pmod(F.xxhash64("backwards", "size", "half", "part", "other"), F.lit(buckets))
    rows = _listed(words, longest)
    return rows.select(
        "backwards", "size", "part", "other", "oriented", "n", "is_list", "is_query", bucket.alias("bucket")
    ).groupBy("bucket").applyInArrow(_find_near, NEAR)


def follow(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that begins at each word ends; ``links`` has (word, form).

    Chains have no cycles, as a form is always more frequent. Every turn doubles the steps taken, so a
    chain of length m takes log2(m) joins of the links.
    """
    links = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = links.join(onward, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        )
        moved = cut_lineage(moved)
        links = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return links


def group_variants(words: DataFrame, dominant: int = DOMINANT, longest: int = LIST) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` holds (word, n), each word once. ``n_near`` counts the words one edit (a code point
    inserted, deleted or replaced) away. ``form`` is the most frequent of them (ties: the first in
    code-point order) if it occurs at least ``dominant`` times as often as the word, else null; ``root``
    is where the forms lead, the word itself if it has none. An empty table gives an empty one.
    """
    words = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near_words(words, longest))
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    best = (
        pairs.select("a", "b", "n_b")
        .union(turned.select("a", "b", "n_b"))
        .groupBy(F.col("a").alias("word"))
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("_best"),
        )
    )
    enough = -F.col("_best.less") >= dominant * F.col("n")
    known = cut_lineage(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("_best.form")).alias("form"),
            F.when(enough, -F.col("_best.less")).alias("form_n"),
        )
    )
    roots = follow(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all texts of ``docs`` (doc_id, text) with their forms; see the functions above.

    Repeated rows and texts count as often as they occur; other columns are not looked at.
    """
    return group_variants(vocabulary(spoiled_runs(docs.select("doc_id", "text"))))
