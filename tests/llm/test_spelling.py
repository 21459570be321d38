import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.llm import spelling


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def runs_by_hand(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % 97 == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run


def variants_by_hand(n: dict[str, int]) -> set[tuple]:
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def found(frame) -> list[tuple]:
    return [tuple(r) for r in frame.select(*COLUMNS).collect()]


def word_table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


@pytest.mark.parametrize("longest", [spelling.LIST, 7])
@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzÿ"])
def test_against_all_pairs(spark, alphabet, longest):
    rng = random.Random(len(alphabet))
    n = {}
    while len(n) < 250:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9)))
        n[w] = rng.choice([3, 4, 6, 8, 20, 200])
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]):
            if len(v) >= 5 and rng.random() < 0.4:
                n.setdefault(v, rng.choice([3, 5, 9, 90]))
    got = found(spelling.group_variants(word_table(spark, n), longest=longest))
    assert len(got) == len(n) and set(got) == variants_by_hand(n)


def test_ends_repeats_and_lengths(spark):
    """Edits at both ends, at the border of the halves, beside equal letters; long and short words."""
    base = ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "aabaa", "abaaa", "xaaaaa", "aaaaax", "aaaxaaa"]
    long = "lorem" * 400
    base += [long, long + "x", "x" + long, long[:1000] + long[1001:], long[:999] + "z" + long[1000:]]
    n = {w: 3 * 2**i for i, w in enumerate(base)}
    assert set(found(spelling.group_variants(word_table(spark, n)))) == variants_by_hand(n)


def test_ties_and_chains(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 30, "zzzzz": 5, "zzzzy": 9, "qqqqq": 4, "qqqqr": 8, "qqqqs": 8}
    rows = {r[0]: r for r in found(spelling.group_variants(word_table(spark, n)))}
    assert rows["aaaaa"] == ("aaaaa", "aaaab", "aabbb", 3, 1, 6)
    assert rows["zzzzz"] == ("zzzzz", None, "zzzzz", 5, 1, None)  # 9 is less than twice 5
    assert rows["qqqqq"][1] == "qqqqr"  # of two as frequent the first
    assert rows["aabbb"][1:3] == (None, "aabbb")


def test_long_chain(spark):
    """A chain of forms longer than a few doublings."""
    words, w = [], "aaaaaaaaaaaa"
    for i in range(12):
        words.append(w)
        w = w[:i] + "b" + w[i + 1 :]
    n = {w: 3 * 2**i for i, w in enumerate(words)}
    assert {r[2] for r in found(spelling.group_variants(word_table(spark, n)))} == {words[-1]}


def test_runs(spark, documents):
    text = "ÀÉ×÷ßé Straße—don't ABCDEFG hijklm\tnopqr123stuvw " * 60
    docs = [(7, text), (None, text), (3, None), (4, ""), (7, text)]
    got = Counter(r[0] for r in spelling.spoiled_runs(documents(docs)).collect())
    want = Counter(w for i, t in docs for w in runs_by_hand(i, t))
    assert got == want


def test_given_documents(spark, given):
    frame, docs = given
    counts = Counter(w for r in docs for w in runs_by_hand(r["doc_id"], r["text"]))
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    got = found(spelling.spelling_variants(frame))
    assert len(got) == len(n)
    short = {w: c for w, c in n.items()}
    by_length: dict[int, list[str]] = {}
    for w in short:
        by_length.setdefault(len(w), []).append(w)
    assert {r[0]: r[3] for r in got} == n
    # all pairs are too many to try in Python for every word; every tenth word is enough here
    rng = random.Random(5)
    rows = {r[0]: r for r in got}
    for w in rng.sample(sorted(n), 150):
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)]
        assert rows[w][4] == len(near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        assert rows[w][1] == form
        assert rows[w][2] == (w if form is None else rows[form][2])


def test_odd_rows(spark, odd, documents):
    named = odd.withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("root", F.lit(None).cast("string"))
    counts = Counter(w for r in odd.collect() for w in runs_by_hand(r["doc_id"], r["text"]))
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    assert set(found(spelling.spelling_variants(named))) == variants_by_hand(n)
    assert found(spelling.spelling_variants(documents([]))) == []
    assert found(spelling.spelling_variants(documents([(1, None), (2, "")]))) == []


def test_long_runs(spark, documents):
    """Runs of tens of thousands of letters, beside short words."""
    long = "ab" * 15_000
    docs = [(1, f"{long} {long}é {long}"), (2, long), (3, f"{long}é {long}é hello hello hello")]
    n = {w: c for w, c in Counter(w for i, t in docs for w in runs_by_hand(i, t)).items() if len(w) >= 5 and c >= 3}
    assert set(found(spelling.spelling_variants(documents(docs)))) == variants_by_hand(n)


def test_rows_are_kept_for_ranges_that_may_still_match():
    """Ranges whose common prefix exceeds one edit are left at once."""
    words = sorted([b"abcde", b"abcdf", b"xxxde", b"xxxdf", b"xyzzz"])
    flat = np.zeros((len(words), 6), np.uint8)
    for i, w in enumerate(words):
        flat[i, : len(w)] = np.frombuffer(w, np.uint8)
    ones = np.ones(len(words), bool)
    lists = spelling.SortedLists(flat, np.zeros(len(words), int), np.zeros(len(words), int), ones, ones)
    seen = []
    step = lists._next_row
    lists._next_row = lambda q, f, depth, *rows: seen.append((depth, len(q))) or step(q, f, depth, *rows)
    pairs = sorted((words[q[i]], words[w[i]]) for q, w in lists.near() for i in range(len(q)))
    assert pairs == [(b"abcde", b"abcdf"), (b"abcdf", b"abcde"), (b"xxxde", b"xxxdf"), (b"xxxdf", b"xxxde")]
    assert dict(seen)[0] == 10  # two ranges, a and x, for each of five words
    assert dict(seen)[3] < 10
