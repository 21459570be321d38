import random
import re

import numpy as np
import pytest

from grantlens.llm import queries, suffixes
from grantlens.llm.suffixes import find_repeats, minimisers

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def brute(rows, length=50):
    """Repeated words of each row: in a run of ``length`` words that another row holds."""
    tokens = [WORD.findall((t or "").lower()) for _, t in rows]
    owners = {}
    for k, w in enumerate(tokens):
        for i in range(len(w) - length + 1):
            owners.setdefault(tuple(w[i : i + length]), set()).add(k)
    out = []
    for w in tokens:
        hit = set()
        for i in range(len(w) - length + 1):
            if len(owners[tuple(w[i : i + length])]) > 1:
                hit.update(range(i, i + length))
        out.append(sorted(hit))
    return out


def passages(seed=1, vocabulary=3000):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(30):
        own = text(rng.randrange(5, 150))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = shared[rng.randrange(len(shared))]
        rows.append((i, " ".join(own)))
    rows += [(100, rows[0][1]), (101, rows[1][1]), (102, "to " * 300), (103, "to " * 90 + "end"), (104, "so " * 200)]
    edited = rows[5][1].split() * 2
    rows += [(105 + k, " ".join(edited[:k] + ["changed"] + edited[k:])) for k in range(0, 90, 9)]
    return rows


def spans_of(frame):
    rows = frame.orderBy("doc_id").collect()
    return [[i for s in r["spans"] for i in range(s["first"], s["end"])] for r in rows]


@pytest.mark.parametrize("group", [suffixes.GROUP, 15, 1])
def test_against_all_runs(documents, group):
    """One piece, several, and groups that are halved down to single runs."""
    rows = passages()
    found = find_repeats(documents(rows), group=group)
    assert spans_of(found) == brute(rows)
    assert all(r["n_repeated"] == sum(s["end"] - s["first"] for s in r["spans"]) for r in found.collect())


def test_every_run_holds_a_minimiser():
    rng = np.random.default_rng(3)
    hashes = rng.integers(1, 30, 500).astype(np.uint64)
    text = np.repeat([0, 1, 2], [200, 49, 251])
    at, _ = minimisers(hashes, text, 50, 10)
    chosen = set(at.tolist())
    for i in range(451):
        if text[i] == text[i + 49]:
            assert any(p in chosen for p in range(i, i + 41))
    assert not any(200 <= p < 249 for p in chosen)


def test_given_documents(spark, sf_dir, given):
    found = queries.op4_suffix_array_dedup(spark, sf_dir)
    assert spans_of(found) == brute([(r["doc_id"], r["text"]) for r in given[1]])


def test_odd_rows(odd):
    found = find_repeats(odd.withColumn("spans", odd.lang).withColumn("node", odd.lang))
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in found.collect() if r["doc_id"]}
    assert found.count() == odd.count()
    assert got[6] == got[7] == (20_000, 20_000)
    assert [got[i] for i in (1, 2, 3)] == [(0, 0)] * 3 and got[8] == (5, 0)
    assert find_repeats(odd.limit(0)).count() == 0
