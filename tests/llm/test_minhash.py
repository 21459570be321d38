import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from grantlens.llm import minhash, queries
from grantlens.llm.words import blocks

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingle_set(text, n=5):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """Smallest id of each document's class, all pairs compared."""
    rows = [(i, t) for i, t in rows]
    sets = [None if t is None else shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x is None or y is None:
            continue
        near = rows[a][1] == rows[b][1] or (x and y and len(x & y) >= threshold * len(x | y) - 1e-9)
        if near:
            parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(smallest.get(root(k), i), i)
    return {i: smallest[root(k)] for k, (i, _) in enumerate(rows)}


def variants(seed, count, changes, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("weighted", [False, True])
def test_agreement_is_the_similarity(weighted):
    texts = list(variants(1, 40, 12)) + ["a b c d e f g " * 9, "a b c d e f h " * 9]
    (block,) = blocks(pa.array(texts))
    hashes, text, weights = minhash.elements(block, 5, weighted)
    signed = minhash.dart_signatures(hashes, text, weights, len(texts), 400)
    assert (signed != 0).all()
    off = []
    for a, b in itertools.combinations(range(len(texts)), 2):
        x = dict(zip(hashes[text == a].tolist(), weights[text == a], strict=True))
        y = dict(zip(hashes[text == b].tolist(), weights[text == b], strict=True))
        common = sum(min(x[h], y[h]) for h in x.keys() & y.keys())
        off.append((signed[a] == signed[b]).mean() - common / (sum(x.values()) + sum(y.values()) - common))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_signature_depends_on_the_text_alone():
    texts = ["one two three four five six", "b " * 200, "x y z"]
    (both,) = blocks(pa.array(texts))
    whole = minhash.dart_signatures(*minhash.elements(both, 5, False), 3, 150)
    for i, t in enumerate(texts):
        (block,) = blocks(pa.array([t]))
        assert (minhash.dart_signatures(*minhash.elements(block, 5, False), 1, 150)[0] == whole[i]).all()


def test_against_all_pairs(documents):
    rows = list(variants(2, 60, 9)) + list(variants(3, 30, 30)) + list(variants(4, 30, 4, length=30))
    docs = documents(rows + rows[:5])
    found = minhash.near_duplicates(docs).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    assert sum(r["kept"] for r in found) == len(set(want.values()))


def test_blocks_of_a_bucket_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    docs = documents(list(variants(5, 80, 14)))
    found = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute([(r[0], r[1]) for r in docs.collect()])


def test_groups_stay_bounded_in_a_bucket_of_strangers(documents, monkeypatch):
    """Template documents of similarity about 0.7 share buckets but no links; a few near-copies do."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(160)]
    rows = [" ".join(base + [f"d{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(150)]
    rows += [" ".join(t.split()[:-3] + ["x", f"y{i}", "z"]) for i, t in enumerate(rows[::10])]
    made = minhash._block_links

    def watched(*args):
        links = made(*args)

        def checked(group):
            if group.num_rows > 60:
                raise ValueError(f"{group.num_rows} texts in one group")
            return links(group)

        return checked

    monkeypatch.setattr(minhash, "_block_links", watched)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1500)  # about ten texts
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    found = minhash.near_duplicates(documents(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute(list(enumerate(rows)))
    assert len({r["class_id"] for r in found}) == 150


def test_given_documents(spark, sf_dir, given):
    found = queries.op6_minhash_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute([(r["doc_id"], r["text"]) for r in given[1]])


def test_odd_rows(odd):
    clash = odd.withColumn("class_id", odd.lang).withColumn("_times", odd.lang)
    found = minhash.near_duplicates(clash)
    got = {(r["doc_id"], r["text_hash"]): r["class_id"] for r in found.collect()}
    assert found.count() == odd.count()
    by_id = {k[0]: v for k, v in got.items() if k[0] is not None}
    assert by_id == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    kept = minhash.keep_one(clash, found)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "None", "None"])
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
