import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from grantlens.llm.words import blocks, distinct_shingles, grams, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB09é日 .-\n", max_size=30)), max_size=12)


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_are_those_of_the_pattern(rows, block_bytes):
    got = []
    for block in blocks(pa.array(rows, pa.string()), block_bytes):
        found = words(block)
        for t in range(block.texts):
            own = range(found.bounds[t], found.bounds[t + 1])
            got.append([lower(block.data[found.start[i] : found.end[i]].tobytes().decode()) for i in own])
    assert got == [WORD.findall(lower(r or "")) for r in rows]


@settings(max_examples=40, deadline=None)
@given(texts)
def test_equal_words_have_equal_hashes(rows):
    seen = {}
    for block in blocks(pa.array(rows, pa.string()), 64):
        found = words(block)
        for i, h in enumerate(found.hashes):
            word = lower(block.data[found.start[i] : found.end[i]].tobytes().decode())
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_empty_columns():
    column = pa.array(["skipped", "a b", None, "c"])[1:]
    found = [words(b) for b in blocks(column)]
    assert [len(f.hashes) for f in found] == [3]
    assert list(blocks(pa.array([], pa.string()))) == []


def test_short_texts_are_one_shingle():
    (block,) = blocks(pa.array(["a b c d e f", "a b c", "", "a b c d e"]))
    hashes, text = distinct_shingles(words(block), 5)
    assert text.tolist() == [0, 0, 1, 3]
    assert hashes[3] in hashes[:2]


def test_grams_do_not_depend_on_their_place():
    h = np.arange(1, 9, dtype=np.uint64)
    assert grams(h, 3)[2] == grams(h[2:5], 3)[0]
