import random

import pytest
from pyspark.sql import functions as F

from grantlens.llm import lines, queries
from grantlens.llm.lines import banded_distance, dedup_lines, may_be_close, remove_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


def edited(rng, text, edits, letters):
    own = list(text)
    for _ in range(edits):
        at = rng.randrange(len(own) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            own.insert(at, rng.choice(letters))
        elif own:
            at = min(at, len(own) - 1)
            own[at : at + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(own)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng, rows = random.Random(edits), []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(4, 40)))
        b = edited(rng, a, rng.randrange(5), "abé")
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(b) >= 4:
            rows.append((a, b))
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(
        F.levenshtein("a", "b").alias("w"),
        banded_distance(F.col("a"), F.col("b"), edits).alias("d"),
        may_be_close(F.col("a"), F.col("b"), edits).alias("m"),
    ).collect()
    apart = lines.without_common_ends(F.col("a"), F.col("b"), lambda x, y: banded_distance(x, y, edits))
    short = frame.select(F.levenshtein("a", "b").alias("w"), apart.alias("d")).collect()
    assert all(r["d"] == r["w"] if r["w"] <= edits else r["d"] > edits for r in short)
    assert all(r["d"] == r["w"] if r["w"] <= edits else r["d"] > edits for r in got)
    assert all(r["m"] for r in got if r["w"] <= edits)


def brute(texts):
    """(links, line texts of the class) of each distinct line, all pairs compared."""
    own = sorted({x for t in texts if t is not None for x in t.split("\n") if x.strip(" ")})
    near = {x: set() for x in own}
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            allowed = min(2, min(len(a), len(b)) // 10)
            if allowed and abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed:
                near[a].add(b)
                near[b].add(a)
    classes = {}
    for x in own:
        seen, todo = {x}, [x]
        while todo:
            more = near[todo.pop()] - seen
            seen |= more
            todo += more
        classes[x] = frozenset(seen)
    return {x: (len(near[x]), classes[x]) for x in own}


def check(docs):
    rows = docs.collect()
    texts = {(r["doc_id"], k): x for r in rows if r["text"] is not None for k, x in enumerate(r["text"].split("\n"))}
    found = dedup_lines(docs).collect()
    want = brute([r["text"] for r in rows])
    classes = {}
    for r in found:
        line = texts[r["doc_id"], r["line_no"]]
        assert r["n_links"] == want[line][0], line
        classes.setdefault(r["class_id"], set()).add(line)
    assert {frozenset(c) for c in classes.values()} == {c for _, c in want.values()}
    assert len(found) == sum(bool(x.strip(" ")) for x in texts.values())
    return found, texts


@pytest.mark.parametrize("hot", [64, 1])
def test_against_all_pairs(documents, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() or "x" for n in (8, 10, 12, 19, 20, 21, 30, 60)]
    own = [edited(rng, b, rng.randrange(4), "abcxyz") for b in bases * 14]
    own += [f"Page number {i:03d} of this long book" for i in range(0, 60, 7)]
    rng.shuffle(own)
    docs = documents(["\n".join(own[i : i + 4]) for i in range(0, len(own), 4)])
    found, texts = check(docs)
    firsts = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["line_no"])):
        assert r["kept"] == (r["class_id"] not in firsts)
        firsts.setdefault(r["class_id"], r["line_no"])
    left = remove_lines(docs, dedup_lines(docs)).collect()
    kept = sum(r["kept"] for r in found)
    assert sum(1 for r in left for x in r["text"].split("\n") if x.strip(" ")) == kept


def test_given_documents(spark, sf_dir, given):
    rows = queries.op9_line_dedup(spark, sf_dir).collect()
    texts = {(r["doc_id"], k): x for r in given[1] for k, x in enumerate(r["text"].split("\n"))}
    classes = {}
    for r in rows:
        classes.setdefault(r["line_id"], set()).add(texts[r["doc_id"], r["line_no"]])
    assert all(len(c) == 1 for c in classes.values())
    assert len(rows) == sum(bool(x.strip(" ")) for x in texts.values())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op9_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd):
    clash = odd.withColumn("line", odd.lang).withColumn("_gone", odd.lang)
    found = dedup_lines(clash)
    assert {r["doc_id"] for r in found.collect()} == {3, 4, 5, 6, 7, 8, None}  # a tab is no blank
    left = remove_lines(clash, found)
    assert left.columns == clash.columns and left.count() == odd.count()
    assert dedup_lines(odd.limit(0)).count() == 0


def test_lines_as_long_look_one_way_only():
    """Of two lines as long, what is moved lies ahead in one of them: only that one looks."""
    for edits in (1, 2, 3):
        assert not [p for p in lines._places(edits) if not p[0] and p[2] < 0]


def test_pairs_moved_either_way(documents):
    base = "the first part of it, then some middle, and at last the end"
    moved = [base[1:] + "x", "y" + base[:-1], base[:9] + base[10:] + "z", base[:9] + "q" + base[9:-1]]
    check(documents(["\n".join([base, *moved])]))


def test_letters_rule_out_pairs_before_the_table_is_followed(spark):
    rng, rows = random.Random(3), []
    for _ in range(600):
        a = "".join(rng.choice(" eantiorbé") for _ in range(40))
        rows.append((a, edited(rng, a, rng.randrange(8), " eantiorbé")))
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(F.levenshtein("a", "b").alias("w"), lines.letters_near(F.col("a"), F.col("b"), 2).alias("m")).collect()
    assert all(r["m"] for r in got if r["w"] <= 2)
    assert sum(not r["m"] for r in got if r["w"] > 4) > 20
