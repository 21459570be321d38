import re

import duckdb
import pytest

from grantlens.llm import queries
from grantlens.llm.decontaminate import find_contamination, remove_documents, remove_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(s):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))


def brute(docs, items, window=10):
    out = []
    for _, text in docs:
        w, hit, names = words_of(text), set(), set()
        for name, item in items:
            own = words_of(item)
            m = min(window, len(own))
            found = False
            for i in range(len(own) - m + 1) if m else ():
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == own[i : i + m]:
                        hit.update(range(p, p + m))
                        found = True
            if found and name is not None:
                names.add(str(name))
        out.append((len(w), sorted(hit), sorted(names)))
    return out


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Short item, here!"),
    (3, None),
    (4, "..."),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa other"),
    (None, "nameless item of words"),
    (2, "short item here"),
]
DOCS = [
    (1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu y"),
    (2, "ALPHA, beta gamma-delta epsilon zeta eta theta iota"),  # nine words
    (3, "a short item here and short. item; here"),
    (4, None),
    (5, ""),
    (6, "nameless item of words"),
    (7, "gamma delta epsilon zeta eta theta iota kappa lambda mu gamma delta"),
    (7, "short item"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = find_contamination(docs, items, block_bytes=block_bytes).collect()
    got = [
        (r["n_words"], [i for s in r["hit_spans"] for i in range(s["first"], s["end"])], r["hit_items"])
        for r in rows
    ]
    assert got == brute(DOCS, ITEMS)
    assert [r["contaminated"] for r in rows] == [bool(x[1]) for x in brute(DOCS, ITEMS)]
    assert all(r["n_hit"] == len(x[1]) for r, x in zip(rows, got, strict=True))


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLES["op2_decontamination"]).fetchall())
    got = sorted(map(tuple, queries.op2_decontamination(spark, sf_dir).collect()))
    assert got == want
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = find_contamination(docs, items)
    assert [r["doc_id"] for r in remove_documents(found).collect()] == [2, 4, 5, 7]
    cut = remove_spans(found).collect()
    assert cut[0]["text"].split() == ["x", "y"]
    assert words_of(cut[2]["text"]) == ["a", "and"]
    assert cut[3]["text"] is None and cut[1]["text"] == DOCS[1][1]


def test_odd_rows(odd, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clash = odd.withColumn("n_hit", odd.lang).withColumn("_now", odd.source)
    found = find_contamination(clash, items)
    assert found.columns[: len(odd.columns) + 1] == [*odd.columns, "_now"]
    assert found.count() == odd.count()
    assert found.where("contaminated").count() == 0
    assert find_contamination(odd.limit(0), items).count() == 0
    nothing = find_contamination(odd, items.limit(0))
    assert nothing.where("contaminated or n_words is null").count() == 0
