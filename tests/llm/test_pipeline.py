import collections

import corpus_pipeline as pipeline
from grantlens.llm import queries
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_minhash import brute as classes


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == [
        "language_id", "near_dedup", "decontamination", "mixing", "sharding",
    ]
    assert all(name in queries.QUERIES for name in queries.ORACLES)


def test_stages_by_brute_force(spark, sf_dir, given):
    docs, rows = given
    kept = {}
    for name, stage in pipeline.STAGES[:3]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        kept[name] = collections.Counter(r["doc_id"] for r in after.collect())
    assert set(kept["language_id"].values()) == {1} and len(kept["language_id"]) >= len(rows) - 2
    want = classes([(r["doc_id"], r["text"]) for r in rows])
    assert kept["near_dedup"] == collections.Counter(i for i, c in want.items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = contaminated([(r["doc_id"], r["text"]) for r in rows], items)
    clean = [r["doc_id"] for r, (_, hit, _) in zip(rows, hits, strict=True) if not hit]
    assert kept["decontamination"] == collections.Counter(clean)


def test_run(spark, sf_dir, given):
    docs, _ = given
    out = pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2
    whole = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} <= whole


def test_odd_rows(odd, given, spark, sf_dir):
    docs = odd.withColumn("kept", odd.lang)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.count() <= 2 * docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
