import numpy as np
import pyarrow as pa

from grantlens.llm import quality, queries
from grantlens.llm.quality import NeighbourModel, score, train
from grantlens.llm.words import blocks


def test_held_out_quality(spark):
    rows = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    truth = {
        r["doc_id"]: r["quality"]
        for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    }
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])
    assert len(rows) == 1000 and len(held) > 40 and right > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_votes_are_those_of_the_nearest():
    good = [f"Some plain words number {i} in a row, and more of them." for i in range(40)]
    bad = [f"BUY!! NOW!! {i} $$$ {i} $$$ {i} $$$" for i in range(40)]
    model = NeighbourModel.fit(good + bad, np.array([1] * 40 + [0] * 40), (1.0, 0.1))
    texts = pa.array(["Other plain words stand in this row.", "SELL!! IT!! 5 $$$ 5 $$$", "", None])
    got = model.score(texts).to_pylist()
    assert got[0] > 0.9 and got[1] < 0.3 and got[2] == got[3] == model.prior
    (block,) = blocks(texts)
    x = model.weighted(quality.features(block), model.weight) @ model.axes
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    for t in (0, 1):
        near = x[t] @ model.vectors.T
        top = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
        w = np.maximum(near[top], 0) ** quality.SHARPNESS
        both = (w[:, None] * model.votes[top]).sum(axis=0)
        assert abs(got[t] - both[1] / both.sum()) < 1e-4


def test_features_do_not_depend_on_the_block():
    texts = ["One two. Two, ONE!", "", "a a a b12 c", "ß é\tÉ"]
    (whole,) = blocks(pa.array(texts))
    alone = [quality.features(b) for b in blocks(pa.array(texts), 1)]
    assert (quality.features(whole) == np.concatenate(alone)).all()


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (7, 1, 1), (7, 0, 1), (99, 1, 0), (8, 5, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = train(odd, labels)
    scored = score(odd.withColumn("quality_score", odd.lang), model)
    assert scored.count() == odd.count()
    assert scored.where("quality_score is null or quality_score not between 0 and 1").count() == 0
    assert score(odd.limit(0), model).count() == 0
    assert train(odd, labels.limit(0)) is None
    assert {r["quality_score"] for r in score(odd, None).collect()} == {0.5}
