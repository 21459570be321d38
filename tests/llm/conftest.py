import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    """The given documents as rows, and the frame."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return frame, frame.orderBy("doc_id").collect()


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, schema=DOCS):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else tuple(r)
            r = r + ("en", "s")[: 4 - len(r)] if len(r) < 4 else r
            full.append((*r[:4], None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd(documents):
    """Nulls in any column, empty, blank, short and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 700}" for i in range(20_000))
    return documents(
        [
            (1, None, None, None),
            (2, "", "en", "a"),
            (3, "  \n\t ", "en", "a"),
            (4, "one", "en", None),
            (5, "Ünïcode wörds! 123 ... ", "de", "b"),
            (6, long, "en", "a"),
            (7, long, "fr", "b"),
            (8, "same text twice here now", "en", "a"),
            (8, "same text twice here now", "en", "a"),
            (None, "no id at all", "en", "a"),
            (None, None, None, None),
        ]
    )
