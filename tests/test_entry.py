import importlib
import sys

import __spark_entry__ as entry
from harness.queries import QUERIES


def test_the_rest_works_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(QUERIES) == set(bare.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
