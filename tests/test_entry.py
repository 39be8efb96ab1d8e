"""The driver's entry, with the corpus subpackage and without what it needs."""

import sys

import __spark_entry__
from changelens.plans import catalog


def test_change_queries_stay_where_a_corpus_library_is_missing(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("changelens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    assert set(__spark_entry__.queries()) == set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) == set(catalog.oracle_sql())


def test_every_query_of_changes_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
