"""Every analysis on a small table, and the traps of their semantics."""

import pytest

from changelens.errors import EngineError, translated
from changelens.functions.columns import CHANGES
from changelens.options import Options
from changelens.plans.runner import cells, run

SAMPLE = [
    ("1", "Ada", "2024-01-01", "a.rs", 3, 1), ("1", "Ada", "2024-01-01", "b.rs", 2, 0), ("2", "Bea", "2024-01-02", "a.rs", 1, 1),
    ("3", "Ada", "2024-01-03", "a.rs", 4, 0), ("3", "Ada", "2024-01-03", "b.rs", 1, 0),
]
ONE = {"min_revs": 1, "min_shared_revs": 1, "min_coupling": 1}
EXPECTED = {
    "summary": [("number-of-commits", 3), ("number-of-entities", 2), ("number-of-change-rows", 5), ("number-of-authors", 2)],
    "authors": [("a.rs", 2, 3), ("b.rs", 1, 2)],
    "revisions": [("a.rs", 3), ("b.rs", 2)],
    "revision-churn": [("a.rs", 3, 10), ("b.rs", 2, 3)],
    "risk": [("a.rs", "100.00", 3, 10, 2, "44.44"), ("b.rs", "50.83", 2, 3, 2, "0.00")],
    "coupling": [("a.rs", "b.rs", 66, 2)],
    "soc": [("a.rs", 2), ("b.rs", 2)],
    "entity-effort": [("a.rs", "Ada", 2, 3), ("a.rs", "Bea", 1, 3), ("b.rs", "Ada", 2, 2)],
    "main-dev-by-revs": [("a.rs", "Ada", 2, "66.67"), ("b.rs", "Ada", 2, "100.00")],
    "fragmentation": [("a.rs", "44.44"), ("b.rs", "0.00")],
    "communication": [("Ada", "Bea", 1)],
    "abs-churn": [("2024-01-03", 5, 0), ("2024-01-02", 1, 1), ("2024-01-01", 5, 1)],
    "author-churn": [("Ada", 10, 1), ("Bea", 1, 1)],
    "entity-churn": [("a.rs", 8, 2, 3), ("b.rs", 3, 0, 2)],
    "entity-ownership": [("a.rs", "Ada", 7, 1), ("a.rs", "Bea", 1, 1), ("b.rs", "Ada", 3, 0)],
    "main-dev": [("a.rs", "Ada", 7, "87.50"), ("b.rs", "Ada", 3, "100.00")],
    "age": [("a.rs", 0), ("b.rs", 0)],
}


def table(spark, name, data, **options):
    return [tuple(r) for r in cells(run(name, spark.createDataFrame(data, CHANGES), Options(**options))).collect()]


@pytest.mark.parametrize("name", EXPECTED)
def test_sample(spark, name):
    assert table(spark, name, SAMPLE, **ONE) == EXPECTED[name]


def test_identity_shows_missing_counts(spark):
    assert table(spark, "identity", [("1", "A", "2024-01-01", "x", None, 2)]) == [("x", "A", "2024-01-01", "1", "-", "2")]


def test_age_until_a_day(spark):
    assert table(spark, "age", SAMPLE, age_time_now="2024-02-01", **ONE) == [("a.rs", 29), ("b.rs", 29)]
    with pytest.raises(EngineError, match="no dates"):
        table(spark, "age", [])


def test_ties_go_to_the_larger_author(spark):
    rows = [("1", "Ada", "2024-01-01", "x", 5, 0), ("2", "Bea", "2024-01-02", "x", 5, 0)]
    assert table(spark, "main-dev", rows, min_revs=1) == [("x", "Bea", 5, "50.00")]


def test_main_dev_omits_entities_without_additions(spark):
    rows = [("1", "Ada", "2024-01-01", "gone.rs", 0, 10), ("2", "Bea", "2024-01-02", "mixed.rs", 1, 50), ("3", "Ada", "2024-01-03", "mixed.rs", 5, 0)]
    assert [r[:3] for r in table(spark, "main-dev", rows, min_revs=1)] == [("mixed.rs", "Ada", 5)]


def test_rounding_ties_to_even(spark):
    rows = [(str(i), a, "2024-01-01", "t.rs", 1, 0) for i, a in enumerate("AAAAAABC")]
    assert table(spark, "fragmentation", rows, min_revs=1) == [("t.rs", "40.62")]


def test_several_authors_of_one_commit_make_fragmentation_negative(spark):
    rows = [("1", "A", "2024-01-01", "x", 1, 0), ("1", "B", "2024-01-01", "x", 1, 0)]
    assert table(spark, "fragmentation", rows, min_revs=1) == [("x", "-100.00")]


def test_days_merge_commits_of_an_author(spark):
    rows = [(r, "Ada", "2024-01-01", e, 1, 0) for r in "12" for e in ("a.rs", "b.rs")]
    day = dict(ONE, temporal_period="day")
    assert table(spark, "coupling", rows, **day) == [("a.rs", "b.rs", 100, 1)]
    assert table(spark, "coupling", rows, **dict(day, min_revs=2)) == []
    assert table(spark, "risk", rows, **day)[0][2:5] == (1, 2, 1)
    rows = [("1", "Ada", "2024-01-01", "a.rs", 1, 0), ("2", "Ada", "2024-01-01", "a.rs", 1, 0), ("3", "Bea", "2024-01-01", "a.rs", 1, 0)]
    assert table(spark, "risk", rows, **day)[0][2:] == (2, 3, 0, "50.00")


def test_large_changesets_count_as_commits_but_make_no_pairs(spark):
    rows = [("1", "A", "2024-01-01", e, 1, 0) for e in "xyz"]
    assert len(table(spark, "coupling", rows, max_changeset_size=3, **ONE)) == 3
    assert table(spark, "coupling", rows, max_changeset_size=2, **ONE) == []
    assert table(spark, "soc", rows, max_changeset_size=2, **ONE) == []
    assert len(table(spark, "risk", rows, max_changeset_size=2, **ONE)) == 3


def test_risk_without_counts_shares_out_their_weight(spark):
    assert table(spark, "risk", [("1", "A", "2024-01-01", "x", None, None)], min_revs=1) == [("x", "46.67", 1, 0, 0, "0.00")]


@pytest.mark.parametrize("name", ["abs-churn", "author-churn", "entity-churn", "entity-ownership", "main-dev"])
def test_churn_needs_counts(spark, name):
    for row in (("1", "A", "2024-01-01", "x", None, 1), ("1", "A", "2024-01-01", "x", 1, None)):
        with pytest.raises(EngineError, match="numstat line counts"), translated():
            table(spark, name, [row, *((str(i), "B", "2024-01-02", "y", 1, 1) for i in range(9))])


@pytest.mark.parametrize("name", sorted(set(EXPECTED) - {"age", "summary"}))
def test_no_changes(spark, name):
    assert table(spark, name, []) == []


def test_rows_and_unknown_names(spark):
    assert len(table(spark, "abs-churn", SAMPLE, rows=2)) == 2
    assert table(spark, "revisions", SAMPLE, rows=0, min_revs=1) == []
    assert table(spark, "summary", [])[0] == ("number-of-commits", 0)
    with pytest.raises(EngineError, match="unknown analysis"):
        table(spark, "nothing", SAMPLE)


def test_dates_sort_as_text(spark):
    rows = [("1", "A", "2024-1-9", "x", 1, 0), ("2", "A", "2024-02-01", "x", 1, 0)]
    assert [r[0] for r in table(spark, "abs-churn", rows)] == ["2024-1-9", "2024-02-01"]


def test_places_follow_the_order_of_the_limited_rows(spark):
    df = spark.createDataFrame(SAMPLE, CHANGES)
    found = run("revisions", df, Options(rows=1, min_revs=1), place="place").collect()
    assert [tuple(r) for r in found] == [("a.rs", 3, 1)]
    with pytest.raises(EngineError, match="limited number of rows"):
        run("revisions", df, place="place")
