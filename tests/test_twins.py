"""Every registered query against its DuckDB twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import harness

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, fn in entry.queries().items() if name not in entry.LLM_QUERIES}
TWINS = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
# no SQL form: exact fuzzy ratio, sequential grouping, model training
WITHOUT_TWIN = {
    "d14_by_name", "d15_candidates", "d16_resolve_by_name", "d22_fill_template", "e2_resolve_names", "e5_match_report",
    "e5_match_problems", "k6_train_and_predict", "k7_model_scores", "k10_cross_validate", "k10_fold_scores",
    "k22_permutation_importance",
}


@pytest.fixture(scope="module")
def con():
    return harness.connect(FOLDER)


def test_every_query_has_a_twin_or_a_reason():
    assert set(QUERIES) - set(TWINS) == WITHOUT_TWIN


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    status, _, detail = harness.check(spark, con, FOLDER, name, QUERIES[name], TWINS[name])
    assert status == "ok", f"{status}: {detail}"


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "mark" in rows.columns
