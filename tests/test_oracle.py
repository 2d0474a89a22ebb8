"""Registered queries against their DuckDB oracles on the smallest scale factor."""

import pytest

from conftest import SF001
from gramframe.plans import ORACLE, QUERIES
from gramframe.plans.compare import compare

FAST = ["q_profile", "q_class_counts", "q_missing", "q_duplicates", "q_label_domain_docs", "q_stratified_split",
        "q_balanced_subset", "q_balanced_subset_runs", "q_undersample", "q_stratified_folds", "q_fit_median",
        "q_preprocess_train_test", "q_metrics", "q_roc_auc", "q_average_precision", "q_map_params_pauli",
        "q_kernel_pauli", "q_kernel_custom_r2", "q_kernel_zz_r2", "q_kernel_vectors", "q_outcome_probability",
        "q_kernel_mirror", "q_kernel_diagnostics", "q_kernel_score_metrics", "q_compare_models_pauli",
        "q_kernel_svm_eval", "q_compare_svm_pauli"]


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"q_kernel_spectrum", "q_compare_models_custom", "q_rbf_svm_cv", "q_rbf_svm_eval", "q_two_kernel_eval",
                         "q_bench_kernel_custom_r2", "q_summary", "q_compare_models"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, name):
    res = compare(spark, name, SF001, QUERIES[name], ORACLE[name])
    assert res["ok"], res


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["n"] == 64
