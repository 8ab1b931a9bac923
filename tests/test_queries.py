"""Registered queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

QUICK = [
    "read_headerless", "read_indexed_csv", "read_results_json", "read_score_lists", "read_result_vectors", "logistic_per_target", "logistic_coefficients", "impute_mean", "impute_most_frequent", "factorize",
    "ordinal_encode_fit_a_apply_b", "holdout_split", "joint_column_shuffle", "column_shuffle_sweep", "profile_table",
    "compare_univariate", "linear_per_target", "gaussian_nb_per_target", "knn_per_target", "permutation_importance",
    "permutation_importance_linear", "compare_importances", "utility_both_directions", "flatten_results", "pivot_multi_value",
    "box_stats", "step_difference", "shuffle_trial", "compare_datasets",
]


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, name, SF).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
