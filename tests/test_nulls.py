"""Null cells are an error or have a code of their own; cells of a sweep are independent."""

import pytest

from tablekin.operators.bayes import gaussian_nb_all_targets
from tablekin.operators.index import sweep_seed
from tablekin.operators.linear import product_sums
from tablekin.operators.neighbors import NearestNeighbours
from tablekin.operators.report import category_code


@pytest.fixture(scope="module")
def gap(spark):
    return spark.createDataFrame([(k, float(k), 2.0 * k if k != 7 else None, float(k % 2)) for k in range(20)], "idx long, x double, z double, t double")


def test_models_refuse_null_cells(gap):
    with pytest.raises(ValueError, match="z"):
        product_sums(gap, ["x", "z"])
    with pytest.raises(ValueError, match="z"):
        gaussian_nb_all_targets(gap, ["x", "z", "t"], ["t"])
    with pytest.raises(ValueError, match="null cells"):
        NearestNeighbours(gap, "t", ["x", "z"], True)


def test_missing_category_has_code(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k int, c string")
    assert sorted((r["k"], r["code"]) for r in category_code(df, "c").collect()) == [(1, 1), (2, -1), (3, 0)]


def test_sweep_seeds_are_distinct():
    seeds = [sweep_seed(run, rep) for run in range(1, 10) for rep in range(20)]
    assert len(set(seeds)) == len(seeds)
    assert not set(seeds) & set(range(100))
