"""Shuffle trials: independent draws, and nothing but sums written."""

from pathlib import Path

import pytest

from tablekin.operators.index import SWEEP_SEEDS, multiplier, offset, sweep_seed
from tablekin.plans.bindings import SHAPES, coded_docs, coded_rows, part_shapes, table
from tablekin.plans.experiment import shuffle_trial

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_cells_of_a_trial_have_different_permutations():
    seeds = [sweep_seed(run, rep) for run in range(1, 10) for rep in range(20)]
    assert len({(multiplier(s), offset(s)) for s in seeds}) == len(seeds)
    assert min(seeds) >= SWEEP_SEEDS > 42


def test_multiplier_does_not_divide_the_row_number():
    first = multiplier(0)
    assert multiplier(0, first) == multiplier(1)
    assert multiplier(3) > multiplier(2) > first


def test_trial_writes_sums_only(spark):
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    shapes = part_shapes(spark, SF)
    before = set(scratch.iterdir())
    scores, _ = shuffle_trial(shapes, SHAPES, ("gaussian_nb", "linear"), 6, 10, cross_models=("gaussian_nb", "linear"))
    assert scores.select("run", "rep").distinct().count() == 70
    written = {p.name.split("-")[1] for p in set(scratch.iterdir()) - before}
    assert written == {"sums", "importance"}


def test_documents_without_labels_take_part(spark):
    assert coded_docs(spark, SF).n == table(spark, SF, "documents").count()


def test_rows_without_numbers_are_the_coded_rows(spark):
    from tablekin.plans.bindings import ITEMS, coded_items

    plain, numbered = coded_rows(spark, SF), coded_items(spark, SF).df.select(*ITEMS.columns)
    assert plain.exceptAll(numbered).isEmpty() and numbered.exceptAll(plain).isEmpty()


def test_the_original_is_fitted_once_for_all_copies(spark, monkeypatch):
    from tablekin.operators import utility
    from tablekin.operators.index import Indexed
    from tablekin.plans import experiment
    from tablekin.roles import Roles

    fits, ranked = [], []
    fit, rank = utility.fit_all_targets, experiment.mean_importances
    monkeypatch.setattr(utility, "fit_all_targets", lambda *a, **k: fits.append(1) or fit(*a, **k))
    monkeypatch.setattr(experiment, "mean_importances", lambda *a, **k: ranked.append(1) or rank(*a, **k))
    rows = [(i, float(i * i % 17), float(i * 5 % 11), float(i % 3)) for i in range(60)]
    table = Indexed(spark.createDataFrame(rows, "idx long, a double, b double, k double"), 60)
    scores, cross = shuffle_trial(table, Roles(("a", "b", "k"), ("a", "b")), ("gaussian_nb", "linear"), 1, 2, 1, repeats=1, cross_models=("gaussian_nb", "linear"))
    assert len(fits) == 3 and len(ranked) == 3  # the original and two copies; run 0 is the original
    assert {(r["run"], r["rep"]) for r in cross.collect()} == {(k, r) for k in range(2) for r in range(2)}
    same = scores.where("run = 0").select("rep", "target", "metric", "value").collect()
    assert {r["rep"] for r in same} == {0, 1} and all(r["value"] == pytest.approx(1.0) for r in same if r["metric"] == "kendall_tau")
    sides = {(r["rep"], r["train_side"], r["target"]): r["ratio"] for r in cross.where("run = 0").collect()}
    assert all(sides[r, "a", t] == sides[r, "b", t] for r, _, t in sides)
