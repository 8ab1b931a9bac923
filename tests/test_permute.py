"""Permutations of the whole table: partners and sums against the same permutation done row by row."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekin.operators import permute
from tablekin.operators.index import Indexed, column_shuffle_sweep, multiplier, offset, sample_columns, sweep_seed
from tablekin.operators.linear import column_means
from tablekin.operators.rotate import ALL, PAIR_BLOCK, TEST, _held
from tablekin.plans.queries_experiments import _trial_ctes
from tablekin.plans.queries_models import nb_importance_sql


def partner(n, seed):
    return (np.arange(n) * multiplier(seed, n) + offset(seed)) % n


def table_of(spark, x, columns):
    return Indexed(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["idx", *columns]).repartition(3), len(x))


def test_partners_come_from_the_whole_table(spark):
    n = 5000
    table = Indexed(spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("a"), (F.col("id") / 7).alias("b")), n)
    rows = permute.permuted_pairs(table, ["a", "b"], 2, 100).collect()
    assert len(rows) == 2 * n
    for k in range(2):
        want = partner(n, 100 + k)
        some = {r["idx"]: r for r in rows if r["repeat"] == k}
        assert all(some[i]["a"] == i and some[i]["_p_a"] == want[i] and some[i]["_p_b"] == want[i] / 7 for i in range(n))
    assert max(abs(r["_p_a"] - r["a"]) for r in rows) > 2 * PAIR_BLOCK


@pytest.mark.parametrize("block", [16_384, 16])
def test_sums_of_permuted_copies(spark, monkeypatch, block):
    monkeypatch.setattr(permute, "BLOCK", block)
    columns, n = ["a", "b", "d", "k"], 101
    x = np.random.default_rng(5).normal(size=(n, 4)).round(3)
    table = table_of(spark, x, columns)
    shift = column_means(table.df, columns)
    got = {(r["run"], r["rep"], r["part"]): r for r in permute.permuted_sums(table, columns, 2, 2, 2, shift, 0.2, 0.05).collect()}
    for run, rep in itertools.product(range(3), range(2)):
        moved = [columns.index(c) for c in sample_columns(columns, run, rep)]
        y = x.copy()
        if moved:
            y[:, moved] = x[partner(n, sweep_seed(run, rep))][:, moved]
        c = y - shift
        for part, rows in ((ALL, np.ones(n, bool)), (TEST, _held(np.arange(n), 42, n, 0.2)), (1, _held(np.arange(n), 1, n, 0.05))):
            cell = got[run, rep, part]
            assert cell["n"] == rows.sum() and np.allclose(cell["s"], c[rows].sum(0), atol=1e-9)
            assert np.allclose(cell["p"], (c[rows].T @ c[rows])[np.triu_indices(4)])


def test_products_of_large_row_numbers(monkeypatch):
    n, factor = (1 << 33) - 9, (1 << 33) - 1234567
    a = np.array([n - 1, n // 2, 12345678901 % n])
    assert permute._times(a, factor, n).tolist() == [int(v) * factor % n for v in a]


def test_sql_permutes_the_whole_table():
    ctes, _ = nb_importance_sql("x", "parts", "brand", ["size", "brand"], 0, 2)
    assert any("ON d.rid = ((a.rid *" in c for c in ctes) and "ON d.idx = ((a.idx *" in _trial_ctes(1, 1, 1)


def test_sweep_sends_packed_rows_and_keeps_nulls(spark):
    n = 300
    x = [(i, float(i) / 3 if i % 7 else None, float(i), float("nan") if i == 5 else -float(i)) for i in range(n)]
    table = Indexed(spark.createDataFrame(x, "idx long, a double, b double, c double").repartition(3), n)
    sweep = column_shuffle_sweep(table, ["a", "b", "c"], 2, 2)
    plan = sweep._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
    got = {(r["run"], r["rep"], r["idx"]): r for r in sweep.collect()}
    assert len(got) == 3 * 2 * n
    for run, rep in itertools.product(range(3), range(2)):
        moved, there = sample_columns(["a", "b", "c"], run, rep), partner(n, sweep_seed(run, rep))
        for i in range(n):
            want = [x[there[i] if c in moved else i][k] for k, c in enumerate("abc", 1)]
            assert repr([got[run, rep, i][c] for c in "abc"]) == repr(want)
