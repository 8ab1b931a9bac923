"""Exact trees against a plain recursion, and what is built on them."""

import itertools
from collections import Counter
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekin.operators import rotate, trees
from tablekin.operators.estimators import FITTERS, tree_rule
from tablekin.operators.importance import importance
from tablekin.operators.index import Indexed, multiplier, sample_columns, sweep_seed
from tablekin.operators.linear import column_means
from tablekin.operators.synth import sequential_cart_synthesis
from tablekin.plans.experiment import shuffle_trial, summary
from tablekin.roles import Roles

NAMES = ["x0", "node", "target", "y"]  # names that the operator uses itself
ROLES = Roles(tuple(NAMES), ("x0", "node", "target"))


def numbers(n=300, seed=2):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 4)), 1)
    x[:, 2] = np.round(x[:, 0] * 2 + draw.normal(size=n) * 0.2, 1)
    x[:, 3] = (x[:, 1] > 0).astype(int) + (x[:, 0] > 0.5)
    x[5:9] = x[4]  # repeated rows
    return x


def frame(spark, x, names=NAMES, parts=3):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "idx long, " + ", ".join(f"`{n}` double" for n in names)).repartition(parts)


def plain_tree(x, y, classifier, depth=None, least=1, node=""):
    """Nodes {path: (n, feature, threshold)} by trying every cut."""
    out = {node: (len(x), None, None)}
    if len(set(y)) == 1 or (depth is not None and len(node) >= depth):
        return out
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            if min(left.sum(), (~left).sum()) < least:
                continue
            if classifier:
                score = sum(sum(c * c for c in Counter(side.tolist()).values()) / len(side) for side in (y[left], y[~left]))
            else:
                score = sum(float(side.sum()) ** 2 / len(side) for side in (y[left], y[~left]))
            if best is None or score > best[0]:
                best = (score, f, low, high, left)
    if best is None:
        return out
    _, f, low, high, left = best
    out[node] = (len(x), f, low + (high - low) / 2)
    out |= plain_tree(x[left], y[left], classifier, depth, least, node + "0")
    return out | plain_tree(x[~left], y[~left], classifier, depth, least, node + "1")


def nodes_of(model):
    rows = model.nodes.select("target", "node", "n", "feature", "threshold").collect()
    return {(r["target"], r["node"]): (r["n"], r["feature"], r["threshold"]) for r in rows}


@pytest.mark.parametrize("depth, least", [(None, 1), (3, 1), (None, 7)])
def test_trees_equal_a_plain_recursion(spark, depth, least):
    x = numbers()
    model = trees.fit_trees(frame(spark, x), ROLES, rule=trees.Rule(depth, least))
    got = nodes_of(model)
    for t, name in enumerate(NAMES):
        rest = np.delete(x, t, axis=1)
        middle, unit = model.scales.get(name, (0.0, 1.0))
        y = np.floor((x[:, t] - middle) / unit + 0.5).astype(np.int64)  # whole units: no cut is better by rounding alone
        assert name == "y" or np.abs(y * unit + middle - x[:, t]).max() < 1e-7
        want = plain_tree(rest, y, name == "y", depth, least)
        assert {k: v for (n, k), v in got.items() if n == name} == want


def test_large_nodes_give_the_same_trees(spark, monkeypatch):
    df = frame(spark, numbers(80))
    small = trees.fit_trees(df, ROLES, ["y", "target"])
    whole = nodes_of(small)
    want = sorted(map(tuple, trees.predict(df, small, 80, ["idx"]).collect()))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 25)
    large = trees.fit_trees(df, ROLES, ["y", "target"])
    assert nodes_of(large) == whole and large.nodes.where("big").count() > 0
    assert sorted(map(tuple, trees.predict(df, large, 80, ["idx"]).collect())) == want
    monkeypatch.setattr(trees, "BLOCK_ROWS", 9)
    assert sorted(map(tuple, trees.predict(df, large, 80, ["idx"]).collect())) == want


def test_forests_do_not_depend_on_partitions_or_copies(spark, monkeypatch):
    rule = tree_rule("forest", trees=4)
    x = numbers(60)
    first = trees.fit_trees(frame(spark, x, parts=1), ROLES, ["y", "x0"], rule=rule)
    key = lambda m: sorted(map(str, m.nodes.drop("big", "root", "copy").collect()))
    want = key(first)
    assert want == key(trees.fit_trees(frame(spark, x, parts=16), ROLES, ["y", "x0"], rule=rule))
    tagged = frame(spark, x).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    both = trees.fit_trees(tagged, ROLES, ["y", "x0"], ["copy"], rule)
    for c in (1, 2):
        part = trees.Trees(both.nodes.where(F.col("copy") == c).select(*first.nodes.columns), first.keys, ROLES, first.targets, both.scales, rule)
        assert key(part) == want
    monkeypatch.setattr(trees, "LOCAL_ROWS", 20)
    assert key(trees.fit_trees(frame(spark, x), ROLES, ["y", "x0"], rule=rule)) == want
    said = trees.predict(frame(spark, x), first, 60, ["idx"]).where("target = 'y'").toPandas()
    assert len(said) == 60 and (said.y == said.prediction).mean() > 0.8


def test_odd_tables(spark):
    same = frame(spark, np.ones((6, 4)))
    assert nodes_of(trees.fit_trees(same, ROLES)) == {(n, ""): (6, None, None) for n in NAMES}
    assert {r["score"] for r in importance(Indexed(same, 6), ROLES, ("tree", "tree"), reps=1).collect()} == {0.0}
    empty = same.where("idx < 0")
    assert trees.fit_trees(empty, ROLES).nodes.count() == 0
    holes = same.withColumn("node", F.when(F.col("idx") > 2, F.col("node")))
    with pytest.raises(ValueError, match="null cells"):
        trees.fit_trees(holes, ROLES)


def test_predictions_keep_the_columns(spark):
    df = frame(spark, numbers(50)).withColumn("leaf", F.lit("mine"))
    for name in ("tree", "forest"):
        model = FITTERS[name](df, "y", NAMES[:3], True, trees=3)
        out = model.predict(df.drop("y"))
        assert out.columns == ["idx", "x0", "node", "target", "leaf", "prediction"] and out.count() == 50


def test_shapley_effects_equal_the_definition():
    inf = float("inf")
    low = np.array([[-inf, -inf, -inf], [-inf, 0.5, -inf], [0.0, -inf, -inf]])
    high = np.array([[0.0, 0.5, inf], [0.0, inf, inf], [inf, inf, inf]])
    share = np.array([[0.6, 0.75, 1.0], [0.6, 0.25, 1.0], [0.4, 1.0, 1.0]])
    x = np.array([[-2.0, 0.7, 1.0], [0.3, 0.1, 2.0], [-0.5, 0.2, 3.0]])
    got = trees.shapley_effects(x, low, high, share)
    worth = lambda row, k, known: np.prod([(low[k, f] < row[f] <= high[k, f]) if f in known else share[k, f] for f in range(3)])
    for k, f in itertools.product(range(3), range(3)):
        others = [g for g in range(3) if g != f]
        want = sum(
            factorial(m) * factorial(2 - m) / 6 * (worth(row, k, {*s, f}) - worth(row, k, set(s)))
            for row in x for m in range(3) for s in itertools.combinations(others, m)
        )
        assert got[k, f] == pytest.approx(want)


@pytest.mark.parametrize("width, most", [(1, 10), (3, 10), (4, 2)])
def test_shapley_totals_count_rows_by_pattern(monkeypatch, width, most):
    monkeypatch.setattr(trees, "ROW_BLOCK", 64)
    monkeypatch.setattr(trees, "LEAVES_AT_ONCE", 16)
    monkeypatch.setattr(trees, "PATTERN_FEATURES", most)
    draw = np.random.default_rng(width)
    x = draw.integers(-5, 6, (150, width)) / 2
    low = draw.integers(-5, 2, (60, width)) / 2
    high = low + draw.integers(0, 6, (60, width)) / 2
    low[draw.random(low.shape) < 0.4], high[draw.random(high.shape) < 0.4] = -np.inf, np.inf
    share = np.where(np.isfinite(low) | np.isfinite(high), draw.random(low.shape), 1.0)
    assert trees.shapley_totals(x, low, high, share) == pytest.approx(trees.shapley_effects(x, low, high, share))
    x[7, 0] = np.nan
    assert trees.shapley_totals(x, low, high, share) == pytest.approx(trees.shapley_effects(x, low, high, share))
    counts = trees.pattern_counts(x, low, high)
    assert counts.min() >= 0 and (counts.sum(0) == len(x)).all()


def test_one_leaf_that_holds_all_rows_can_be_drawn_from(spark):
    x = np.c_[np.ones(120), np.arange(120.0)]
    made = sequential_cart_synthesis(Indexed(frame(spark, x, ["a", "b"]), 120), Roles(("a", "b"), ("a", "b"))).toPandas()
    assert len(made) == 120 and set(made["b"]) <= set(range(120)) and made["b"].nunique() > 50


def test_trial_of_trees_grows_all_copies_together(spark):
    table = Indexed(frame(spark, numbers(120), ["a", "b", "d", "k"]), 120)
    roles = Roles(("a", "b", "d", "k"), ("a", "b", "d"))
    scores, cross = shuffle_trial(table, roles, ("tree", "linear"), 2, 2, 2)
    rows = summary(scores, cross, ["run", "rep"]).collect()
    assert {(r["run"], r["rep"]) for r in rows} == set(itertools.product(range(3), range(2)))
    assert all(r["value"] == pytest.approx(1.0) for r in rows if r["run"] == 0)
    assert any(r["value"] < 0.99 for r in rows if r["run"] == 2)


@pytest.mark.parametrize("block", [4096, 16])
def test_sums_of_shuffled_copies(spark, monkeypatch, block):
    monkeypatch.setattr(rotate, "BLOCK", block)
    monkeypatch.setattr(rotate, "block_count", lambda n, size=None: max(1, -(-n // (size or block))))
    x, columns, n = numbers(101), ["a", "b", "d", "k"], 101
    table = Indexed(frame(spark, x, columns), n)
    shift = column_means(table.df, columns)
    got = {(r["run"], r["rep"], r["part"]): r for r in rotate.shuffled_sums(table, columns, 2, 2, 2, shift, 0.2, 0.05).collect()}
    m = max(1, -(-n // block))
    for run, rep in itertools.product(range(3), range(2)):
        moved = [columns.index(c) for c in sample_columns(columns, run, rep)]
        y = x.copy()
        for b in range(m):
            first, last = -(-b * n // m), -(-(b + 1) * n // m)
            step = 1 + multiplier(sweep_seed(run, rep)) % (last - first - 1)
            for i in range(first, last):
                y[i, moved] = x[first + (i - first + step) % (last - first), moved]
        assert sorted(map(tuple, y[:, moved])) == sorted(map(tuple, x[:, moved]))
        c = y - shift
        cell = got[run, rep, rotate.ALL]
        assert cell["n"] == n and np.allclose(cell["s"], c.sum(0), atol=1e-9) and np.allclose(cell["p"], (c.T @ c)[np.triu_indices(4)])
        held = rotate._held(np.arange(n), 1, n, 0.05)
        cell = got[run, rep, 1]
        assert cell["n"] == held.sum() and np.allclose(cell["p"], (c[held].T @ c[held])[np.triu_indices(4)])


def test_partners_stay_in_the_block_and_move(spark):
    table = Indexed(frame(spark, numbers(90), ["a", "b", "d", "k"]).withColumn("a", F.col("idx").cast("double")), 90)
    rows = rotate.shuffled_pairs(table, ["a", "b"], 3, 100).collect()
    assert len(rows) == 270
    for k in range(3):
        some = [r for r in rows if r["repeat"] == k]
        assert sorted(r["_p_a"] for r in some) == sorted(r["a"] for r in some) and all(r["a"] != r["_p_a"] for r in some)


def test_running_sums_of_one_large_group(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("v"), (F.col("id") % 7).alias("k"))
    got = {r["v"]: r["k_upto"] for r in trees.running_sums(df, ["g"], ["v"], ["k"]).collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(500)}


def test_a_node_of_many_rows_is_grown_in_one_task(spark):
    from pathlib import Path

    n = 70_000
    table = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") % 251).cast("double").alias("a"), (F.col("id") % 83).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("k"))
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.iterdir())
    model = trees.fit_trees(table, Roles(("a", "b", "k"), ("a", "b")), ["k"])
    assert {p.name.split("-")[1] for p in set(scratch.iterdir()) - before} == {"trees"}
    ends = model.nodes.where("feature IS NULL").agg(F.sum("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    assert ends[0] == ends[1] == n
    assert model.nodes.where("feature IS NOT NULL AND (classes IS NOT NULL OR counts IS NOT NULL)").isEmpty()


@pytest.mark.parametrize("values", [1, 2, 5, 64, 1000])
def test_rows_in_boxes_of_two_features_are_counted_without_meeting(values):
    draw = np.random.default_rng(values)
    x = draw.integers(0, values, (400, 2)).astype(float)
    low, high = draw.integers(-2, values + 1, (2, 90, 2)) + 0.5
    low[draw.random(low.shape) < 0.3], high[draw.random(high.shape) < 0.3] = -np.inf, np.inf
    want = ((x[:, None] > low) & (x[:, None] <= high)).all(2).sum(0)
    assert trees.box_counts(x, low, high).tolist() == want.tolist()
    rows, boxes = np.tile(x, (500, 1)), [np.tile(v, (2000, 1)) for v in (low, high)]  # 200 000 x 180 000: too many pairs to look at
    assert trees.box_counts(rows, *boxes).tolist() == np.tile(500 * want, 2000).tolist()


def test_leaves_are_cut_from_the_boxes_above(spark):
    x = numbers(60)
    model = trees.fit_trees(frame(spark, x), ROLES, ["y"])
    nodes = model.nodes.toArrow()
    at, low, high, share = trees.leaf_boxes(nodes, 3)
    rows = {r["node"]: r for r in nodes.to_pylist()}
    assert {nodes.column("node")[int(k)].as_py() for k in at} == {n for n, r in rows.items() if r["feature"] is None}
    for k, a, b, z in zip(at, low, high, share):
        node = nodes.column("node")[int(k)].as_py()
        assert ((x[:, :3] > a) & (x[:, :3] <= b)).all(1).sum() == rows[node]["n"]
        want = np.ones(3)
        for d in range(len(node)):
            want[rows[node[:d]]["feature"]] *= rows[node[: d + 1]]["n"] / rows[node[:d]]["n"]
        assert z == pytest.approx(want)


def test_shapley_values_send_neither_steps_nor_leaves_to_joins(spark, monkeypatch):
    from tablekin.operators.importance import shap_mean_importance

    x = numbers(90)
    table, roles = Indexed(frame(spark, x, ["a", "b", "d", "k"]), 90), Roles(("a", "b", "d", "k"), ("a", "b", "d"))
    scores = lambda: {(r["target"], r["feature"], r["rep"]): r["score"] for r in shap_mean_importance(table, roles, 2).collect()}
    want = scores()
    model = trees.fit_trees(table.df, roles)
    plan = trees.shapley_sums(table.df, model, 90)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    monkeypatch.setattr(trees, "MOST_ROWS", 25)
    monkeypatch.setattr(trees, "MOST_LEAVES", 7)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 30)
    assert scores() == pytest.approx(want)


def test_a_forest_is_asked_where_it_is_grown(spark, monkeypatch):
    from dataclasses import replace
    from pathlib import Path

    df = frame(spark, numbers(70)).withColumn("copy", (F.col("idx") % 2).cast("int"))
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.iterdir())
    model = trees.fit_trees(df, ROLES, ["y", "x0"], ["copy"], tree_rule("forest", trees=5))
    monkeypatch.setattr(trees, "VOTERS", 16)
    found = trees.predict(df, model, 35, ["idx"], ["copy"]).collect()
    assert {p.name.split("-")[1] for p in set(scratch.iterdir()) - before} == {"blocks"}  # neither drawn rows nor nodes are written
    of = lambda rows: {(r["target"], r["copy"], r["idx"]): (r["y"], r["prediction"]) for r in rows}
    slow = of(trees.predict(df, replace(model, rows=None), 35, ["idx"], ["copy"]).collect())
    assert len(found) == 140 and of(found).keys() == slow.keys()
    assert all(v == pytest.approx(slow[k]) for k, v in of(found).items())
