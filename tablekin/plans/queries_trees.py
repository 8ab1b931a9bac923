"""Queries of exact trees, forests and what is built on them, on the whole of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import importance, synth, trees, utility
from ..operators.estimators import tree_rule
from ..operators.index import Indexed, row_index
from ..roles import Roles
from .bindings import (
    DOCS, PARTS, PARTS_SQL, coded_docs, coded_parts, inverse_sql, linear_importance_sql, measures_sql, part_rows, permuted_sql, residual_sql,
    rnd, rounded, shuffled, shuffled_sql,
)
from .experiment import compare_datasets, method_sweep, shuffle_trial, summary
from .queries_data import _sweep_sql
from .queries_models import REPS, both_sql, utility_ctes
from .registry import query
from .tree_sql import (
    feature_names_sql, forest_votes_sql, grow_sql, importance_sql, inputs_sql, land_sql, samples_sql, scales_sql,
)

WIDTH = len(PARTS.columns) - 1
MOVED = ("price", "brand")
_GROWN = ",\n".join(
    [f"WITH RECURSIVE {PARTS_SQL}", scales_sql("scales", "parts", PARTS.continuous), samples_sql("sampled", "parts", "scales", PARTS, PARTS.columns), grow_sql("g", "sampled", ["target"], WIDTH)]
)


def _feature_names():
    cells = [F.struct(F.lit(t).alias("target"), F.lit(j).alias("feature"), F.lit(f).alias("name")) for t in PARTS.columns for j, f in enumerate(PARTS.features(t))]
    return F.array(*cells)


@query(
    "tree_per_target",
    f"""{_GROWN}
SELECT target, node, CAST(length(node) AS INTEGER) AS depth, n, f.name AS feature, round(threshold, 6) AS threshold,
       round(CASE WHEN cls THEN label ELSE z.middle + z.unit * label END, 6) AS prediction
FROM g_n LEFT JOIN {feature_names_sql(PARTS, PARTS.columns)} USING (target, feature) LEFT JOIN scales z USING (target)""",
)
def tree_per_target(spark, sf):
    """Every node of the full tree of each column."""
    parts = coded_parts(spark, sf)
    model = trees.fit_trees(parts.df, PARTS)
    names = spark.range(1).select(F.inline(_feature_names()))
    rows = model.nodes.join(F.broadcast(names), ["target", "feature"], "left")
    value = trees.in_units(model, F.col("label"))
    return rows.select("target", "node", F.length("node").alias("depth"), "n", F.col("name").alias("feature"), F.round("threshold", 6).alias("threshold"), F.round(value, 6).alias("prediction"))


TREES = 100
_KEYS = ["target", "tree"]


@query(
    "forest_per_target",
    ",\n".join(
        [
            f"WITH RECURSIVE {PARTS_SQL}",
            scales_sql("scales", "parts", PARTS.continuous),
            samples_sql("sampled", "parts", "scales", PARTS, PARTS.columns, (), TREES),
            grow_sql("g", "sampled", _KEYS, WIDTH, 1),
            inputs_sql("rows_", "parts", PARTS, PARTS.columns, ["idx"], (), TREES),
            land_sql("landed", "rows_", "g_n", _KEYS, WIDTH),
            forest_votes_sql("voted", "landed", "g", "scales", ["idx"]),
        ]
    )
    + f"\nSELECT target, idx, {rounded('prediction', 6, 'prediction')} FROM voted",
)
def forest_per_target(spark, sf):
    """What forests of 100 full trees say about each row of the table they were grown on."""
    parts = coded_parts(spark, sf)
    model = trees.fit_trees(parts.df, PARTS, rule=tree_rule("forest", trees=TREES))
    return trees.predict(parts.df, model, parts.n, ["idx"]).select("target", "idx", rnd("prediction", 6).alias("prediction"))


def train_rows_sql(source: str, reps: int, share: float = 0.05, tag: str = "") -> str:
    """The training rows of all replicates of a table, tagged ``rep``."""
    held = f"CAST(ceil(round(n * {share}, 6)) AS BIGINT)"
    return " UNION ALL ".join(f"SELECT *, {r} AS rep{tag} FROM {source} WHERE {permuted_sql('idx', r)} >= {held}" for r in range(reps))


@query(
    "impurity_importance",
    ",\n".join(
        [
            f"WITH RECURSIVE {PARTS_SQL}",
            f"kept AS ({train_rows_sql('parts', REPS)})",
            scales_sql("scales", "kept", PARTS.continuous),
            samples_sql("sampled", "kept", "scales", PARTS, PARTS.columns, ["rep"]),
            grow_sql("g", "sampled", ["target", "rep"], WIDTH),
        ]
    )
    + f"\nSELECT target, feature, pos, rep, {rounded('score', 9, 'score')} FROM ({importance_sql('g_n', PARTS, PARTS.columns, ['rep'])})",
)
def impurity_importance(spark, sf):
    rows = importance.importance(coded_parts(spark, sf), PARTS, ("tree", "tree"), reps=REPS)
    return rows.select("target", "feature", "pos", "rep", rnd("score", 9).alias("score"))


# ---------------------------------------------------------------- Shapley values


def _shap_sql() -> str:
    """Shapley values by all subsets of the features; the chance share of a path is a product over its steps."""
    sets = [[f for f in range(WIDTH) if s >> f & 1] for s in range(1 << WIDTH)]
    on = [f"(CASE WHEN r.x{f} > b.low{f} AND r.x{f} <= b.high{f} THEN 1.0 ELSE 0.0 END)" for f in range(WIDTH)]
    weight = {k: 1 / (WIDTH * [1, 2, 1][k]) if WIDTH == 3 else None for k in range(WIDTH)}
    value = lambda chosen: " * ".join(f"o{f}" if f in chosen else f"z{f}" for f in range(WIDTH))
    effect = lambda j: " + ".join(
        f"{weight[len(s)]!r} * ({value([*s, j])} - {value(s)})" for s in sets if j not in s
    )
    bounds = ", ".join(
        f"coalesce(max(up_cut) FILTER (up_f = {f} AND right(step, 1) = '1'), CAST('-infinity' AS DOUBLE)) AS low{f},"
        f" coalesce(min(up_cut) FILTER (up_f = {f} AND right(step, 1) = '0'), CAST('infinity' AS DOUBLE)) AS high{f},"
        f" coalesce(product(n / above) FILTER (up_f = {f}), 1.0) AS z{f}"
        for f in range(WIDTH)
    )
    means = " UNION ALL ".join(f"SELECT target, rep, node, {j} AS feature, sum({effect(j)}) AS effect FROM met GROUP BY target, rep, node" for j in range(WIDTH))
    xs = ", ".join(f"r.x{f}" for f in range(WIDTH))
    return (
        ",\n".join(
            [
                f"WITH RECURSIVE {PARTS_SQL}",
                f"kept AS ({train_rows_sql('parts', REPS, 0.25)})",
                scales_sql("scales", "kept", PARTS.continuous),
                samples_sql("sampled", "kept", "scales", PARTS, PARTS.columns, ["rep"]),
                grow_sql("g", "sampled", ["target", "rep"], WIDTH),
            ]
        )
        + f""",
leaf AS (SELECT target, rep, node, n AS leaf_n FROM g_n WHERE feature IS NULL),
steps AS (SELECT l.target, l.rep, l.node, s.node AS step, s.n, u.n AS above, u.feature AS up_f, u.threshold AS up_cut
  FROM (SELECT *, unnest(range(1, length(node) + 1)) AS d FROM leaf) l JOIN g_n s ON s.target = l.target AND s.rep = l.rep AND s.node = left(l.node, l.d)
  JOIN g_n u ON u.target = l.target AND u.rep = l.rep AND u.node = left(l.node, l.d - 1)),
box AS MATERIALIZED (SELECT target, rep, node, {bounds} FROM leaf LEFT JOIN steps USING (target, rep, node) GROUP BY target, rep, node),
met AS (SELECT b.target, b.rep, b.node, {', '.join(f'{o} AS o{f}, z{f}' for f, o in enumerate(on))}
  FROM box b JOIN (SELECT target, rep, {xs} FROM sampled r) r ON b.target = r.target AND b.rep = r.rep),
effects AS ({means}),
worth AS (SELECT c.target, c.rep, c.node, CASE WHEN c.cls THEN c.y END AS code, CASE WHEN c.cls THEN c.n / l.leaf_n ELSE z.middle + z.unit * (c.s / c.n) END AS value
  FROM g_c c JOIN leaf l USING (target, rep, node) LEFT JOIN scales z USING (target)),
classes AS (SELECT target, rep, count(DISTINCT coalesce(code, -1)) AS n FROM worth GROUP BY target, rep),
total AS (SELECT target, rep, count(*) AS n FROM sampled GROUP BY target, rep)
SELECT e.target, f.name AS feature, f.pos, e.rep, {rounded('sum(effect * value) / any_value(t.n) / any_value(k.n)', 6, 'score')}
FROM effects e JOIN worth USING (target, rep, node) JOIN classes k USING (target, rep) JOIN total t USING (target, rep)
JOIN {feature_names_sql(PARTS, PARTS.columns)} ON f.target = e.target AND f.feature = e.feature GROUP BY e.target, f.name, f.pos, e.rep"""
    )


@query("shap_mean_importance", _shap_sql())
def shap_mean_importance(spark, sf):
    rows = importance.shap_mean_importance(coded_parts(spark, sf), PARTS, reps=REPS)
    return rows.select("target", "feature", "pos", "rep", rnd("score", 6).alias("score"))


# ---------------------------------------------------------------- cross utility and comparisons


def tree_utility_ctes(name: str, source: str, other: str) -> list[str]:
    """CTEs up to ``name``: the published pairing, trees for categorical targets and least squares for the others."""
    linear, _ = utility_ctes(f"{name}_ols", source, other, PARTS.columns, ())
    classes = PARTS.categorical
    ctes = [
        *linear,
        samples_sql(f"{name}_s", f"{name}_ols_t", "scales", PARTS, classes),
        grow_sql(f"{name}_g", f"{name}_s", ["target"], WIDTH),
        inputs_sql(f"{name}_in", f"{name}_ols_r", PARTS, classes, ["rid"]),
        land_sql(f"{name}_at", f"{name}_in", f"{name}_g_n", ["target"], WIDTH),
        f"""{name}_sc AS (SELECT target, avg(CAST(actual = label AS INTEGER)) FILTER (rid % 2 = 0) AS own,
              avg(CAST(actual = label AS INTEGER)) FILTER (rid % 2 = 1) AS other FROM {name}_at GROUP BY target)""",
        f"""{name} AS (SELECT target, ratio, own, other, higher_is_better FROM {name}_ols WHERE target IN ({', '.join(f"'{t}'" for t in PARTS.continuous)})
              UNION ALL SELECT target, other / nullif(own, 0), own, other, true FROM {name}_sc)""",
    ]
    return ctes


_PAIR = f"{PARTS_SQL},\n{shuffled_sql('parts', 'mixed', PARTS.columns, MOVED)},\n{scales_sql('scales', 'parts', PARTS.continuous)}"
_BOTH = both_sql(tree_utility_ctes("forth", "parts", "mixed"), tree_utility_ctes("back", "mixed", "parts"))


@query(
    "utility_both_directions_tree",
    f"WITH RECURSIVE {_PAIR},\n{_BOTH}\nSELECT train_side, test_side, target, {rounded('ratio', 5, 'ratio')}, {rounded('own', 5, 'own')}, {rounded('other', 5, 'other')}, higher_is_better FROM cross_rows",
)
def utility_both_directions_tree(spark, sf):
    """The published pairing, a tree and least squares, on parts and a shuffled copy."""
    parts = coded_parts(spark, sf)
    rows = utility.utility_both_directions(parts, shuffled(parts, MOVED), PARTS)
    return rows.withColumns({c: rnd(c, 5) for c in ("ratio", "own", "other")})


COMPARE_REPS = 10


def _compare_sql() -> str:
    parts = []
    for side, source in (("a", "parts"), ("b", "mixed")):
        parts += [
            f"kept_{side} AS ({train_rows_sql(source, COMPARE_REPS)})",
            scales_sql(f"scales_{side}", f"kept_{side}", PARTS.continuous),
            samples_sql(f"sampled_{side}", f"kept_{side}", f"scales_{side}", PARTS, PARTS.columns, ["rep"]),
            grow_sql(f"g{side}", f"sampled_{side}", ["target", "rep"], WIDTH),
            f"score_{side} AS (SELECT target, feature, pos, round(avg(score), 12) AS score FROM ({importance_sql(f'g{side}_n', PARTS, PARTS.columns, ['rep'])}) GROUP BY ALL)",
        ]
    return (
        f"WITH RECURSIVE {_PAIR},\n{_BOTH},\n" + ",\n".join(parts)
        + ",\npairs AS (SELECT a.target, a.feature, a.pos, a.score AS score_a, b.score AS score_b FROM score_a a JOIN score_b b USING (target, feature)),\n"
        + measures_sql(())
        + f"\nSELECT metric, {rounded('avg(value)', 5, 'value')} FROM (SELECT metric, value FROM long_scores UNION ALL SELECT 'cross', cc_reference FROM cross_cc) GROUP BY metric"
    )


@query("compare_datasets_tree", _compare_sql())
def compare_datasets_tree(spark, sf):
    """The published pairing: trees rank the features, a tree and least squares measure utility."""
    parts = row_index(part_rows(spark, sf), ["p_partkey"])
    parts = Indexed(parts.df.select("idx", *PARTS.columns), parts.n)
    scores, cross = compare_datasets(parts, shuffled(parts, MOVED), PARTS, ("tree", "tree"), reps=COMPARE_REPS)
    return summary(scores, cross).select("metric", rnd("value", 5).alias("value"))


# ---------------------------------------------------------------- a trial with the published pairing

RUNS, TRIAL_REPS, INNER = 4, 3, 3


def _trial_sql() -> str:
    columns, classes, numbers = PARTS.columns, list(PARTS.categorical), list(PARTS.continuous)
    keys, every = ["run", "rep"], ["run", "rep", "inner_rep"]
    held = "CAST(ceil(round(n * 0.05, 6)) AS BIGINT)"
    kept = " UNION ALL ".join(f"SELECT *, {i} AS inner_rep FROM sweep WHERE {permuted_sql('idx', i)} >= {held}" for i in range(INNER))
    tested = f"{permuted_sql('idx', 42)} < ceil(round(n * 0.2, 6)) AS is_test"
    error = lambda t: f"avg(power({residual_sql(columns.index(t), columns)}, 2))"
    forth = [
        f"SELECT o.run, o.rep, 'a' AS train_side, '{t}' AS target, (SELECT {error(t)} FROM held_a r, inv_ta i WHERE r.is_test) AS own, o.other"
        f" FROM (SELECT r.run, r.rep, {error(t)} AS other FROM sweep r, inv_ta i GROUP BY r.run, r.rep) o"
        for t in numbers
    ]
    back = [
        f"SELECT w.run, w.rep, 'b' AS train_side, '{t}' AS target, w.own, v.other"
        f" FROM (SELECT r.run, r.rep, {error(t)} AS own FROM held_b r JOIN inv_tb i USING (run, rep) WHERE r.is_test GROUP BY r.run, r.rep) w"
        f" JOIN (SELECT i.run, i.rep, {error(t)} AS other FROM parts r, inv_tb i GROUP BY i.run, i.rep) v USING (run, rep)"
        for t in numbers
    ]
    score = lambda name, by: f"SELECT {by}target, avg(CAST(actual = label AS INTEGER)) AS score FROM {name} GROUP BY {by}target"
    trees_forth = (
        f"SELECT o.run, o.rep, 'a', o.target, w.score, o.score FROM ({score('far_a', 'run, rep, ')}) o JOIN ({score('own_a', '')}) w USING (target)"
    )
    trees_back = (
        f"SELECT o.run, o.rep, 'b', o.target, w.score, o.score FROM ({score('far_b', 'run, rep, ')}) o JOIN ({score('own_b', 'run, rep, ')}) w USING (run, rep, target)"
    )
    parts = [
        f"WITH RECURSIVE {PARTS_SQL}",
        f"sweep AS ({_sweep_sql(RUNS, TRIAL_REPS, 'parts', columns)})",
        f"kept AS ({kept})",
        scales_sql("scales", "parts", []),
        samples_sql("sampled", "kept", "scales", PARTS, classes, every),
        grow_sql("g", "sampled", ["target", *every], WIDTH),
        inverse_sql("kept", columns, every, "inv_k"),
        f"scored AS (SELECT run, rep, inner_rep, target, feature, pos, score FROM ({importance_sql('g_n', PARTS, classes, every)})"
        f" UNION ALL SELECT run, rep, inner_rep, target, feature, pos, score FROM ({linear_importance_sql('inv_k', columns, numbers, every)}))",
        "score_b AS (SELECT run, rep, target, feature, pos, round(avg(score), 12) AS score FROM scored GROUP BY ALL)",
        "pairs AS (SELECT b.run, b.rep, target, feature, b.pos, a.score AS score_a, b.score AS score_b FROM score_b b"
        " JOIN (SELECT target, feature, score FROM score_b WHERE run = 0 AND rep = 0) a USING (target, feature))",
        measures_sql(tuple(keys)),
        f"held_a AS (SELECT *, {tested} FROM parts), held_b AS (SELECT *, {tested} FROM sweep)",
        "only_a AS (SELECT * FROM held_a WHERE NOT is_test), only_b AS (SELECT * FROM held_b WHERE NOT is_test)",
        "rest_a AS (SELECT * FROM held_a WHERE is_test), rest_b AS (SELECT * FROM held_b WHERE is_test)",
        "spread AS (SELECT p.*, t.run, t.rep FROM parts p, (SELECT DISTINCT run, rep FROM sweep) t)",
        inverse_sql("only_a", columns, (), "inv_ta"),
        inverse_sql("only_b", columns, keys, "inv_tb"),
        samples_sql("sa", "only_a", "scales", PARTS, classes),
        grow_sql("ga", "sa", ["target"], WIDTH),
        samples_sql("sb", "only_b", "scales", PARTS, classes, keys),
        grow_sql("gb", "sb", ["target", *keys], WIDTH),
    ]
    for name, source, by, nodes, model in (
        ("own_a", "rest_a", [], "ga_n", []), ("far_a", "sweep", keys, "ga_n", []), ("own_b", "rest_b", keys, "gb_n", keys), ("far_b", "spread", keys, "gb_n", keys),
    ):
        parts += [inputs_sql(f"{name}_in", source, PARTS, classes, ["idx"], by), land_sql(name, f"{name}_in", nodes, ["target", *model], WIDTH)]
    parts += [
        f"cross_rows AS (SELECT run, rep, train_side, target, other / nullif(own, 0) AS ratio, own, other FROM ({' UNION ALL '.join([*forth, *back, trees_forth, trees_back])}))",
        "cross_cc AS (SELECT run, rep, target, max(ratio + own + other) FILTER (train_side = 'a') / nullif(max(ratio + own + other) FILTER (train_side = 'b'), 0) AS cc FROM cross_rows GROUP BY run, rep, target)",
        "trial AS (SELECT run, rep, metric, avg(value) AS value FROM long_scores GROUP BY run, rep, metric UNION ALL SELECT run, rep, 'cross', avg(cc) FROM cross_cc GROUP BY run, rep)",
    ]
    return ",\n".join(parts) + f"\nSELECT run, rep, metric, {rounded('value', 5, 'value')} FROM trial"


@query("shuffle_trial_tree", _trial_sql())
def shuffle_trial_tree(spark, sf):
    """The published trial: a tree and least squares on copies with 0 to all columns shuffled, all trees grown in one job."""
    parts = row_index(part_rows(spark, sf), ["p_partkey"])
    parts = Indexed(parts.df.select("idx", *PARTS.columns), parts.n)
    scores, cross = shuffle_trial(parts, PARTS, "dt", RUNS, TRIAL_REPS, INNER)
    return summary(scores, cross, ["run", "rep"]).select("run", "rep", "metric", rnd("value", 5).alias("value"))


@query("method_sweep")
def method_sweep_query(spark, sf):
    """All six methods on labelled documents, with and without one shuffled column; forests of 100 full trees."""
    return method_sweep(coded_docs(spark, sf), DOCS, max_columns=1, reps=1, inner_reps=1, repeats=2)


# ---------------------------------------------------------------- synthetic tables


def _drawn_sql(key: str, seed: int, n: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT) % {n})"


def synthesis_sql(rows: str, seed: int = 42, min_rows: int = 5) -> str:
    """Sequential trees on ``parts``, column by column; ``rows`` is the number of synthetic rows."""
    columns = PARTS.columns
    ctes = [
        f"WITH RECURSIVE {PARTS_SQL}",
        f"made0 AS (SELECT i.id AS sid, p.{columns[0]} FROM (SELECT unnest(range({rows})) AS id) i"
        f" JOIN parts p ON p.idx = {_drawn_sql('i.id', seed, '(SELECT count(*) FROM parts)')})",
    ]
    for i, target in enumerate(columns[1:], 1):
        roles = Roles(columns[: i + 1], tuple(c for c in PARTS.continuous if c in columns[: i + 1]))
        had = ", ".join(columns[:i])
        xs = ", ".join(f"{c} AS x{j}" for j, c in enumerate(columns[:i]))
        ctes += [
            scales_sql(f"z{i}", "parts", [target] if target in roles.continuous else []),
            samples_sql(f"s{i}", "parts", f"z{i}", roles, [target]),
            grow_sql(f"g{i}", f"s{i}", ["target"], i, min_leaf=min_rows),
            inputs_sql(f"real{i}", "parts", roles, [target], ["idx"]),
            land_sql(f"at{i}", f"real{i}", f"g{i}_n", ["target"], i),
            f"donor{i} AS (SELECT leaf, actual, row_number() OVER (PARTITION BY leaf ORDER BY md5(CAST(idx AS VARCHAR) || ':{seed + i}'), idx) - 1 AS no FROM at{i})",
            f"new{i} AS (SELECT '{target}' AS target, *, {xs} FROM made{i - 1})",
            land_sql(f"put{i}", f"new{i}", f"g{i}_n", ["target"], i),
            f"made{i} AS (SELECT p.sid, {', '.join(f'p.{c}' for c in columns[:i])}, d.actual AS {target} FROM put{i} p"
            f" JOIN donor{i} d ON d.leaf = p.leaf AND d.no = {_drawn_sql('p.sid', seed + i, 'p.leaf_n')})",
        ]
    return ",\n".join(ctes) + f"\nSELECT {', '.join(columns)} FROM made{len(columns) - 1}"


@query("sequential_cart_synthesis", synthesis_sql("(SELECT count(*) FROM parts)"))
def sequential_cart_synthesis(spark, sf):
    return synth.sequential_cart_synthesis(coded_parts(spark, sf), PARTS).drop("_id")


@query("resize_synthesis", synthesis_sql("1000"))
def resize_synthesis(spark, sf):
    return synth.resize_synthesis(coded_parts(spark, sf), PARTS, 1000).drop("_id")
