"""Queries of whole experiments and of synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, report, synth
from ..operators.index import Indexed
from ..session import materialize
from .bindings import (
    DOCS, ITEMS, PAIR_SQL, PARTS, PARTS_SQL, SHAPES, SHAPES_SQL,
    coded_docs, coded_pair, coded_parts, correlation_scores, inverse_sql, linear_importance_sql, measures_sql, part_rows,
    part_shapes, permuted_sql, rnd, rounded, settled, settled_sql, shuffled, shuffled_sql,
)
from .experiment import (
    compare_datasets, generator_sweep, last_repetition, method_sweep, multi_dataset_ratio, repetition_sweep, shuffle_trial,
    summary, trial_mean,
)
from .queries_data import _sweep_sql
from .queries_models import FAST, both_sql, linear_reps_sql, nb_importance_sql, utility_ctes
from .registry import query

# ---------------------------------------------------------------- two tables

COMPARE_REPS, COMPARE_REPEATS = 10, 15
MOVED = ("price", "brand")
_FORTH, _ = utility_ctes("forth", "parts", "mixed", PARTS.columns, PARTS.categorical)
_BACK, _ = utility_ctes("back", "mixed", "parts", PARTS.columns, PARTS.categorical)


def _importance_sql(name: str, source: str) -> tuple[list[str], str]:
    """CTEs and select of the importance rows of a mixed table: naive Bayes and least squares."""
    ctes, select = linear_reps_sql(f"{name}_l", source, PARTS.columns, PARTS.continuous, COMPARE_REPS)
    selects = [f"SELECT target, feature, pos, rep, score FROM ({select})"]
    for r in range(COMPARE_REPS):
        for t in PARTS.categorical:
            c, s = nb_importance_sql(f"{name}_{t}_{r}", source, t, PARTS.columns, r, COMPARE_REPEATS)
            ctes += c
            selects.append(s)
    return ctes, " UNION ALL ".join(selects)


def _compare_sql() -> str:
    a_ctes, a = _importance_sql("ia", "parts")
    b_ctes, b = _importance_sql("ib", "mixed")
    mean = lambda s: f"SELECT target, feature, pos, avg(score) AS score FROM ({s}) GROUP BY target, feature, pos"
    return (
        f"WITH RECURSIVE {PARTS_SQL},\n{shuffled_sql('parts', 'mixed', PARTS.columns, MOVED)},\n{both_sql(_FORTH, _BACK)},\n" + ",\n".join(a_ctes + b_ctes)
        + f",\nmean_a AS ({mean(a)}),\nmean_b AS ({mean(b)}),\n"
        + "pairs AS (SELECT a.target, a.feature, a.pos, round(a.score, 12) AS score_a, round(b.score, 12) AS score_b FROM mean_a a JOIN mean_b b USING (target, feature)),\n"
        + measures_sql(())
        + "\nSELECT target, metric, "
        + rounded("value", 5, "value")
        + " FROM (SELECT target, metric, value FROM long_scores UNION ALL SELECT target, 'cross', cc_reference FROM cross_cc)"
    )


@query("compare_datasets", _compare_sql())
def compare_datasets_query(spark, sf):
    """Parts against a copy with two columns shuffled together: all ten measures and the cross value per target."""
    from ..operators.utility import cross_aggregate

    parts = index.row_index(part_rows(spark, sf), ["p_partkey"])
    parts = Indexed(parts.df.select("idx", *PARTS.columns), parts.n)
    scores, cross = compare_datasets(
        parts, shuffled(parts, MOVED), PARTS, FAST, reps=COMPARE_REPS, repeats=COMPARE_REPEATS, cross_models=FAST
    )
    cc = cross_aggregate(cross).select("target", F.lit("cross").alias("metric"), F.col("cc_reference").alias("value"))
    return scores.unionByName(cc).withColumn("value", rnd("value", 5))


# ---------------------------------------------------------------- shuffle trials

RUNS, REPS, INNER = 6, 10, 10
_P = SHAPES.columns


def _trial_ctes(runs: int, reps: int, inner: int) -> str:
    held = "CAST(ceil(n * 0.05) AS BIGINT)"
    keys = ("run", "rep", "inner_rep")
    mixed = " UNION ALL ".join(f"SELECT *, {i} AS inner_rep FROM sweep WHERE {permuted_sql('idx', i)} >= {held}" for i in range(inner))
    plain = " UNION ALL ".join(f"SELECT *, {i} AS inner_rep FROM indexed WHERE {permuted_sql('idx', i)} >= {held}" for i in range(inner))
    z = lambda i, t: f"(i.sd[{t + 1}] / i.m[{t + 1}][{t + 1}] * list_dot_product(i.m[{t + 1}], [" + ", ".join(
        f"(r.{c} - i.mu[{j + 1}]) / i.sd[{j + 1}]" for j, c in enumerate(_P)
    ) + "]))"
    errors = lambda t: z("i", t)
    forth = " UNION ALL ".join(
        f"SELECT o.run, o.rep, 'a' AS train_side, '{c}' AS target, (SELECT avg(power({errors(t)}, 2)) FROM held_a r, inv_ta i WHERE r.is_test) AS own,"
        f" o.other FROM (SELECT r.run, r.rep, avg(power({errors(t)}, 2)) AS other FROM sweep r, inv_ta i GROUP BY r.run, r.rep) o"
        for t, c in enumerate(_P)
    )
    back = " UNION ALL ".join(
        f"SELECT w.run, w.rep, 'b' AS train_side, '{c}' AS target, w.own, v.other FROM"
        f" (SELECT r.run, r.rep, avg(power({errors(t)}, 2)) AS own FROM held_b r JOIN inv_tb i USING (run, rep) WHERE r.is_test GROUP BY r.run, r.rep) w"
        f" JOIN (SELECT i.run, i.rep, avg(power({errors(t)}, 2)) AS other FROM indexed r, inv_tb i GROUP BY i.run, i.rep) v USING (run, rep)"
        for t, c in enumerate(_P)
    )
    return f"""{SHAPES_SQL}, sweep AS ({_sweep_sql(runs, reps, 'indexed', _P)}),
train_b AS ({mixed}), train_a AS ({plain}),
{inverse_sql('train_b', _P, keys, 'inv_b')},
{inverse_sql('train_a', _P, ('inner_rep',), 'inv_a')},
score_b AS (SELECT run, rep, target, feature, pos, avg(score) AS score FROM ({linear_importance_sql('inv_b', _P, _P, keys)}) GROUP BY ALL),
score_a AS (SELECT target, feature, pos, avg(score) AS score FROM ({linear_importance_sql('inv_a', _P, _P, ('inner_rep',))}) GROUP BY ALL),
pairs AS (SELECT b.run, b.rep, target, feature, b.pos, round(a.score, 12) AS score_a, round(b.score, 12) AS score_b FROM score_a a JOIN score_b b USING (target, feature)),
{measures_sql(('run', 'rep'))},
held_a AS (SELECT *, {permuted_sql('idx', 42)} < ceil(n * 0.2) AS is_test FROM indexed),
held_b AS (SELECT *, {permuted_sql('idx', 42)} < ceil(n * 0.2) AS is_test FROM sweep),
only_a AS (SELECT * FROM held_a WHERE NOT is_test), only_b AS (SELECT * FROM held_b WHERE NOT is_test),
{inverse_sql('only_a', _P, (), 'inv_ta')},
{inverse_sql('only_b', _P, ('run', 'rep'), 'inv_tb')},
cross_rows AS (SELECT run, rep, train_side, target, other / own AS ratio, own, other FROM ({forth} UNION ALL {back})),
cross_cc AS (SELECT run, rep, target, max(ratio + own + other) FILTER (train_side = 'a') / max(ratio + own + other) FILTER (train_side = 'b') AS cc FROM cross_rows GROUP BY run, rep, target),
trial AS (SELECT run, rep, metric, avg(value) AS value FROM long_scores GROUP BY run, rep, metric
  UNION ALL SELECT run, rep, 'cross', avg(cc) FROM cross_cc GROUP BY run, rep)"""


def _trial(spark, sf):
    scores, cross = shuffle_trial(part_shapes(spark, sf), SHAPES, ("gaussian_nb", "linear"), RUNS, REPS, INNER, cross_models=FAST)
    return summary(scores, cross, ["run", "rep"])


@query(
    "shuffle_trial",
    f"WITH RECURSIVE {_trial_ctes(RUNS, REPS, INNER)}\nSELECT run, rep, metric, {rounded('value', 5, 'value')} FROM trial",
)
def shuffle_trial_query(spark, sf):
    return _trial(spark, sf).select("run", "rep", "metric", rnd("value", 5).alias("value"))


@query(
    "last_repetition",
    f"WITH RECURSIVE {_trial_ctes(RUNS, REPS, INNER)}\nSELECT run, rep, metric, {rounded('value', 5, 'value')} FROM trial WHERE rep = {REPS - 1}",
)
def last_repetition_query(spark, sf):
    rows = materialize(_trial(spark, sf), "trial")
    return last_repetition(rows).select("run", "rep", "metric", rnd("value", 5).alias("value"))


@query(
    "shuffle_trial_mean",
    f"""WITH RECURSIVE {_trial_ctes(RUNS, REPS, INNER)}
SELECT run, metric, {rounded('avg(value)', 5, 'value')}, count(*) AS n, {rounded('max(value) - min(value)', 5, 'spread')} FROM trial GROUP BY run, metric""",
)
def shuffle_trial_mean(spark, sf):
    means = trial_mean(_trial(spark, sf))
    spread = F.array_max("values") - F.array_min("values")
    return means.select(
        "run", "metric", rnd("value", 5).alias("value"), F.size("values").cast("long").alias("n"), rnd(spread, 5).alias("spread")
    )


SWEEP_REPS = (5, 10, 15, 20, 25, 30, 35)


@query(
    "repetition_sweep",
    f"""WITH RECURSIVE {_trial_ctes(RUNS, max(SWEEP_REPS), INNER)}, tagged AS ({' UNION ALL '.join(f"SELECT {r} AS n_reps, * FROM trial WHERE rep < {r}" for r in SWEEP_REPS)})
SELECT n_reps, run, metric, {rounded('avg(value)', 5, 'value')}, {settled_sql('var_pop(value)', 6, 'variance')} FROM tagged GROUP BY n_reps, run, metric""",
)
def repetition_sweep_query(spark, sf):
    rows = repetition_sweep(
        part_shapes(spark, sf), SHAPES, SWEEP_REPS, models=("gaussian_nb", "linear"), max_columns=RUNS, inner_reps=INNER, cross_models=FAST
    )
    means = rows.groupBy("n_reps", "run", "metric").agg(rnd(F.avg("value"), 5).alias("value"))
    variances = report.variance_by_reps(rows).withColumn("variance", settled("variance", 6))
    return means.join(variances, ["n_reps", "run", "metric"])


# ---------------------------------------------------------------- synthetic tables


def _as_indexed(df, n):
    return Indexed(df.withColumnRenamed("_id", "idx"), n)


def _independent(table, columns):
    """Each column shuffled on its own, with donors from the original table."""
    out = table.df.select("idx")
    for i, c in enumerate(columns):
        donor = table.df.select(F.col("idx").alias("_src"), c)
        out = out.withColumn("_src", index.permuted(F.col("idx"), 20 + i, table.n)).join(donor, "_src").drop("_src")
    return out


@query("generator_sweep")
def generator_sweep_query(spark, sf):
    """Two tables against what two generators made of them: sequential trees, and columns shuffled one by one."""
    real = {"docs": coded_docs(spark, sf), "parts": coded_parts(spark, sf)}
    roles = {"docs": DOCS, "parts": PARTS}
    made = {}
    for name, table in real.items():
        made["cart", name] = _as_indexed(synth.sequential_cart_synthesis(table, roles[name]), table.n)
        made["independent", name] = Indexed(materialize(_independent(table, roles[name].columns), "independent"), table.n)
    return generator_sweep(real, made, roles, models=FAST, cross_models=FAST)


# ---------------------------------------------------------------- several tables


def _multi_sql() -> str:
    cells = [
        f"SELECT '{name}' AS dataset, '{t}' AS target, '{f}' AS feature, {j} AS pos, round(abs(corr({t}, {f})), 9) AS score FROM {source}"
        for name, source in (("0", "coded"), ("1", "mixed"))
        for t in ITEMS.columns
        for j, f in enumerate(ITEMS.columns)
        if f != t
    ]
    pair = lambda a, b: (
        f"SELECT '{a}-{b}' AS pair, a.target, a.feature, a.pos, a.score AS score_a, b.score AS score_b"
        f" FROM imp a JOIN imp b USING (target, feature) WHERE a.dataset = '{a}' AND b.dataset = '{b}'"
    )
    return (
        f"WITH RECURSIVE {PAIR_SQL},\nimp AS ({' UNION ALL '.join(cells)}),\npairs AS ({pair('0', '1')} UNION ALL {pair('1', '0')}),\n"
        + measures_sql(("pair",))
        + f"\nSELECT metric, pair, target, {rounded('avg(value)', 5, 'value')} FROM long_scores GROUP BY GROUPING SETS ((metric, pair, target), (metric, pair), (metric, target), (metric))"
    )


@query("multi_dataset_ratio", _multi_sql())
def multi_dataset_ratio_query(spark, sf):
    a, b = coded_pair(spark, sf)
    both = a.df.withColumn("dataset", F.lit("0")).unionByName(b.df.withColumn("dataset", F.lit("1")))
    scores = materialize(correlation_scores(both, ITEMS.columns, ["dataset"]), "importances")
    out = multi_dataset_ratio(scores, [("0", "1"), ("1", "0")])
    return out.withColumn("value", rnd("value", 5))
