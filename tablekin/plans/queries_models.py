"""Queries of per-target models, importances, rank measures and cross utility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes, importance, linear, rank, utility
from ..operators.clean import q
from ..operators.estimators import FITTERS, fit_all_targets
from ..operators.index import Indexed, holdout_split, train_part
from ..operators.logistic import coefficient_rows, logistic_all_targets
from ..session import materialize
from .bindings import (
    CATEGORICAL, CODED_SQL, CONTINUOUS, DOCS, DOCS_SQL, INDEXED_SQL, ITEMS, ITEMS_SQL, NUMBERS, PAIR_SQL, PARTS, PARTS_SQL, RUN_SCORES_SQL,
    coded_docs, coded_items, coded_pair, coded_parts, coded_rows, correlation_scores, inverse_sql, items, linear_importance_sql, nb_sql,
    newton_sql, number_items, permuted_sql, residual_sql, rnd, rounded, run_scores, settled, settled_sql, shuffled_sql,
)
from .registry import query

FAST = ("gaussian_nb", "linear")

# ---------------------------------------------------------------- models


def training_scores(table, roles, models, targets=None, **options):
    """Rows ``(target, score, n)`` of each model on its own rows: accuracy, or R² of a continuous target."""
    rows, cells = table.df.select("idx", *map(q, roles.columns)), []
    for k, (target, model) in enumerate(fit_all_targets(table.df, roles, models, targets, **options).items()):
        rows = model.predict(rows).withColumnRenamed("prediction", f"_pred{k}")
        y, p = q(target), F.col(f"_pred{k}")
        score = utility.accuracy(y, p) if roles.is_categorical(target) else 1 - F.try_divide(utility.mse(y, p), F.var_pop(y))
        cells.append(F.struct(F.lit(target).alias("target"), score.alias("score"), F.count(F.lit(1)).alias("n")))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


_NEWTON_SQL = f"WITH RECURSIVE {DOCS_SQL},\n{newton_sql('docs', DOCS.columns, DOCS.categorical)}"
_LOGISTIC_SCORES = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, {settled_sql('avg(CAST(y = p AS INT))', 6, 'score')}, count(*) AS n FROM (
  SELECT doc_id, any_value({t}) AS y, min_by(c, [-list_dot_product(w, [{', '.join(c for c in DOCS.columns if c != t)}, 1.0]), c]) AS p
  FROM docs, newton WHERE t = '{t}' GROUP BY doc_id)"""
    for t in DOCS.categorical
)


@query("logistic_per_target", f"{_NEWTON_SQL} {_LOGISTIC_SCORES}")
def logistic_per_target(spark, sf):
    scores = training_scores(coded_docs(spark, sf), DOCS, ("logistic", "linear"), list(DOCS.categorical))
    return scores.withColumn("score", settled("score", 6))


_LOGISTIC_NAMES = " UNION ALL ".join(
    f"SELECT '{t}' AS t, unnest([{', '.join(repr(c) for c in (*[c for c in DOCS.columns if c != t], '(intercept)'))}]) AS feature, unnest(range(1, {len(DOCS.columns) + 1})) AS i"
    for t in DOCS.categorical
)


@query(
    "logistic_coefficients",
    f"{_NEWTON_SQL} SELECT t AS target, c AS class, feature, {settled_sql('w[i]', 6, 'coef')} FROM newton JOIN ({_LOGISTIC_NAMES}) USING (t)",
)
def logistic_coefficients(spark, sf):
    models = logistic_all_targets(coded_docs(spark, sf).df, DOCS.columns, DOCS.categorical)
    rows = spark.createDataFrame(coefficient_rows(models), "target string, class double, feature string, coef double")
    return rows.withColumn("coef", settled("coef", 6))


@query("svm_per_target")
def svm_per_target(spark, sf):
    return training_scores(coded_docs(spark, sf), DOCS, ("svm", "svm"))


def _knn_sql(target: str, classifier: bool) -> str:
    features = [c for c in PARTS.columns if c != target]
    distance = " + ".join(f"(r.{f} - s.{f}) * (r.{f} - s.{f})" for f in features)
    near = (
        f"SELECT rid, unnest(best) AS b FROM (SELECT r.idx AS rid, min_by({{'y': s.{target}, 'i': s.idx}}, [{distance}, s.idx], 5) AS best"
        f" FROM parts r, parts s GROUP BY r.idx)"
    )
    if classifier:
        votes = f"SELECT rid, b.y AS y, count(*) AS c FROM ({near}) GROUP BY rid, b.y"
        return f"SELECT '{target}' AS target, rid AS idx, min_by(y, [-c, y]) AS prediction FROM ({votes}) GROUP BY rid"
    return f"SELECT '{target}' AS target, rid AS idx, round(avg(b.y), 6) AS prediction FROM ({near}) GROUP BY rid"


@query(
    "knn_per_target",
    f"WITH {PARTS_SQL} " + " UNION ALL ".join(_knn_sql(t, PARTS.is_categorical(t)) for t in PARTS.columns),
)
def knn_per_target(spark, sf):
    parts = coded_parts(spark, sf)
    out = None
    for target, model in fit_all_targets(parts.df, PARTS, ("knn", "knn")).items():
        rows = model.predict(parts.df).select(F.lit(target).alias("target"), "idx", rnd("prediction", 6).alias("prediction"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _coefficients_sql(inverse, columns, targets):
    rows = [
        f"SELECT '{t}' AS target, '{f}' AS feature, {rounded(f'-m[{i + 1}][{j + 1}] / m[{i + 1}][{i + 1}] * sd[{i + 1}] / sd[{j + 1}]', 6, 'coef')},"
        f" round(1 - 1 / m[{i + 1}][{i + 1}], 6) AS r2 FROM {inverse}"
        for i, t in enumerate(columns)
        if t in targets
        for j, f in enumerate(columns)
        if j != i
    ]
    return " UNION ALL ".join(rows)


@query(
    "linear_per_target",
    f"WITH RECURSIVE {CODED_SQL},\n{inverse_sql('coded', ITEMS.columns)}\n{_coefficients_sql('inv', ITEMS.columns, CONTINUOUS)}",
)
def linear_per_target(spark, sf):
    fitted = linear.linear_per_target(coded_rows(spark, sf), ITEMS.columns, CONTINUOUS)
    return fitted.select("target", "feature", rnd("coef", 6).alias("coef"), rnd("r2", 6).alias("r2"))


@query("bayesian_ridge_per_target")
def bayesian_ridge_per_target(spark, sf):
    fitted = linear.linear_per_target(coded_rows(spark, sf), ITEMS.columns, CONTINUOUS, solver="bayesian_ridge")
    return fitted.select("target", "feature", "coef", "intercept", "r2")


def _others(target):
    return [c for c in ITEMS.columns if c != target]


@query(
    "gaussian_nb_per_target",
    f"WITH {CODED_SQL}, rows_ AS (SELECT idx AS rid, * FROM coded),\n"
    + ",\n".join(nb_sql(f"nb_{t}", "coded", "rows_", t, _others(t)) for t in CATEGORICAL)
    + "\n"
    + " UNION ALL ".join(f"SELECT '{t}' AS target, rid AS idx, prediction FROM nb_{t}" for t in CATEGORICAL),
)
def gaussian_nb_per_target(spark, sf):
    base = coded_items(spark, sf)
    out = None
    for target, model in bayes.gaussian_nb_all_targets(base.df, ITEMS.columns, CATEGORICAL).items():
        rows = model.predict(base.df).select(F.lit(target).alias("target"), "idx", "prediction")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "fit_all_targets",
    f"""WITH RECURSIVE {CODED_SQL}, rows_ AS (SELECT idx AS rid, * FROM coded),\n{inverse_sql('coded', ITEMS.columns)},
"""
    + ",\n".join(nb_sql(f"nb_{t}", "coded", "rows_", t, _others(t)) for t in CATEGORICAL)
    + "\n"
    + " UNION ALL ".join(f"SELECT '{t}' AS target, round(avg(CAST(y = prediction AS INTEGER)), 6) AS score, count(*) AS n FROM nb_{t}" for t in CATEGORICAL)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{t}' AS target, round(1 - 1 / m[{i + 1}][{i + 1}], 6) AS score, cnt AS n FROM inv" for i, t in enumerate(ITEMS.columns) if t in CONTINUOUS),
)
def fit_all(spark, sf):
    return training_scores(coded_items(spark, sf), ITEMS, ("gaussian_nb", "linear")).withColumn("score", rnd("score", 6))


# ---------------------------------------------------------------- importances

REPS = 5


def _train_sql(name: str, source: str, rep: int) -> str:
    """Training part of replicate ``rep``, with the row number ``rid`` inside the part and its size ``rn``."""
    held = "CAST(ceil(n * 0.05) AS BIGINT)"
    pos = permuted_sql("idx", rep)
    return f"{name} AS (SELECT * EXCLUDE (idx, n), {pos} - {held} AS rid, n - {held} AS rn FROM {source} WHERE {pos} >= {held})"


def _pairs_sql(name: str, source: str, columns, seeds) -> str:
    partner = ", ".join(f"d.{c} AS _p_{c}" for c in columns)
    parts = [
        f"SELECT a.* REPLACE (a.rid * 1000 + {k} AS rid), {partner} FROM {source} a JOIN {source} d ON d.rid = {permuted_sql('a.rid', s, 'a.rn')}"
        for k, s in enumerate(seeds)
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def nb_importance_sql(name: str, source: str, target: str, columns, rep: int, repeats: int) -> tuple[list[str], str]:
    """CTEs and the final select of the permutation importance of one naive Bayes model."""
    features = [c for c in columns if c != target]
    ctes = [
        _train_sql(f"{name}_t", source, rep),
        _pairs_sql(f"{name}_p", f"{name}_t", columns, [100 + 50 * rep + k for k in range(repeats)]),
        nb_sql(f"{name}_n", f"{name}_t", f"{name}_p", target, features, True),
        f"{name}_v AS (SELECT variant, avg(CAST(y = prediction AS INTEGER)) AS acc FROM {name}_n GROUP BY variant)",
    ]
    names = ", ".join(f"'{f}'" for f in features)
    places = ", ".join(str(columns.index(f)) for f in features)
    select = (
        f"SELECT '{target}' AS target, [{names}][variant + 1] AS feature, [{places}][variant + 1] AS pos, {rep} AS rep,"
        f" (SELECT acc FROM {name}_v WHERE variant = -1) - acc AS score FROM {name}_v WHERE variant >= 0"
    )
    return ctes, select


def linear_reps_sql(name: str, source: str, columns, targets, reps: int) -> tuple[list[str], str]:
    ctes, selects = [], []
    for r in range(reps):
        ctes.append(_train_sql(f"{name}_t{r}", source, r))
        ctes.append(inverse_sql(f"{name}_t{r}", columns, name=f"{name}_i{r}"))
        selects.append(f"SELECT *, {r} AS rep FROM ({linear_importance_sql(f'{name}_i{r}', columns, targets)})")
    return ctes, " UNION ALL ".join(selects)


def _nb_query(source: str, roles, reps: int, repeats: int) -> str:
    ctes, selects = [], []
    for r in range(reps):
        for t in roles.categorical:
            c, s = nb_importance_sql(f"k_{t}_{r}", source, t, roles.columns, r, repeats)
            ctes += c
            selects.append(s)
    return ",\n".join(ctes), " UNION ALL ".join(selects)


_NB_CTES, _NB_SELECT = _nb_query("parts", PARTS, REPS, importance.REPEATS)


@query(
    "permutation_importance",
    f"WITH {PARTS_SQL},\n{_NB_CTES}\nSELECT target, feature, pos, rep, {rounded('score', 9, 'score')} FROM ({_NB_SELECT})",
)
def permutation_importance(spark, sf):
    rows = importance.importance(coded_parts(spark, sf), PARTS, FAST, REPS, targets=list(PARTS.categorical))
    return rows.withColumn("score", rnd("score", 9))


_LINEAR_CTES, _LINEAR_SELECT = linear_reps_sql("lin", "coded", ITEMS.columns, CONTINUOUS, REPS)


def _linear_rows(spark, sf):
    base = coded_items(spark, sf)
    return importance.importance_by_moments(base.df, base.n, ITEMS, list(CONTINUOUS), "linear", REPS)


@query(
    "permutation_importance_linear",
    f"WITH RECURSIVE {CODED_SQL},\n" + ",\n".join(_LINEAR_CTES)
    + f"\nSELECT target, feature, pos, rep, {rounded('score', 6, 'score')} FROM ({_LINEAR_SELECT})",
)
def permutation_importance_linear(spark, sf):
    return _linear_rows(spark, sf).withColumn("score", rnd("score", 6))


@query(
    "importance_mean",
    f"WITH RECURSIVE {CODED_SQL},\n" + ",\n".join(_LINEAR_CTES)
    + f"\nSELECT target, feature, pos, round(avg(score), 6) AS score FROM ({_LINEAR_SELECT}) GROUP BY target, feature, pos",
)
def importance_mean(spark, sf):
    return importance.importance_mean(_linear_rows(spark, sf)).withColumn("score", rnd("score", 6))


@query(
    "importance_variance",
    f"WITH RECURSIVE {CODED_SQL},\n" + ",\n".join(_LINEAR_CTES)
    + f"\nSELECT target, feature, pos, round(var_pop(score), 6) AS variance FROM ({_LINEAR_SELECT}) GROUP BY target, feature, pos",
)
def importance_variance(spark, sf):
    return importance.importance_variance(_linear_rows(spark, sf)).withColumn("variance", rnd("variance", 6))


# ---------------------------------------------------------------- rank measures


def _pairs(spark, sf):
    a, b = run_scores(spark, sf)
    return rank.pair_scores(a, b, ["run"])


@query("ordinal_rank", f"WITH RECURSIVE {RUN_SCORES_SQL} SELECT run, target, feature, pos, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b FROM ranked")
def ordinal_rank(spark, sf):
    return rank.ordinal_rank(_pairs(spark, sf), ["run"]).select("run", "target", "feature", "pos", "rank_a", "rank_b")


_QUERY_OF = {"r2": "score_r2"}


def _measure(metric):
    def run(spark, sf):
        scores = rank.score_ranks(_pairs(spark, sf), ["run"], metrics=[metric])
        return scores.select("run", "target", rnd(metric, 9).alias("value"))

    return run


for _metric in rank.METRICS:
    _sql = f"WITH RECURSIVE {RUN_SCORES_SQL} SELECT run, target, {rounded(_metric, 9, 'value')} FROM measured"
    query(_QUERY_OF.get(_metric, f"rank_{_metric}"), _sql)(_measure(_metric))


@query("rank_join_string", f"WITH RECURSIVE {RUN_SCORES_SQL} SELECT run, target, rank_join_a, rank_join_b FROM measured")
def rank_join_string(spark, sf):
    return rank.score_ranks(_pairs(spark, sf), ["run"], metrics=["hamming"]).select("run", "target", "rank_join_a", "rank_join_b")


def long_run_scores(spark, sf):
    return rank.compare_importances(*run_scores(spark, sf), ["run"])


@query("score_aggregate", f"WITH RECURSIVE {RUN_SCORES_SQL} SELECT run, metric, {rounded('avg(value)', 9, 'value')} FROM long_scores GROUP BY run, metric")
def score_aggregate(spark, sf):
    return rank.score_aggregate(long_run_scores(spark, sf), ["run"]).withColumn("value", rnd("value", 9))


@query("compare_importances", f"WITH RECURSIVE {RUN_SCORES_SQL} SELECT run, target, metric, {rounded('value', 9, 'value')} FROM long_scores")
def compare_importances(spark, sf):
    return long_run_scores(spark, sf).withColumn("value", rnd("value", 9))


# ---------------------------------------------------------------- cross utility


def utility_ctes(name: str, source: str, other: str, columns, categorical) -> tuple[list[str], str]:
    """CTEs and the select ``(target, ratio, own, other, higher_is_better)`` of one direction."""
    features = lambda t: [c for c in columns if c != t]
    ctes = [
        f"{name}_h AS (SELECT *, {permuted_sql('idx', 42)} < ceil(n * 0.2) AS is_test FROM {source})",
        f"{name}_t AS (SELECT * FROM {name}_h WHERE NOT is_test)",
        f"{name}_r AS (SELECT idx * 2 AS rid, 'own' AS part, {', '.join(columns)} FROM {name}_h WHERE is_test"
        f" UNION ALL SELECT idx * 2 + 1, 'other', {', '.join(columns)} FROM {other})",
        inverse_sql(f"{name}_t", columns, name=f"{name}_i"),
    ]
    parts = []
    for t in columns:
        if t in categorical:
            ctes.append(nb_sql(f"{name}_n_{t}", f"{name}_t", f"{name}_r", t, features(t)))
            parts.append(
                f"SELECT '{t}' AS target, true AS higher_is_better, avg(CAST(y = prediction AS INTEGER)) FILTER (rid % 2 = 0) AS own,"
                f" avg(CAST(y = prediction AS INTEGER)) FILTER (rid % 2 = 1) AS other FROM {name}_n_{t}"
            )
        else:
            e = residual_sql(columns.index(t), columns)
            parts.append(
                f"SELECT '{t}' AS target, false AS higher_is_better, avg(power({e}, 2)) FILTER (part = 'own') AS own,"
                f" avg(power({e}, 2)) FILTER (part = 'other') AS other FROM {name}_r r, {name}_i i"
            )
    ctes.append(f"{name} AS (SELECT target, other / own AS ratio, own, other, higher_is_better FROM ({' UNION ALL '.join(parts)}))")
    return ctes, name


_FORTH, _ = utility_ctes("forth", "coded", "mixed", ITEMS.columns, CATEGORICAL)
_BACK, _ = utility_ctes("back", "mixed", "coded", ITEMS.columns, CATEGORICAL)


def both_sql(forth: list[str], back: list[str]) -> str:
    """CTEs of both directions, their rows and the cross values."""
    return f"""{', '.join(forth)},\n{', '.join(back)},
cross_rows AS (SELECT 'a' AS train_side, 'b' AS test_side, * FROM forth UNION ALL SELECT 'b', 'a', * FROM back),
cross_cc AS (SELECT target, max((ratio + own + other) / 3) FILTER (train_side = 'a') / max((ratio + own + other) / 3) FILTER (train_side = 'b') AS cc_reference,
   max(ratio) FILTER (train_side = 'a') / max(ratio) FILTER (train_side = 'b') AS cc_ratio FROM cross_rows GROUP BY target)"""


BOTH_SQL = f"{PAIR_SQL},\n{both_sql(_FORTH, _BACK)}"
_UTILITY_COLUMNS = f"target, {rounded('ratio', 5, 'ratio')}, {rounded('own', 5, 'own')}, {rounded('other', 5, 'other')}, higher_is_better"


def _predictions_sql() -> str:
    rows = [
        f"SELECT '{t}' AS target, rid, prediction FROM forth_n_{t}"
        if t in CATEGORICAL
        else f"SELECT '{t}' AS target, r.rid, r.{t} - {residual_sql(i, ITEMS.columns)} AS prediction FROM forth_r r, forth_i i"
        for i, t in enumerate(ITEMS.columns)
    ]
    return (
        f"WITH RECURSIVE {PAIR_SQL},\n{', '.join(_FORTH)} SELECT CASE WHEN rid % 2 = 0 THEN 'own' ELSE 'other' END AS part, target,"
        f" rid // 2 AS idx, {settled_sql('prediction', 5, 'prediction')} FROM ({' UNION ALL '.join(rows)})"
    )


@query("predict_per_target", _predictions_sql())
def predict_per_target(spark, sf):
    """All targets on the held-out rows and on the shuffled table."""
    a, b = coded_pair(spark, sf)
    split = holdout_split(a)
    train, columns = split.where(~F.col("is_test")), ["idx", *map(q, ITEMS.columns)]
    part = lambda name, df: df.select(F.lit(name).alias("part"), *columns)
    rows = part("own", split.where("is_test")).unionByName(part("other", b.df))
    cells = []
    for k, (target, model) in enumerate(fit_all_targets(train, ITEMS, FAST).items()):
        rows = model.predict(rows).withColumnRenamed("prediction", f"_pred{k}")
        cells.append(F.struct(F.lit(target).alias("target"), settled(f"_pred{k}", 5).alias("prediction")))
    return rows.select("part", "idx", F.inline(F.array(*cells))).select("part", "target", "idx", "prediction")


def _round_utility(df):
    return df.withColumns({c: rnd(c, 5) for c in ("ratio", "own", "other")})


@query(
    "utility_one_direction",
    f"WITH RECURSIVE {PAIR_SQL},\n{', '.join(_FORTH)} SELECT {_UTILITY_COLUMNS} FROM forth",
)
def utility_one_direction(spark, sf):
    a, b = coded_pair(spark, sf)
    return _round_utility(utility.utility_one_direction(a, b.df, ITEMS, FAST))


def both_directions(spark, sf):
    a, b = coded_pair(spark, sf)
    return utility.utility_both_directions(a, b, ITEMS, FAST)


@query("utility_both_directions", f"WITH RECURSIVE {BOTH_SQL} SELECT train_side, test_side, {_UTILITY_COLUMNS} FROM cross_rows")
def utility_both_directions(spark, sf):
    return _round_utility(both_directions(spark, sf))


@query(
    "cross_aggregate",
    f"WITH RECURSIVE {BOTH_SQL} SELECT target, round(cc_reference, 5) AS cc_reference, round(cc_ratio, 5) AS cc_ratio FROM cross_cc",
)
def cross_aggregate(spark, sf):
    rows = utility.cross_aggregate(both_directions(spark, sf))
    return rows.withColumns({c: rnd(c, 5) for c in ("cc_reference", "cc_ratio")})


@query(
    "utility_ratio_legacy",
    f"WITH RECURSIVE {BOTH_SQL} SELECT round(cc_ratio, 5) AS \"cross\" FROM cross_cc WHERE target = '{ITEMS.columns[-1]}'",
)
def utility_ratio_legacy(spark, sf):
    out = utility.utility_ratio_legacy(both_directions(spark, sf), ITEMS.columns)
    return out.select(rnd("cross", 5).alias("cross"))


@query(
    "ratio_inf_to_zero_mean",
    f"WITH RECURSIVE {BOTH_SQL} SELECT train_side, round(avg(ratio), 5) AS mean_ratio FROM cross_rows GROUP BY train_side",
)
def ratio_inf_to_zero_mean(spark, sf):
    return utility.ratio_inf_to_zero_mean(both_directions(spark, sf)).withColumn("mean_ratio", rnd("mean_ratio", 5))


_PREDICTED_NB = f"WITH {CODED_SQL}, rows_ AS (SELECT idx AS rid, * FROM coded),\n{nb_sql('nb', 'coded', 'rows_', 'linestatus', _others('linestatus'))}"


@query(
    "accuracy",
    f"{_PREDICTED_NB} SELECT line, round(avg(CAST(y = prediction AS INTEGER)), 9) AS accuracy FROM nb JOIN coded ON idx = rid GROUP BY line",
)
def accuracy(spark, sf):
    rows = coded_rows(spark, sf)
    model = FITTERS["gaussian_nb"](rows, "linestatus", _others("linestatus"))
    scored = model.predict(rows).groupBy("line")
    return scored.agg(rnd(utility.accuracy(F.col("linestatus"), F.col("prediction")), 9).alias("accuracy"))


@query(
    "mse",
    f"""WITH RECURSIVE {CODED_SQL},\n{inverse_sql('coded', ITEMS.columns)}
SELECT line, round(avg(power({residual_sql(ITEMS.columns.index('quantity'), ITEMS.columns)}, 2)), 6) AS mse FROM coded r, inv i GROUP BY line""",
)
def mse(spark, sf):
    rows = coded_rows(spark, sf)
    model = FITTERS["linear"](rows, "quantity", _others("quantity"))
    scored = model.predict(rows).groupBy("line")
    return scored.agg(rnd(utility.mse(F.col("quantity"), F.col("prediction")), 6).alias("mse"))
