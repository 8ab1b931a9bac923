"""Queries of result reshaping and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, rank, report, utility
from ..operators.clean import q
from ..session import scratch_path
from ..sources import tables as src
from .bindings import CONTINUOUS, ITEMS_SQL, items, keyed_scores, keyed_scores_sql, measures_sql, rnd, rounded, table
from .queries_models import BOTH_SQL, both_directions
from .registry import query

# ---------------------------------------------------------------- result rows the reports read

METRIC_NAMES = ("ndgc_score", "r2_score", "rbo", "kendalltau")
DATASETS, METHODS, RUNS = ("F", "O"), ("A", "N", "R"), tuple(range(1, 8))
RESULT_SQL = """results AS (
  SELECT dataset, method, run, n_reps, metric, value FROM (
    SELECT l_linestatus AS dataset, l_returnflag AS method, l_linenumber AS run, CAST(5 * quarter(l_shipdate) AS INTEGER) AS n_reps,
           CAST(year(l_shipdate) AS INTEGER) AS rep, avg(l_discount) * 20 AS ndgc_score, avg(l_tax) * 25 AS r2_score,
           avg(l_quantity) / 50 AS rbo, avg(l_extendedprice) / 60000 AS kendalltau
    FROM lineitem GROUP BY ALL) UNPIVOT (value FOR metric IN (ndgc_score, r2_score, rbo, kendalltau)))"""


def result_rows(spark, sf):
    """Long result rows: a value per dataset, method, run, repetition and metric."""
    df = table(spark, sf, "lineitem")
    keys = [
        F.col("l_linestatus").alias("dataset"),
        F.col("l_returnflag").alias("method"),
        F.col("l_linenumber").alias("run"),
        (F.quarter("l_shipdate") * 5).alias("n_reps"),
        F.year("l_shipdate").alias("rep"),
    ]
    wide = df.groupBy(*keys).agg(
        (F.avg("l_discount") * 20).alias("ndgc_score"),
        (F.avg("l_tax") * 25).alias("r2_score"),
        (F.avg("l_quantity") / 50).alias("rbo"),
        (F.avg("l_extendedprice") / 60000).alias("kendalltau"),
    )
    return wide.unpivot(["dataset", "method", "run", "n_reps", "rep"], list(METRIC_NAMES), "metric", "value")


CROSS_ONLY_SQL = f"""cross_long AS (
  SELECT dataset, method, run, type, col AS "column", other / own AS ratio, own, other FROM ({' UNION ALL '.join(
    f"SELECT 'items' AS dataset, returnflag AS method, 'run ' || line AS run, CASE WHEN tax > 0.04 THEN 'real_synth' ELSE 'synth_real' END AS type,"
    f" '{c}' AS col, avg({c}) FILTER (discount <= 0.05) AS own, avg({c}) FILTER (discount > 0.05) AS other FROM items GROUP BY ALL" for c in ('quantity', 'price', 'net'))}))"""
CROSS_SQL = f"{ITEMS_SQL},\n{CROSS_ONLY_SQL}"
CROSS_COLUMNS = ("quantity", "price", "net")


def cross_long(spark, sf):
    """Rows ``(dataset, method, run, type, column, ratio, own, other)`` in the shape of cross results."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("v")) for c in CROSS_COLUMNS])
    low = F.col("discount") <= 0.05
    rows = items(spark, sf).select(
        F.lit("items").alias("dataset"),
        F.col("returnflag").alias("method"),
        F.concat(F.lit("run "), "line").alias("run"),
        F.when(F.col("tax") > 0.04, "real_synth").otherwise("synth_real").alias("type"),
        low.alias("low"),
        F.inline(cells),
    )
    return (
        rows.groupBy("dataset", "method", "run", "type", "column")
        .agg(F.avg(F.when(F.col("low"), F.col("v"))).alias("own"), F.avg(F.when(~F.col("low"), F.col("v"))).alias("other"))
        .select("dataset", "method", "run", "type", "column", (F.col("other") / F.col("own")).alias("ratio"), "own", "other")
    )


_KEYS = ("method", "run")
NESTED_SQL = f"""{keyed_scores_sql(_KEYS)},
{measures_sql(_KEYS)},
{CROSS_ONLY_SQL}"""


def nested_results(spark, sf):
    """A row per method and run with the maps of nested result files, from the rank measures and cross rows."""
    scores = rank.compare_importances(*keyed_scores(spark, sf, list(_KEYS)), list(_KEYS))
    named = scores.select(
        F.lit("items").alias("dataset"), "method", F.format_string("run %d", "run").alias("run"), "target", "metric", "value"
    )
    return src.nest_results(named, cross_long(spark, sf))


_FLAT_SQL = """flat AS (
  SELECT method, 'items' AS dataset, 'run ' || run AS run, metric, target, value FROM long_scores
  UNION ALL SELECT method, dataset, run, type, "column", ratio FROM cross_long
  UNION ALL SELECT r.method, r.dataset, r.run, 'ratio_rs_sr', NULL, (s.ratio + s.own + s.other) / (r.ratio + r.own + r.other)
    FROM cross_long r JOIN cross_long s USING (method, dataset, run, "column") WHERE r.type = 'real_synth' AND s.type = 'synth_real')"""


def _flat(spark, sf):
    return report.flatten_results(nested_results(spark, sf), ["method", "dataset"])


@query(
    "flatten_results",
    f"WITH RECURSIVE {NESTED_SQL},\n{_FLAT_SQL} SELECT method, dataset, run, metric, target, {rounded('value', 9, 'value')} FROM flat",
)
def flatten_results(spark, sf):
    return _flat(spark, sf).withColumn("value", rnd("value", 9))


@query(
    "read_results_json",
    f"WITH RECURSIVE {NESTED_SQL},\n{_FLAT_SQL} SELECT method, dataset, run, metric, target, {rounded('value', 9, 'value')} FROM flat",
)
def read_results_json(spark, sf):
    path = scratch_path(spark, "json")
    src.write_results_json(nested_results(spark, sf), path)
    read = src.read_results_json(spark, path)
    return report.flatten_results(read, ["method", "dataset"]).withColumn("value", rnd("value", 9))


@query(
    "read_score_lists",
    f"""WITH RECURSIVE {keyed_scores_sql(_KEYS)},
{measures_sql(_KEYS)}
SELECT method, 'items' AS dataset, 'run ' || run AS run, metric, CAST(row_number() OVER (PARTITION BY method, run, metric ORDER BY target) - 1 AS INTEGER) AS pos,
  {rounded('value', 9, 'value')} FROM long_scores
UNION ALL SELECT method, 'items', 'run ' || run, metric, -1, {rounded('avg(value)', 9, 'value')} FROM long_scores GROUP BY method, run, metric""",
)
def read_score_lists(spark, sf):
    """Result files of the older shape: the lists behind the means, and the means under position -1."""
    scores = rank.compare_importances(*keyed_scores(spark, sf, list(_KEYS)), list(_KEYS))
    values = scores.select(
        F.lit("items").alias("dataset"), "method", F.format_string("run %d", "run").alias("run"), "metric", F.col("target").alias("pos"), "value"
    )
    path = scratch_path(spark, "json")
    src.write_results_json(src.nest_score_lists(values), path)
    read = src.read_results_json(spark, path)
    keys = ["method", "dataset"]
    means = report.flatten_results(read, keys).withColumn("pos", F.lit(-1)).drop("target")
    return report.explode_lists(read, keys).unionByName(means).withColumn("value", rnd("value", 9))


@query(
    "read_result_vectors",
    f"""WITH RECURSIVE {keyed_scores_sql(_KEYS)},
{measures_sql(_KEYS)}
SELECT r.method, 'items' AS dataset, 'run ' || r.run AS run, r.target, CAST(r.place - 1 AS INTEGER) AS pos, r.score_a AS true_score, r.score_b AS model_score,
  CAST(r.rank_a AS INTEGER) AS true_rank, CAST(r.rank_b AS INTEGER) AS model_rank, m.rank_join_a AS true_join, m.rank_join_b AS model_join
FROM ranked r JOIN per_target m USING (method, run, target)""",
)
def read_result_vectors(spark, sf):
    """Score vectors, rank vectors and joined ranks through written result files."""
    a, b = keyed_scores(spark, sf, list(_KEYS))
    run = lambda df: df.withColumns({"dataset": F.lit("items"), "run": F.format_string("run %d", "run")})
    scores = run(rank.compare_importances(a, b, list(_KEYS)))
    vectors = run(rank.ordinal_rank(rank.pair_scores(a, b, list(_KEYS)), list(_KEYS)))
    path = scratch_path(spark, "json")
    src.write_results_json(src.nest_results(scores, cross_long(spark, sf), vectors=vectors), path)
    return report.extract_vectors(src.read_results_json(spark, path), ["method", "dataset"])


@query(
    "extract_cross",
    f"""WITH {CROSS_SQL} SELECT method, dataset, run, type, "column", round(ratio, 9) AS ratio, round(own, 9) AS own, round(other, 9) AS other FROM cross_long""",
)
def extract_cross(spark, sf):
    rows = report.extract_cross(nested_results(spark, sf), ["method", "dataset"])
    return rows.withColumns({c: rnd(c, 9) for c in ("ratio", "own", "other")})


@query(
    "explode_melt",
    f"""WITH {CROSS_SQL} SELECT method, run, type AS variable, round(ratio, 9) AS value FROM cross_long
UNION ALL SELECT s.method, s.run, 'ratio', round(s.ratio / r.ratio, 9) FROM cross_long r
 JOIN cross_long s USING (method, run, "column") WHERE r.type = 'real_synth' AND s.type = 'synth_real'""",
)
def explode_melt(spark, sf):
    triple = F.struct("column", F.array("ratio", "own", "other").alias("t"))
    lists = cross_long(spark, sf).groupBy("method", "run").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("type") == s, triple))).alias(s)  # one entry per column
            for s in ("real_synth", "synth_real")
        ]
    )
    wide = lists.select(
        "method",
        "run",
        F.col("real_synth.t").alias("real_synth"),
        F.col("synth_real.t").alias("synth_real"),
        F.zip_with("real_synth", "synth_real", lambda r, s: s["t"][0] / r["t"][0]).alias("ratio"),
    )
    melted = report.explode_melt(wide, ["method", "run"], ["real_synth", "synth_real", "ratio"])
    return melted.withColumn("value", rnd("value", 9))


# ---------------------------------------------------------------- grouping, labels, codes


@query(
    "union_tagged",
    """SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""",
)
def union_tagged(spark, sf):
    return report.union_tagged(
        {
            "customer": table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
            "supplier": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")),
        }
    )


@query(
    "strip_prefix_cast",
    f"""WITH {CROSS_SQL} SELECT method, type, "column", CAST(replace(run, 'run ', '') AS INTEGER) AS run, round(own, 9) AS own FROM cross_long""",
)
def strip_prefix_cast(spark, sf):
    rows = report.strip_prefix_cast(cross_long(spark, sf), "run")
    return rows.select("method", "type", "column", "run", rnd("own", 9).alias("own"))


@query(
    "group_mean_var_std",
    f"""WITH {RESULT_SQL} SELECT metric, run, round(avg(value), 9) AS mean, round(var_samp(value), 9) AS variance,
 round(sqrt(var_samp(value)), 9) AS error FROM results WHERE metric <> 'r2_score' GROUP BY metric, run""",
)
def group_mean_var_std(spark, sf):
    rows = clean.filter_rows(result_rows(spark, sf), differs={"metric": "r2_score"})
    out = report.group_mean_var_std(rows, ["metric", "run"])
    return out.withColumns({c: rnd(c, 9) for c in ("mean", "variance", "error")})


# Metric labels of the report tables.
METRIC_LABELS = {
    "ndgc_score": "NDCG",
    "cohen_kappa_score": "Cohen k",
    "r2_score": "R2",
    "levenshtein_normalized_similarity": "Lev",
    "kendalltau": "Ktau",
    "weightedtau": "WKtau",
    "rbo": "RBO",
    "damerau_levenshtein_normalized_similarity": "Damerau",
    "jaro_winkler_normalized_similarity": "Jaro",
    "hamming_normalized_similarity": "Hamming",
    "real_synth": "TRTS",
    "synth_real": "TSTR",
}


@query(
    "relabel",
    f"""WITH {RESULT_SQL} SELECT CASE metric WHEN 'ndgc_score' THEN 'NDCG' WHEN 'r2_score' THEN 'R2' WHEN 'rbo' THEN 'RBO' ELSE 'Ktau' END AS metric,
 method, count(*) AS n, round(avg(value), 9) AS value FROM results GROUP BY ALL""",
)
def relabel(spark, sf):
    rows = report.relabel(result_rows(spark, sf), "metric", METRIC_LABELS)
    return rows.groupBy("metric", "method").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 9).alias("value"))


@query(
    "category_code",
    "SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders",
)
def category_code(spark, sf):
    return report.category_code(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "series_offset",
    f"""WITH {RESULT_SQL}, coded AS (SELECT DISTINCT metric, run, dense_rank() OVER (ORDER BY run) - 1 AS code, dense_rank() OVER (ORDER BY metric) - 1 AS i FROM results)
SELECT metric, run, round(code + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * 0.03 * i, 6) AS x FROM coded""",
)
def series_offset(spark, sf):
    points = report.category_code(result_rows(spark, sf).select("metric", "run").distinct(), "run")
    return report.series_offset(points, "metric").select("metric", "run", rnd("x", 6).alias("x"))


# ---------------------------------------------------------------- report tables

_AGG = "round(avg(ratio), 9) AS ratio_mean, round(stddev_samp(ratio), 9) AS ratio_std, round(avg(own), 9) AS own_mean, round(stddev_samp(own), 9) AS own_std"
GROUPINGS = (("column", "method", "type"), ("dataset", "column", "type"), ("dataset", "column", "method"), ("type", "method"))


@query(
    "group_mean_std_by",
    f"""WITH {CROSS_SQL} SELECT "column", method, type, dataset, {_AGG} FROM cross_long
GROUP BY GROUPING SETS (("column", method, type), (dataset, "column", type), (dataset, "column", method), (type, method))""",
)
def group_mean_std_by(spark, sf):
    out = report.group_mean_std_by(cross_long(spark, sf), GROUPINGS, ["ratio", "own"])
    return out.withColumns({c: rnd(c, 9) for c in ("ratio_mean", "ratio_std", "own_mean", "own_std")})


def _round_sql(x, threshold):
    return f"CASE WHEN {x} < {threshold} THEN round_even({x}, 3) ELSE round_even({x}, 0) END"


_BY = 'SELECT "column", method, type, avg(ratio) AS rm, stddev_samp(ratio) AS rs, avg(own) AS om, stddev_samp(own) AS os, avg(other) AS tm, stddev_samp(other) AS ts FROM cross_long GROUP BY ALL'


def _by_column(spark, sf):
    return report.group_mean_std_by(cross_long(spark, sf), [("column", "method", "type")], ["ratio", "own", "other"])


@query(
    "conditional_round",
    f"""WITH {CROSS_SQL} SELECT "column", method, type, {_round_sql('rm', 10)} AS ratio_mean, {_round_sql('om', 1)} AS own_mean, {_round_sql('os', 1)} AS own_std FROM ({_BY})""",
)
def conditional_round(spark, sf):
    return _by_column(spark, sf).select(
        "column",
        "method",
        "type",
        report.conditional_round(F.col("ratio_mean"), 10).alias("ratio_mean"),
        report.conditional_round(F.col("own_mean")).alias("own_mean"),
        report.conditional_round(F.col("own_std")).alias("own_std"),
    )


def _text_sql(m, s, threshold):
    return f"CAST({_round_sql(m, threshold)} AS VARCHAR) || ' (' || CAST({_round_sql(s, threshold)} AS VARCHAR) || ')'"


_FORMATTED_SQL = f"""formatted AS (SELECT "column", method, type, {_text_sql('om', 'os', 1)} AS concatenated1, {_text_sql('tm', 'ts', 1)} AS concatenated2,
 {_text_sql('rm', 'rs', 10)} AS concatenated3 FROM ({_BY}))"""
VALUES = ("concatenated1", "concatenated2", "concatenated3")


def formatted(spark, sf):
    r = report.conditional_round
    cell = lambda m, t: report.format_mean_std((r(F.col(f"{m}_mean"), t), r(F.col(f"{m}_std"), t)))
    return _by_column(spark, sf).select(
        "column",
        "method",
        "type",
        cell("own", 1).alias("concatenated1"),
        cell("other", 1).alias("concatenated2"),
        cell("ratio", 10).alias("concatenated3"),
    )


@query(
    "format_mean_std",
    f"""WITH {CROSS_SQL},\n{_FORMATTED_SQL} SELECT "column", method, type, concatenated1 || ' | ' || concatenated2 AS both_values, concatenated3 FROM formatted""",
)
def format_mean_std(spark, sf):
    r = lambda c: report.conditional_round(F.col(c))
    pairs = report.format_mean_std((r("own_mean"), r("own_std")), (r("other_mean"), r("other_std")))
    ratio = lambda c: report.conditional_round(F.col(c), 10)
    return _by_column(spark, sf).select(
        "column", "method", "type", pairs.alias("both_values"),
        report.format_mean_std((ratio("ratio_mean"), ratio("ratio_std"))).alias("concatenated3"),
    )


@query(
    "variance_by_reps",
    f"WITH {RESULT_SQL} SELECT n_reps, run, metric, round(var_pop(value), 9) AS variance FROM results GROUP BY n_reps, run, metric",
)
def variance_by_reps(spark, sf):
    return report.variance_by_reps(result_rows(spark, sf)).withColumn("variance", rnd("variance", 9))


def _pivot_sql(value, labels, column, name):
    return ", ".join(f"max({value}) FILTER ({column} = '{x}') AS {name.format(x=x, v=value)}" for x in labels)


@query(
    "pivot_first",
    f"""WITH {CROSS_SQL},\n{_FORMATTED_SQL} SELECT "column", type, {_pivot_sql('concatenated3', METHODS, 'method', '{x}')} FROM formatted GROUP BY "column", type""",
)
def pivot_first(spark, sf):
    return report.pivot_first(formatted(spark, sf), ["column", "type"], "method", ["concatenated3"], METHODS)


@query(
    "pivot_multi_value",
    f"""WITH {CROSS_SQL},\n{_FORMATTED_SQL} SELECT "column", method, {', '.join(_pivot_sql(v, ('real_synth', 'synth_real'), 'type', '{v}_{x}') for v in VALUES)}
FROM formatted GROUP BY "column", method""",
)
def pivot_multi_value(spark, sf):
    return report.pivot_first(formatted(spark, sf), ["column", "method"], "type", VALUES, ["real_synth", "synth_real"])


@query(
    "crosstab_mean",
    f"WITH {RESULT_SQL} SELECT n_reps, run, {', '.join(f'''round(avg(value) FILTER (metric = '{m}'), 9) AS {m}''' for m in METRIC_NAMES)} FROM results GROUP BY n_reps, run",
)
def crosstab_mean(spark, sf):
    out = report.crosstab_mean(result_rows(spark, sf), ["n_reps", "run"], "metric", "value", METRIC_NAMES)
    return out.withColumns({m: rnd(m, 9) for m in METRIC_NAMES})


@query(
    "cap_values",
    f"WITH {RESULT_SQL} SELECT n_reps, run, metric, round(least(var_pop(value), 0.01), 9) AS variance FROM results GROUP BY n_reps, run, metric",
)
def cap_values(spark, sf):
    capped = report.cap_values(report.variance_by_reps(result_rows(spark, sf)), ["variance"], 0.01)
    return capped.withColumn("variance", rnd("variance", 9))


@query(
    "column_type_tag",
    f"""WITH {CROSS_SQL} SELECT CASE WHEN "column" IN ('price', 'net') THEN 'Continuous' ELSE 'Categorical' END AS column_type, type, method,
 count(*) AS n, round(avg(own), 9) AS own FROM cross_long GROUP BY ALL""",
)
def column_type_tag(spark, sf):
    tagged = report.column_type_tag(cross_long(spark, sf), "column", ["price", "net"])
    return tagged.groupBy("column_type", "type", "method").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("own"), 9).alias("own"))


@query(
    "cellwise_mean",
    f"WITH {RESULT_SQL} SELECT dataset, metric, run, round(avg(value), 9) AS value FROM results GROUP BY dataset, metric, run",
)
def cellwise_mean(spark, sf):
    return report.cellwise_mean(result_rows(spark, sf)).withColumn("value", rnd("value", 9))


_MEAN_RUN = "means AS (SELECT dataset, metric, run, avg(value) AS value FROM results GROUP BY dataset, metric, run)"


@query(
    "last_run",
    f"""WITH {RESULT_SQL}, {_MEAN_RUN} SELECT dataset, {', '.join(f'''round(arg_max(value, run) FILTER (metric = '{m}'), 9) AS {m}''' for m in METRIC_NAMES)}
FROM means GROUP BY dataset""",
)
def last_run(spark, sf):
    out = report.last_run(report.cellwise_mean(result_rows(spark, sf)), ["dataset"], METRIC_NAMES)
    return out.withColumns({m: rnd(m, 9) for m in METRIC_NAMES})


@query(
    "step_difference",
    f"""WITH {RESULT_SQL}, {_MEAN_RUN},
steps AS (SELECT dataset, metric, run, round_even(abs(value - lead(value) OVER (PARTITION BY dataset, metric ORDER BY run)), 2) AS step FROM means)
SELECT dataset, metric, run, step, step = min(step) OVER (PARTITION BY run) AS is_min, step = max(step) OVER (PARTITION BY run) AS is_max
FROM steps WHERE step IS NOT NULL""",
)
def step_difference(spark, sf):
    return report.step_difference(report.cellwise_mean(result_rows(spark, sf)), ["dataset", "metric"])


@query(
    "wide_metric_table",
    f"""WITH RECURSIVE {BOTH_SQL}, parts AS (SELECT target AS dataset, train_side, avg(ratio) AS mean_ratio FROM cross_rows GROUP BY target, train_side),
means AS (SELECT "column" AS dataset, metric, avg(value) AS value FROM (SELECT target AS "column", 'own' AS metric, own AS value FROM cross_rows
  UNION ALL SELECT target, 'other', other FROM cross_rows) GROUP BY ALL)
SELECT dataset, round(max(value) FILTER (metric = 'own'), 5) AS own, round(max(value) FILTER (metric = 'other'), 5) AS other,
 round(any_value(b), 5) AS real_synth, round(any_value(a), 5) AS synth_real, round(any_value(a / b), 5) AS cc
FROM means JOIN (SELECT dataset, max(mean_ratio) FILTER (train_side = 'a') AS a, max(mean_ratio) FILTER (train_side = 'b') AS b FROM parts GROUP BY dataset) USING (dataset)
GROUP BY dataset""",
)
def wide_metric_table(spark, sf):
    rows = both_directions(spark, sf).withColumn("dataset", F.col("target"))
    metrics = rows.unpivot(["dataset"], ["own", "other"], "metric", "value")
    directions = utility.ratio_inf_to_zero_mean(rows, ["dataset", "train_side"])
    out = report.wide_metric_table(metrics, directions, ["dataset"], ["own", "other"])
    return out.withColumns({c: rnd(c, 5) for c in ("own", "other", "real_synth", "synth_real", "cc")})


@query(
    "row_bucket_label",
    """SELECT p_partkey, ['small', 'middle', 'large'][p_size // 20 + 1] AS label, ['zero', 'one', 'two', 'three', 'four'][p_size % 5 + 1] AS place FROM part""",
)
def row_bucket_label(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    grouped = report.row_bucket_label(df, "p_size", 20, ["small", "middle", "large"])
    placed = report.row_bucket_label(grouped, "p_size", 5, ["zero", "one", "two", "three", "four"], "place", by_remainder=True)
    return placed.drop("p_size")


@query(
    "box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM events WHERE value IS NOT NULL GROUP BY event_type),
j AS (SELECT e.event_type, e.value, q1, median, q3, e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (inside) AS low, max(value) FILTER (inside) AS high,
 count(*) FILTER (NOT inside) AS n_outside FROM j GROUP BY event_type, q1, median, q3""",
)
def box_stats(spark, sf):
    out = report.box_stats(table(spark, sf, "events"), ["event_type"])
    return out.withColumns({c: rnd(c, 6) for c in ("q1", "median", "q3")})


@query(
    "melt_filter_series",
    f"""WITH {RESULT_SQL}, wide AS (SELECT method, run, {', '.join(f'''avg(value) FILTER (metric = '{m}') AS {m}''' for m in METRIC_NAMES)} FROM results GROUP BY method, run)
SELECT method, run, metric, round(value, 9) AS value FROM (SELECT method, run, 'rbo' AS metric, rbo AS value FROM wide UNION ALL SELECT method, run, 'kendalltau', kendalltau FROM wide)""",
)
def melt_filter_series(spark, sf):
    wide = report.crosstab_mean(result_rows(spark, sf), ["method", "run"], "metric", "value", METRIC_NAMES)
    return report.melt_filter_series(wide, ["method", "run"], ["rbo", "kendalltau"]).withColumn("value", rnd("value", 9))
