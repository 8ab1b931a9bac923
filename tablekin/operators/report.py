"""Reshaping of result rows into report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .clean import q


def flatten_results(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nested results to rows ``(keys…, run, metric, target, value)``.

    ``results`` has the columns ``run``, ``targets`` (map target → struct with a ``results`` map), and
    ``cross`` (struct with the maps ``real_synth``, ``synth_real`` of triples and the array ``aggregated``).
    The first element of a triple is the ratio; ``aggregated`` gives the metric ``ratio_rs_sr``.
    A run of the older shape (``lists`` is not null) gives its mean of each measure, without a target.
    """
    cell = "named_struct('metric', {}, 'target', {}, 'value', {})"
    of_target = cell.format("m.key", "t.key", "m.value")
    metrics = f"flatten(transform(map_entries(targets), t -> transform(map_entries(t.value.results), m -> {of_target})))"
    ratios = [
        f"transform(map_entries(cross.{name}), t -> {cell.format(repr(name), 't.key', 't.value[0]')})"
        for name in ("real_synth", "synth_real")
    ]
    quotient = cell.format("'ratio_rs_sr'", "CAST(NULL AS STRING)", "v")
    cells = f"concat({metrics}, {', '.join(ratios)}, transform(cross.aggregated, v -> {quotient}))"
    if "lists" in results.columns:
        mean = cell.format("m.key", "CAST(NULL AS STRING)", "m.value")
        cells = f"IF(lists IS NULL, {cells}, transform(map_entries(aggregated), m -> {mean}))"
    return results.select(*keys, "run", F.inline(F.expr(cells)))


def explode_lists(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The value lists of runs of the older shape to rows ``(keys…, run, metric, pos, value)``."""
    lists = results.select(*keys, "run", F.explode("lists").alias("metric", "values"))
    return lists.select(*keys, "run", "metric", F.posexplode("values").alias("pos", "value"))


def extract_vectors(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score and rank vectors to rows ``(keys…, run, target, pos, true_score, model_score, true_rank, model_rank, true_join, model_join)``."""
    one = results.select(*keys, "run", F.explode("targets").alias("target", "t"))
    cells = F.arrays_zip("t.true_score", "t.model_score", "t.true_score_rank", "t.model_score_rank")
    joins = [F.col("t.true_score_rank_join").alias("true_join"), F.col("t.model_score_rank_join").alias("model_join")]
    placed = one.select(*keys, "run", "target", *joins, F.posexplode(cells).alias("pos", "c"))
    return placed.select(
        *keys, "run", "target", "pos", F.col("c.true_score"), F.col("c.model_score"),
        F.col("c.true_score_rank").alias("true_rank"), F.col("c.model_score_rank").alias("model_rank"), "true_join", "model_join",
    )


def explode_melt(wide: DataFrame, ids: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """List cells of several columns to rows ``(ids…, variable, value)``; a triple counts by its first element."""
    types = dict(wide.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            (F.transform(q(c), lambda x: x[0]) if types[c].startswith("array<array") else q(c)).alias("values"),
        )
        for c in lists
    ]
    melted = wide.select(*ids, F.inline(F.array(*cells)))
    return melted.select(*ids, "variable", F.explode("values").alias("value"))


def union_tagged(tables: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    out = None
    for name, df in tables.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def strip_prefix_cast(df: DataFrame, column: str, prefix: str = "run ") -> DataFrame:
    """A leading ``prefix`` goes, whatever signs it holds; the rest is a whole number."""
    value = q(column)
    rest = F.when(value.startswith(prefix), F.substr(value, F.lit(len(prefix) + 1))).otherwise(value)
    return df.withColumn(column, rest.cast("int"))


def group_mean_var_std(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample variance and its square root per group."""
    return df.groupBy(*map(q, by)).agg(
        F.avg(q(value)).alias("mean"), F.var_samp(q(value)).alias("variance"), F.stddev_samp(q(value)).alias("error")
    )


def relabel(df: DataFrame, column: str, labels: Mapping[str, str]) -> DataFrame:
    """Replace the values found in ``labels``; others stay."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return df.withColumn(column, F.coalesce(pairs[q(column)], q(column)))


def category_code(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """0-based code of the sorted distinct values, -1 for a missing one. The values of a report axis are few and numbered apart."""
    from .index import sorted_index

    levels = sorted_index(df.select(q(column)).where(q(column).isNotNull()).distinct(), [column]).withColumnRenamed("idx", out)
    return df.join(levels, column, "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))


def series_offset(df: DataFrame, series: str, code: str = "code", step: float = 0.03) -> DataFrame:
    """Adds ``x``: the code shifted by ``(-1)^i · step · i`` for the i-th series, so that points do not overlap."""
    coded = category_code(df, series, "_i")
    sign = F.when(F.col("_i") % 2 == 0, 1.0).otherwise(-1.0)
    return coded.withColumn("x", F.col(code) + sign * F.lit(step) * F.col("_i")).drop("_i")


def extract_cross(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys…, run, type, column, ratio, own, other)`` of both directions."""
    cell = "named_struct('type', '{}', 'column', t.key, 'ratio', t.value[0], 'own', t.value[1], 'other', t.value[2])"
    sides = [f"transform(map_entries(cross.{s}), t -> {cell.format(s)})" for s in ("real_synth", "synth_real")]
    return results.select(*keys, "run", F.inline(F.expr(f"concat({', '.join(sides)})")))


def group_mean_std_by(df: DataFrame, groupings: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Mean and sample std of several values for several groupings in one pass; absent keys are null."""
    keys = list(dict.fromkeys(chain.from_iterable(groupings)))
    aggs = [e for v in values for e in (F.avg(q(v)).alias(f"{v}_mean"), F.stddev_samp(q(v)).alias(f"{v}_std"))]
    sets = [[q(c) for c in g] for g in groupings]
    return df.groupingSets(sets, *map(q, keys)).agg(*aggs)


def conditional_round(x: Column, threshold: float = 1.0) -> Column:
    """Three digits below the threshold, whole numbers from it on; half to even."""
    return F.when(x < threshold, F.bround(x, 3)).otherwise(F.bround(x, 0))


def format_mean_std(*pairs: tuple[Column, Column]) -> Column:
    """``m (s)``, several joined by `` | ``."""
    texts = [F.concat(m.cast("string"), F.lit(" ("), s.cast("string"), F.lit(")")) for m, s in pairs]
    return F.concat_ws(" | ", *texts)


def variance_by_reps(df: DataFrame, by: Sequence[str] = ("n_reps", "run", "metric"), value: str = "value") -> DataFrame:
    return df.groupBy(*map(q, by)).agg(F.var_pop(q(value)).alias("variance"))


def pivot_first(df: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Long to wide with the first value per cell. The labels are given, so no extra pass finds them."""
    grouped = df.groupBy(*map(q, index)).pivot(columns, list(labels))
    if len(values) == 1:
        return grouped.agg(F.first(q(values[0]), ignorenulls=True))
    wide = grouped.agg(*[F.first(q(v), ignorenulls=True).alias(v) for v in values])
    swap = {f"{x}_{v}": f"{v}_{x}" for x in labels for v in values}
    return wide.withColumnsRenamed(swap)


def crosstab_mean(df: DataFrame, index: Sequence[str], columns: str, value: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*map(q, index)).pivot(columns, list(labels)).agg(F.avg(q(value)))


def cap_values(df: DataFrame, columns: Sequence[str], limit: float = 0.1) -> DataFrame:
    return df.withColumns({c: F.least(q(c), F.lit(limit)) for c in columns})


def column_type_tag(df: DataFrame, column: str, continuous: Sequence[str], out: str = "column_type") -> DataFrame:
    return df.withColumn(out, F.when(q(column).isin(*continuous), "Continuous").otherwise("Categorical"))


def cellwise_mean(df: DataFrame, by: Sequence[str] = ("dataset", "metric", "run"), value: str = "value") -> DataFrame:
    """Mean over the methods for each cell of the tables."""
    return df.groupBy(*map(q, by)).agg(F.avg(q(value)).alias(value))


def last_run(df: DataFrame, by: Sequence[str], labels: Sequence[str], run: str = "run", metric: str = "metric", value: str = "value") -> DataFrame:
    """The values at the largest run, metrics as columns."""
    last = df.groupBy(*map(q, by), q(metric)).agg(F.max_by(q(value), q(run)).alias(value))
    return last.groupBy(*map(q, by)).pivot(metric, list(labels)).agg(F.first(value))


def step_difference(df: DataFrame, series: Sequence[str] = ("metric",), run: str = "run", value: str = "value") -> DataFrame:
    """Absolute change to the next run, with the smallest and largest change per run marked."""
    ahead = F.lead(q(value)).over(Window.partitionBy(*map(q, series)).orderBy(q(run)))
    steps = df.select(*map(q, series), q(run), F.bround(F.abs(q(value) - ahead), 2).alias("step")).where("step is not null")
    of_run = Window.partitionBy(q(run))
    return steps.select(
        "*",
        (F.col("step") == F.min("step").over(of_run)).alias("is_min"),
        (F.col("step") == F.max("step").over(of_run)).alias("is_max"),
    )


def wide_metric_table(metrics: DataFrame, directions: DataFrame, index: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per index: a column per metric, the mean ratio of both directions and their quotient ``cc``."""
    wide = metrics.groupBy(*index).pivot("metric", list(labels)).agg(F.avg("value"))
    both = directions.groupBy(*index).pivot("train_side", ["a", "b"]).agg(F.first("mean_ratio"))
    named = both.select(*index, F.col("b").alias("real_synth"), F.col("a").alias("synth_real"))
    return wide.join(named, list(index)).withColumn("cc", F.try_divide("synth_real", "real_synth"))


def row_bucket_label(df: DataFrame, position: str, size: int, labels: Sequence[str], out: str = "label", by_remainder: bool = False) -> DataFrame:
    """Label by ``position div size`` or ``position % size``."""
    place = F.pmod(q(position), F.lit(size)) if by_remainder else F.floor(q(position) / size)
    return df.withColumn(out, F.get(F.array(*[F.lit(x) for x in labels]), place.cast("int")))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """One row per group with interpolated quantiles, exact at any group size.

    Equal values are counted first, the counts are range-partitioned by (group, value) and summed up per
    partition; only the rows that hold a wanted order statistic go on. No group is gathered in one task.
    """
    return _quantiles(_ranged_counts(df, by, value), by, probabilities)


def _ranged_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Written rows ``(by…, _v, _n, _part)``: counts of equal values, each part a range of (group, value)."""
    counts = df.where(q(value).isNotNull()).groupBy(*map(q, by), q(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(
        counts.repartitionByRange(*map(q, [*by, "_v"])).withColumn("_part", F.spark_partition_id()), "quantiles"
    )


def _quantiles(ranged: DataFrame, by: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    by, order = list(by), [*by, "_v"]
    sums = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sums):
        offsets.append((part, total))
        total += sums[part]
    start = ranged.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _o long")
    before = Window.partitionBy("_part").orderBy(*map(q, order)).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_c", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(start), "_part")
    placed = placed.select(*map(q, by), "_v", "_n", (F.col("_c") + F.col("_o")).alias("_c"))
    groups = placed.groupBy(*map(q, by)).agg(F.min("_c").alias("_start"), F.sum("_n").alias("_total"))
    ranks = placed.join(groups, by).withColumn("_r", F.col("_c") - F.col("_start"))
    holds = lambda at: (F.col("_r") <= at) & (at < F.col("_r") + F.col("_n"))
    exact = {name: (F.col("_total") - 1) * p for name, p in probabilities.items()}
    wanted = None
    for at in exact.values():
        hit = holds(F.floor(at)) | holds(F.ceil(at))
        wanted = hit if wanted is None else wanted | hit
    ends = ranks.where(wanted).groupBy(*map(q, by)).agg(
        *[
            F.max(F.when(holds(end(at)), F.col("_v"))).alias(f"_{side}_{name}")
            for name, at in exact.items()
            for side, end in (("low", F.floor), ("high", F.ceil))
        ],
        F.max("_total").alias("_total"),
    )
    share = {name: at - F.floor(at) for name, at in exact.items()}
    return ends.select(
        *map(q, by),
        *[
            (F.col(f"_low_{m}") + (F.col(f"_high_{m}") - F.col(f"_low_{m}")) * share[m]).alias(m)
            for m in probabilities
        ],
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of points outside, per group.

    The rows are read once; whiskers and outliers come from the counts of equal values behind the quartiles.
    """
    ranged = _ranged_counts(df, by, value)
    quartiles = _quantiles(ranged, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    span = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    inside = (v >= F.col("q1") - span) & (v <= F.col("q3") + span)
    return (
        ranged.join(quartiles, list(by))
        .groupBy(*map(q, by), "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("low"),
            F.max(F.when(inside, v)).alias("high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outside"),
        )
    )


def melt_filter_series(wide: DataFrame, ids: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide metric columns to rows ``(ids…, metric, value)`` of the kept metrics."""
    others = [c for c in wide.columns if c not in ids]
    melted = wide.unpivot([q(i) for i in ids], [q(c) for c in others], "metric", "value")
    return melted.where(F.col("metric").isin(*keep))
