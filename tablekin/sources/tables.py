"""Readers and writers for delimited, JSON and Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: Sequence[str], kind: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(c, kind or T.StringType()) for c in columns])


def read_headerless(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited file without a header; names and types come from the schema, a cell that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", False).option("sep", sep).csv(path)


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header and an unnamed leading row index, which is dropped."""
    full = T.StructType([T.StructField("_c0", T.StringType()), *schema.fields])
    read = spark.read.schema(full).option("mode", "FAILFAST").option("header", True).option("enforceSchema", True).option("sep", sep)
    return read.csv(path).drop("_c0")


def read_typed(spark: SparkSession, path: str, columns: Sequence[str], kind: T.DataType, indexed: bool = False) -> DataFrame:
    """CSV with a header, every column forced to one type; a cell that does not fit fails the read."""
    schema = text_schema(columns, kind)
    full = T.StructType([T.StructField("_c0", T.StringType()), *schema.fields]) if indexed else schema
    return spark.read.schema(full).option("header", True).option("mode", "FAILFAST").csv(path).drop("_c0")


TARGET_RESULT = T.StructType(
    [
        T.StructField("results", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("true_score", T.ArrayType(T.DoubleType())),
        T.StructField("model_score", T.ArrayType(T.DoubleType())),
        T.StructField("true_score_rank", T.ArrayType(T.IntegerType())),
        T.StructField("model_score_rank", T.ArrayType(T.IntegerType())),
        T.StructField("true_score_rank_join", T.StringType()),
        T.StructField("model_score_rank_join", T.StringType()),
    ]
)
_TRIPLES = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))
CROSS_RESULT = T.StructType(
    [
        T.StructField("real_synth", _TRIPLES),
        T.StructField("synth_real", _TRIPLES),
        T.StructField("aggregated", T.ArrayType(T.DoubleType())),
    ]
)
_TEXTS = T.MapType(T.StringType(), T.StringType())


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested result files ``<method>_<dataset>.json``, one document each, to a row per run:
    ``(method, dataset, run, targets, aggregated, cross, lists)``.

    Each run has one of two shapes. The present one holds targets beside ``aggregated`` and ``cross``; target names share
    that level, so it is read as raw text and split; ``lists`` is null. The older one holds the mean of each measure, read
    as ``aggregated``, and under ``debug`` the values behind them, read as ``lists``; ``targets`` and ``cross`` are null.
    Any other run fails the read.
    """
    name = r"([^/_=]+)_([^/]+?)\.json(?:/[^/]*)?$"  # a file of that name, or a folder with one file
    parsed = F.from_json("value", _TEXTS)
    torn = F.raise_error(F.concat(F.lit("no JSON document in "), F.input_file_name())).cast(_TEXTS)
    docs = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), name, 1).alias("method"),
        F.regexp_extract(F.input_file_name(), name, 2).alias("dataset"),
        F.when(parsed.isNotNull(), parsed).otherwise(torn).alias("runs"),
    )
    runs = docs.select("method", "dataset", F.explode("runs").alias("run", "text")).withColumn(
        "parts", F.from_json("text", _TEXTS)
    )
    has = lambda k: F.coalesce(F.map_contains_key("parts", k), F.lit(False))
    problem = F.raise_error(F.concat(F.lit("unknown shape of result in "), "method", F.lit("_"), "dataset", F.lit(", "), "run"))
    runs = runs.withColumn("older", F.when(has("debug"), True).when(has("aggregated"), False).otherwise(problem.cast("boolean")))
    is_target = lambda k, v: ~k.isin("aggregated", "cross")
    targets = F.transform_values(F.map_filter("parts", is_target), lambda k, v: F.from_json(v, TARGET_RESULT))
    means = F.transform_values(F.map_filter("parts", lambda k, v: k != "debug"), lambda k, v: v.cast("double"))
    part = lambda k, kind: F.from_json(F.col("parts")[k], kind)
    return runs.select(
        "method",
        "dataset",
        "run",
        F.when(~F.col("older"), targets).alias("targets"),
        F.when(F.col("older"), means).otherwise(part("aggregated", T.MapType(T.StringType(), T.DoubleType()))).alias("aggregated"),
        F.when(~F.col("older"), part("cross", CROSS_RESULT)).alias("cross"),
        part("debug", _TRIPLES).alias("lists"),
    )


def _entries(key: str, value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))


def nest_results(
    scores: DataFrame, cross: DataFrame, keys: Sequence[str] = ("method", "dataset"), vectors: DataFrame | None = None
) -> DataFrame:
    """Long score and cross rows to a row per run in the present shape of ``read_results_json``.

    ``scores`` holds ``(keys…, run, target, metric, value)``, ``cross`` ``(keys…, run, type, column, ratio, own, other)``.
    ``vectors``, as ``rank.ordinal_rank`` gives them, adds both score and rank vectors and the joined ranks of each target.
    A run holds one entry per target, so it is as large as the compared tables are wide.
    """
    run = [*keys, "run"]
    by_target = scores.groupBy(*run, "target").agg(_entries("metric", F.col("value")).alias("results"))
    parts = ["results"]
    if vectors is not None:
        cell = F.struct("pos", "score_a", "score_b", F.col("rank_a").cast("int").alias("rank_a"), F.col("rank_b").cast("int").alias("rank_b"))
        cells = vectors.groupBy(*run, "target").agg(F.array_sort(F.collect_list(cell)).alias("c"))
        text = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
        named = {
            "true_score": F.col("c.score_a"),
            "model_score": F.col("c.score_b"),
            "true_score_rank": F.col("c.rank_a"),
            "model_score_rank": F.col("c.rank_b"),
            "true_score_rank_join": text("c.rank_a"),
            "model_score_rank_join": text("c.rank_b"),
        }
        by_target = by_target.join(cells.select(*run, "target", *[c.alias(n) for n, c in named.items()]), [*run, "target"], "left")
        parts += named
    targets = by_target.groupBy(*run).agg(_entries("target", F.struct(*parts)).alias("targets"))
    means = scores.groupBy(*run, "metric").agg(F.avg("value").alias("value"))
    aggregated = means.groupBy(*run).agg(_entries("metric", F.col("value")).alias("aggregated"))
    triples = cross.select(*run, "type", "column", F.array("ratio", "own", "other").alias("t"))
    of = lambda name: F.map_from_entries(
        F.sort_array(F.collect_list(F.when(F.col("type") == name, F.struct("column", "t"))))
    ).alias(name)
    both = triples.groupBy(*run).agg(of("real_synth"), of("synth_real"))
    mean = lambda m, c: F.aggregate(F.col(m)[c], F.lit(0.0), lambda s, x: s + x)
    ratio = F.transform(F.map_keys("synth_real"), lambda c: mean("synth_real", c) / mean("real_synth", c))
    crossed = both.select(*run, F.struct("real_synth", "synth_real", ratio.alias("aggregated")).alias("cross"))
    return targets.join(aggregated, run).join(crossed, run)


def nest_score_lists(values: DataFrame, keys: Sequence[str] = ("method", "dataset")) -> DataFrame:
    """Rows ``(keys…, run, metric, pos, value)`` to a row per run in the older shape: ``aggregated`` means and ``lists``."""
    run = [*keys, "run"]
    lists = values.groupBy(*run, "metric").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c"), F.avg("value").alias("mean")
    )
    return lists.groupBy(*run).agg(
        _entries("metric", F.col("mean")).alias("aggregated"), _entries("metric", F.col("c.value")).alias("lists")
    )


def write_results_json(nested: DataFrame, path: str) -> None:
    """One JSON document per method and dataset, in a folder ``<method>_<dataset>.json``.

    Rows with ``lists`` are written in the older shape. A document is one file and a run one line of it: runs come sorted
    to the writer, which adds a line at a time, so no row and no buffer holds the runs of a document.
    """
    if "lists" in nested.columns:
        head = F.to_json("aggregated")
        text = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(', "debug": '), F.to_json("lists"), F.lit("}"))
    else:
        text = F.concat(
            F.lit('{"aggregated": '),
            F.to_json("aggregated"),
            F.lit(', "cross": '),
            F.to_json("cross"),
            F.lit(", "),
            F.substr(F.to_json("targets"), F.lit(2)),
        )
    key = F.to_json(F.array("run"))
    line = F.concat(F.substr(key, F.lit(2), F.length(key) - 2), F.lit(": "), text)
    runs = nested.select(F.format_string("%s_%s.json", "method", "dataset").alias("name"), "run", line.alias("line"))
    order = Window.partitionBy("name").orderBy("run")
    first, last = F.lag("run").over(order).isNull(), F.lead("run").over(order).isNull()
    lines = runs.select(
        "name", F.concat(F.when(first, "{").otherwise(""), "line", F.when(last, "}").otherwise(",")).alias("value")
    )
    lines.write.option("maxRecordsPerFile", 0).partitionBy("name").text(path)


def write_results(rows: DataFrame, path: str, by: Sequence[str] = ("dataset", "method"), mode: str = "errorifexists") -> None:
    """Long result rows as Parquet, one folder per dataset and method."""
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, index: str | None = None, mode: str = "errorifexists") -> None:
    """CSV folder; ``index`` names a column to write first under an empty header."""
    if index is not None:
        df = df.select(F.col(index).alias(" "), *[c for c in df.columns if c != index])
    df.write.mode(mode).option("header", header).csv(path)
