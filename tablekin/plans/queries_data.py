"""Queries of sources, cleaning, encoding, splitting, shuffling and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, encode, index, profile
from ..operators.clean import q
from ..roles import Roles, split_roles
from ..session import scratch_path
from ..sources import tables as src
from .bindings import (
    CATEGORICAL, CODED_SQL, CONTINUOUS, INDEXED_SQL, ITEMS, ITEMS_SQL, PAIR_SQL, SHAPES, SHAPES_SQL, SHUFFLED,
    coded_items, indexed_items, items, part_shapes, permuted_sql, rnd, rounded, shuffled, shuffled_sql, table,
)
from .registry import query

# ---------------------------------------------------------------- sources and sinks

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDERS_SQL = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders"


def _with_date_text(df):
    """The date as text, which both engines print alike."""
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*ORDER_COLUMNS)


@query("read_headerless", ORDERS_SQL)
def read_headerless(spark, sf):
    df, path = _orders(spark, sf), scratch_path(spark, "csv")
    src.write_csv(df, path, header=False)
    return _with_date_text(src.read_headerless(spark, path, df.schema))


@query("read_indexed_csv", ORDERS_SQL)
def read_indexed_csv(spark, sf):
    df, path = _orders(spark, sf), scratch_path(spark, "csv")
    src.write_csv(df.withColumn("row_no", F.monotonically_increasing_id()), path, index="row_no")
    return _with_date_text(src.read_indexed_csv(spark, path, df.schema))


@query("read_typed", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def read_typed(spark, sf):
    columns = ["p_partkey", "p_size", "p_retailprice"]
    path = scratch_path(spark, "csv")
    src.write_csv(table(spark, sf, "part").select(*columns), path)
    return src.read_typed(spark, path, columns, T.DoubleType())


@query(
    "write_results",
    """SELECT l_linestatus AS dataset, l_returnflag AS method, l_linenumber AS run, round(avg(l_discount), 6) AS value
       FROM lineitem GROUP BY ALL""",
)
def write_results(spark, sf):
    path = scratch_path(spark, "results")
    rows = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linestatus").alias("dataset"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("run"))
        .agg(rnd(F.avg("l_discount"), 6).alias("value"))
    )
    src.write_results(rows, path)
    schema = T.StructType([rows.schema["run"], rows.schema["value"], rows.schema["dataset"], rows.schema["method"]])
    return spark.read.schema(schema).parquet(path)


@query("write_csv", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def write_csv(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    path = scratch_path(spark, "csv")
    src.write_csv(df, path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query(
    "rename_columns",
    "SELECT s_suppkey AS supplier, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier",
)
def rename_columns(spark, sf):
    by_position = clean.rename_columns(table(spark, sf, "supplier"), ["V1", "name", "V3", "V4"])
    return clean.rename_columns(by_position, {"V1": "supplier", "V3": "nation", "V4": "balance"})


# ---------------------------------------------------------------- cleaning

RAW_SELECT = """
SELECT row_key, price, line,
       CASE WHEN tax = 0 THEN '?' ELSE CAST(CAST(quantity AS DECIMAL(18,2)) AS {s}) END AS quantity,
       CASE WHEN discount = 0 THEN '?' ELSE returnflag END AS flag,
       CASE WHEN line = '7' THEN linestatus ELSE '?' END AS rare
FROM {t}"""
RAW_SQL = f"{ITEMS_SQL},\nraw AS ({RAW_SELECT.format(s='VARCHAR', t='items')})"
NULLED_SQL = f"""{RAW_SQL},
nulled AS (SELECT row_key, price, nullif(line, '?') AS line, nullif(quantity, '?') AS quantity,
                  nullif(flag, '?') AS flag, nullif(rare, '?') AS rare FROM raw)"""
RAW_ROLES = ("quantity", "flag")


def raw(spark, sf):
    return spark.sql(RAW_SELECT.format(s="STRING", t="{t}"), t=items(spark, sf))


def nulled(spark, sf):
    return clean.sentinel_to_null(raw(spark, sf))


def _column_rows(columns, expression, name):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expression(c)} AS {name} FROM nulled" for c in columns)


@query("sentinel_to_null", f"WITH {NULLED_SQL} SELECT * FROM nulled")
def sentinel_to_null(spark, sf):
    return nulled(spark, sf)


_NULL_COLUMNS = ("price", "line", "quantity", "flag", "rare")


@query(
    "null_ratio",
    f"WITH {NULLED_SQL} " + _column_rows(_NULL_COLUMNS, lambda c: f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9)", "null_ratio"),
)
def null_ratio(spark, sf):
    return clean.null_ratio(nulled(spark, sf), _NULL_COLUMNS).select("column", rnd("null_ratio", 9).alias("null_ratio"))


@query("drop_high_null", f"WITH {NULLED_SQL} SELECT row_key, price, line, quantity, flag FROM nulled")
def drop_high_null(spark, sf):
    return clean.drop_high_null(nulled(spark, sf))


@query(
    "align_columns",
    """SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""",
)
def align_columns(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), "s_name", F.col("s_nationkey").alias("nation")
    )
    a, b = clean.align_columns(a, b)
    return a.select(F.lit("customer").alias("side"), "*").unionByName(b.select(F.lit("supplier").alias("side"), "*"))


@query(
    "split_roles",
    f"WITH {NULLED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{r}' AS role, count({c}) AS n FROM nulled"
        for c, r in (("price", "continuous"), ("line", "categorical"), ("quantity", "continuous"), ("flag", "categorical"))
    ),
)
def split_roles_query(spark, sf):
    df = clean.drop_high_null(nulled(spark, sf))
    roles = split_roles(df.columns, ["price", "quantity", "rare"], drop=["row_key"])
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit("categorical" if roles.is_categorical(c) else "continuous").alias("role"),
                F.count(q(c)).alias("n"),
            ).alias(c)
            for c in roles.columns
        ]
    )
    return wide.select(F.inline(F.array(*map(q, roles.columns))))


@query(
    "impute_mean",
    f"""WITH {NULLED_SQL}
SELECT row_key, round(coalesce(CAST(quantity AS DOUBLE), (SELECT avg(CAST(quantity AS DOUBLE)) FROM nulled)), 6) AS quantity, price
FROM nulled""",
)
def impute_mean(spark, sf):
    df = clean.coerce_numeric(nulled(spark, sf).select("row_key", "quantity", "price"), ["quantity"])
    return clean.impute_mean(df, ["quantity", "price"]).withColumn("quantity", rnd("quantity", 6))


@query(
    "impute_most_frequent",
    f"""WITH {NULLED_SQL}
SELECT row_key, line, coalesce(flag, (SELECT flag FROM nulled WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag
FROM nulled""",
)
def impute_most_frequent(spark, sf):
    return clean.impute_most_frequent(nulled(spark, sf).select("row_key", "line", "flag"), ["line", "flag"])


@query(
    "cast_roles",
    f"WITH {NULLED_SQL} SELECT CAST(quantity AS DOUBLE) AS quantity, price, CAST(CAST(line AS DOUBLE) AS VARCHAR) AS line FROM nulled",
)
def cast_roles(spark, sf):
    return clean.cast_roles(nulled(spark, sf), Roles(("quantity", "price", "line"), ("quantity", "price")))


@query("drop_columns", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "customer"), "c_custkey", "c_name")


@query(
    "factorize",
    """SELECT 'p_brand' AS "column", p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code, count(*) AS n FROM part GROUP BY p_brand
UNION ALL SELECT 'p_type', p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER), count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), CAST(row_number() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS INTEGER), count(*) FROM part GROUP BY p_size""",
)
def factorize(spark, sf):
    return encode.factorize(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "coerce_numeric",
    f"WITH {RAW_SQL} SELECT row_key, TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(flag AS DOUBLE) AS flag FROM raw",
)
def coerce_numeric(spark, sf):
    return clean.coerce_numeric(raw(spark, sf).select("row_key", "quantity", "flag"), ["quantity", "flag"])


@query(
    "filter_rows",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderpriority <> '5-LOW'""",
)
def filter_rows(spark, sf):
    among = {"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]}
    kept = clean.filter_rows(_orders(spark, sf), {"o_orderstatus": "F"}, {"o_orderpriority": "5-LOW"}, among)
    return clean.select_columns(kept, "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark, sf):
    return clean.select_columns(table(spark, sf, "orders"), "o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- encoding, splits, shuffles


@query(
    "ordinal_encode_fit_a_apply_b",
    f"WITH {CODED_SQL},\n{shuffled_sql('coded', 'mixed', CATEGORICAL, ['returnflag'])}\n"
    f"SELECT 'a' AS side, idx, {', '.join(CATEGORICAL)} FROM coded UNION ALL SELECT 'b', idx, {', '.join(CATEGORICAL)} FROM mixed",
)
def ordinal_encode(spark, sf):
    a = indexed_items(spark, sf)
    a = index.Indexed(a.df.select("idx", *CATEGORICAL), a.n)
    b = shuffled(a, ["returnflag"])
    dictionary = encode.fit_dictionary(a.df, CATEGORICAL)
    sides = [
        encode.apply_dictionary(t.df, dictionary, CATEGORICAL).select(F.lit(s).alias("side"), "*")
        for s, t in (("a", a), ("b", b))
    ]
    return sides[0].unionByName(sides[1])


@query(
    "unseen_categories",
    """SELECT 'rate' AS "column", rate AS value, count(*) AS n FROM (SELECT CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS rate FROM lineitem)
WHERE rate NOT IN (SELECT CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) FROM lineitem) GROUP BY rate""",
)
def unseen_categories(spark, sf):
    rate = lambda c: table(spark, sf, "lineitem").select(F.col(c).cast("decimal(18,2)").cast("string").alias("rate"))
    return encode.unseen_categories(rate("l_discount"), encode.fit_dictionary(rate("l_tax"), ["rate"]), ["rate"])


@query(
    "holdout_split",
    f"""WITH {INDEXED_SQL} SELECT row_key, idx, {permuted_sql('idx', 42)} < ceil(n * 0.2) AS is_test FROM indexed""",
)
def holdout_split(spark, sf):
    return index.holdout_split(indexed_items(spark, sf)).select("row_key", "idx", "is_test")


@query(
    "replicates",
    f"WITH {INDEXED_SQL} "
    + " UNION ALL ".join(
        f"SELECT {r} AS rep, idx, {permuted_sql('idx', r)} < ceil(n * 0.05) AS is_test FROM indexed" for r in range(5)
    ),
)
def replicates(spark, sf):
    base = indexed_items(spark, sf)
    return index.replicates(index.Indexed(base.df.select("idx"), base.n), 5).select("rep", "idx", "is_test")


def _sample_rows():
    import random

    out = []
    for rep in range(3):
        for run in range(1, 5):
            random.seed(rep)
            out += [(run, rep, i) for i in random.sample(range(len(ITEMS.columns)), run)]
    return out


@query(
    "sample_columns",
    f"WITH {CODED_SQL}, means AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS \"column\", round(avg({c}), 6) AS mean FROM coded" for i, c in enumerate(ITEMS.columns))
    + "), chosen AS (SELECT * FROM (VALUES "
    + ", ".join(f"({a}, {b}, {i})" for a, b, i in _sample_rows())
    + ') v(run, rep, i)) SELECT run, rep, "column", mean FROM chosen JOIN means USING (i)',
)
def sample_columns(spark, sf):
    cells = [
        F.struct(F.lit(run).alias("run"), F.lit(rep).alias("rep"), F.lit(c).alias("column"))
        for rep in range(3)
        for run in range(1, 5)
        for c in index.sample_columns(ITEMS.columns, run, rep)
    ]
    means = coded_items(spark, sf).df.agg(*[rnd(F.avg(q(c)), 6).alias(c) for c in ITEMS.columns])
    long = means.unpivot([], list(ITEMS.columns), "column", "mean")
    return long.select("*", F.array(*cells).alias("c")).select(
        F.col("column").alias("_c"), "mean", F.inline("c")
    ).where(F.col("_c") == F.col("column")).select("run", "rep", "column", "mean")


_SHUFFLE_OUT = ("quantity", "price", "discount", "linestatus", "returnflag")


@query(
    "joint_column_shuffle",
    f"WITH {INDEXED_SQL},\n{shuffled_sql('indexed', 'mixed', _SHUFFLE_OUT, SHUFFLED)} SELECT idx, {', '.join(_SHUFFLE_OUT)} FROM mixed",
)
def joint_column_shuffle(spark, sf):
    return index.shuffle_columns(indexed_items(spark, sf), SHUFFLED).df.select("idx", *_SHUFFLE_OUT)


@query(
    "single_column_shuffle",
    f"WITH {INDEXED_SQL},\n{shuffled_sql('indexed', 'mixed', _SHUFFLE_OUT, ['quantity'], 5)} SELECT idx, {', '.join(_SHUFFLE_OUT)} FROM mixed",
)
def single_column_shuffle(spark, sf):
    base = indexed_items(spark, sf)
    return index.shuffle_columns(base, ["quantity"], 5).df.select("idx", *_SHUFFLE_OUT)


def _sweep_sql(runs: int, reps: int, source: str, columns) -> str:
    parts = [f"SELECT 0 AS run, {r} AS rep, idx, n, {', '.join(columns)} FROM {source}" for r in range(reps)]
    for k in range(1, runs + 1):
        for r in range(reps):
            moved = index.sample_columns(columns, k, r)
            picked = ", ".join(f"{'d' if c in moved else 'a'}.{c}" for c in columns)
            parts.append(
                f"SELECT {k}, {r}, a.idx, a.n, {picked} FROM {source} a JOIN {source} d ON d.idx = "
                + permuted_sql("a.idx", index.sweep_seed(k, r), "a.n")
            )
    return " UNION ALL ".join(parts)


@query(
    "column_shuffle_sweep",
    f"WITH {SHAPES_SQL}, sweep AS ({_sweep_sql(6, 20, 'indexed', SHAPES.columns)}) SELECT run, rep, idx, {', '.join(SHAPES.columns)} FROM sweep",
)
def column_shuffle_sweep(spark, sf):
    return index.column_shuffle_sweep(part_shapes(spark, sf), SHAPES.columns, len(SHAPES.columns), 20)


# ---------------------------------------------------------------- profiles


@query(
    "profile_continuous",
    f"WITH {RAW_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round_even(avg(x), 1) AS mean, round_even(stddev_samp(x), 1) AS std,"
        f" round_even(100 * avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 1) AS null_pct"
        f" FROM (SELECT TRY_CAST({c} AS DOUBLE) AS x FROM raw)"
        for c in ("quantity", "price")
    ),
)
def profile_continuous(spark, sf):
    return profile.profile_continuous(raw(spark, sf), ["quantity", "price"])


def _categorical_sql(c):
    return (
        f"SELECT '{c}' AS \"column\", (SELECT {c} FROM nulled WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,"
        f" count(DISTINCT {c}) AS n_distinct, round_even(100 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 1) AS null_pct FROM nulled"
    )


@query("profile_categorical", f"WITH {NULLED_SQL} " + " UNION ALL ".join(map(_categorical_sql, ("line", "flag", "rare"))))
def profile_categorical(spark, sf):
    return profile.profile_categorical(nulled(spark, sf), ["line", "flag", "rare"])


_STATISTIC = "printf('%.1f (%.1f)', round_even(avg({c}), 1), round_even(stddev_samp({c}), 1))"


@query(
    "profile_table",
    f"""WITH {NULLED_SQL}
SELECT 'items' AS dataset, 'price' AS "column", {_STATISTIC.format(c='price')} AS statistic, 0.0 AS null_pct FROM items
UNION ALL SELECT 'items', "column", mode || ' [' || n_distinct || ']', null_pct FROM ({_categorical_sql('line')} UNION ALL {_categorical_sql('flag')})
UNION ALL SELECT 'customer', 'c_acctbal', {_STATISTIC.format(c='c_acctbal')}, 0.0 FROM customer
UNION ALL SELECT 'customer', 'c_mktsegment', (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)
   || ' [' || count(DISTINCT c_mktsegment) || ']', 0.0 FROM customer""",
)
def profile_table(spark, sf):
    customer = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")
    return profile.profile_table(
        [
            ("items", nulled(spark, sf), Roles(("price", "line", "flag"), ("price",))),
            ("customer", customer, Roles(("c_acctbal", "c_mktsegment"), ("c_acctbal",))),
        ]
    )


@query(
    "class_share_by_source",
    """SELECT c.lang, c.source, c.n, t.total, round(c.n * 100.0 / t.total, 6) AS pct
FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) c
JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) t USING (source)""",
)
def class_share_by_source(spark, sf):
    out = profile.class_share_by_source(table(spark, sf, "documents"), "lang", "source")
    return out.withColumn("pct", rnd("pct", 6)).select("lang", "source", "n", "total", "pct")


@query(
    "crosstab_counts",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
)
def crosstab_counts(spark, sf):
    return profile.crosstab_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


_COMPARE = ("price", "unit_price", "returnflag", "line")


def _level_sql(c):
    if ITEMS.is_categorical(c):
        return f"CAST({c} AS VARCHAR)"
    low, width = f"(SELECT min({c}) FROM one)", f"((SELECT max({c}) - min({c}) FROM one) / 10)"
    high = f"(SELECT max({c}) FROM one)"
    return (
        f"CAST(CASE WHEN {c} < {low} THEN 0 WHEN {c} > {high} THEN 11"
        f" ELSE least(CAST(floor(({c} - {low}) / {width}) AS INTEGER) + 1, 10) END AS VARCHAR)"
    )


@query(
    "compare_univariate",
    f"""WITH {INDEXED_SQL}, one AS (SELECT * FROM items WHERE linestatus = 'F'),
both_ AS (SELECT CASE WHEN linestatus = 'F' THEN 'a' ELSE 'b' END AS side, * FROM items),
levels AS ({' UNION ALL '.join(f"SELECT side, '{c}' AS col, {_level_sql(c)} AS level FROM both_" for c in _COMPARE)}),
counts AS (SELECT col, level, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b FROM levels GROUP BY col, level)
SELECT col AS "column", level, n_a, n_b, round(n_a / sum(n_a) OVER (PARTITION BY col), 9) AS share_a,
       round(n_b / sum(n_b) OVER (PARTITION BY col), 9) AS share_b FROM counts""",
)
def compare_univariate(spark, sf):
    df = items(spark, sf).select("linestatus", *_COMPARE)
    roles = Roles(_COMPARE, ("price", "unit_price"))
    out = profile.compare_univariate(df.where("linestatus = 'F'"), df.where("linestatus = 'O'"), roles)
    return out.withColumns({"share_a": rnd("share_a", 9), "share_b": rnd("share_b", 9)})
