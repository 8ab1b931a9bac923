"""The test tables as inputs of the operators, and the same inputs as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Indexed, multiplier, offset, row_index, shuffle_columns
from ..operators.encode import apply_dictionary, fit_dictionary
from ..operators.clean import q
from ..operators.linear import column_means, product_sums, unpack
from ..operators.rank import METRICS
from ..roles import Roles
from ..session import materialize, spread

import pandas as pd


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- items: lineitem with derived money columns

CONTINUOUS = ("quantity", "price", "discount", "tax", "net", "unit_price")
CATEGORICAL = ("line", "linestatus", "returnflag")
ITEMS = Roles((*CONTINUOUS, "line", "linestatus", "returnflag"), CONTINUOUS)
NUMBERS = Roles(CONTINUOUS, CONTINUOUS)
SHUFFLED = ("price", "discount", "returnflag")

ITEM_SELECT = """
SELECT concat_ws('|', CAST(l_orderkey AS {s}), CAST(l_partkey AS {s}), CAST(l_suppkey AS {s}), CAST(l_linenumber AS {s}),
         CAST(CAST(l_quantity AS BIGINT) AS {s}), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS {s})) AS row_key,
       l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax,
       l_extendedprice * (1 - l_discount) / 1000 AS net, l_extendedprice / l_quantity / 1000 AS unit_price,
       CAST(l_linenumber AS {s}) AS line, l_linestatus AS linestatus, l_returnflag AS returnflag
FROM {t}"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return spark.sql(ITEM_SELECT.format(s="STRING", t="{t}"), t=spread(table(spark, sf, "lineitem").select(*used)))


def indexed_items(spark: SparkSession, sf: str) -> Indexed:
    return row_index(items(spark, sf), ["row_key"])


def coded(df: DataFrame, key, roles: Roles, keep: bool = True) -> Indexed:
    """``idx`` and the numeric columns of a table, categories as codes.

    The derived columns are written once; each of the three passes then reads only the columns it needs. Without ``keep`` they
    are derived anew in each pass, for columns that cost less than to write them.
    """
    df = materialize(df, "source") if keep else df
    dictionary = fit_dictionary(df, roles.categorical)
    base = row_index(df, key, keep=False)
    out = apply_dictionary(base.df.select("idx", *roles.columns), dictionary, roles.categorical)
    return Indexed(materialize(out, "coded"), base.n)


def coded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The coded items without row numbers, for models that neither split nor shuffle."""
    rows = items(spark, sf).select(*ITEMS.columns)
    return apply_dictionary(rows, fit_dictionary(rows, ITEMS.categorical), ITEMS.categorical)


def coded_items(spark: SparkSession, sf: str) -> Indexed:
    return coded(items(spark, sf), ["row_key"], ITEMS, keep=False)


def coded_pair(spark: SparkSession, sf: str) -> tuple[Indexed, Indexed]:
    a = coded_items(spark, sf)
    return a, shuffled(a, SHUFFLED)


def shuffled(a: Indexed, columns) -> Indexed:
    b = shuffle_columns(a, list(columns), 1)
    return Indexed(materialize(b.df, "shuffled"), b.n)


def number_items(spark: SparkSession, sf: str) -> Indexed:
    return row_index(items(spark, sf).select("row_key", *CONTINUOUS), ["row_key"])


_ITEM_SQL = ITEM_SELECT.format(s="VARCHAR", t="lineitem")
ITEMS_SQL = f"items AS ({_ITEM_SQL})"
INDEXED_SQL = f"""{ITEMS_SQL},
indexed AS (SELECT *, row_number() OVER (ORDER BY md5(row_key || ':0'), row_key) - 1 AS idx,
                   CAST(count(*) OVER () AS BIGINT) AS n FROM items)"""
CODED_SQL = f"""{INDEXED_SQL},
coded AS (SELECT idx, n, {', '.join(CONTINUOUS)},
          {', '.join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in CATEGORICAL)} FROM indexed)"""


def permuted_sql(idx: str, seed: int, n: str = "n") -> str:
    return f"(({idx} * {multiplier(seed)} + {offset(seed)}) % {n})"


def shuffled_sql(source: str, name: str, columns, moved, seed: int = 1) -> str:
    """CTE ``name``: ``source`` with the ``moved`` columns taken from the permuted row."""
    picked = ", ".join(f"{'d' if c in moved else 'a'}.{c}" for c in columns)
    return (
        f"{name} AS (SELECT a.idx, a.n, {picked} FROM {source} a JOIN {source} d"
        f" ON d.idx = {permuted_sql('a.idx', seed, 'a.n')})"
    )


PAIR_SQL = f"{CODED_SQL},\n{shuffled_sql('coded', 'mixed', ITEMS.columns, SHUFFLED)}"


# ---------------------------------------------------------------- importance rows that SQL can compute too


def correlation_scores(df: DataFrame, columns, by) -> DataFrame:
    """Rows ``(by…, target, feature, pos, score)`` with the absolute correlation as score, nine digits."""
    columns, by = list(columns), list(by)
    shift = column_means(df, columns)
    sums = product_sums(df, columns, by, shift)

    def rows(batches):
        for pdf in batches:
            out = []
            for g in pdf.to_dict("records"):
                _, cov = unpack(g["n"], g["s"], g["p"], shift)
                for t, target in enumerate(columns):
                    for j, feature in enumerate(columns):
                        if j != t:
                            r = cov[t, j] / (cov[t, t] * cov[j, j]) ** 0.5
                            out.append((*[g[k] for k in by], target, feature, j, round(abs(r), 9)))
            yield pd.DataFrame(out, columns=[*by, "target", "feature", "pos", "score"])

    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
    return sums.mapInPandas(rows, f"{keys}, target string, feature string, pos int, score double")


def keyed_scores(spark: SparkSession, sf: str, keys) -> tuple[DataFrame, DataFrame]:
    """Importance rows of both line states, per line number (``run``) and return flag (``method``) as asked."""
    df = items(spark, sf).select(
        F.col("line").cast("int").alias("run"), F.col("returnflag").alias("method"), "linestatus", *CONTINUOUS
    )
    scores = materialize(correlation_scores(df, CONTINUOUS, [*keys, "linestatus"]), "scores")
    side = lambda s: scores.where(F.col("linestatus") == s).drop("linestatus")
    return side("F"), side("O")


def run_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return keyed_scores(spark, sf, ["run"])


def measures_sql(keys, pairs: str = "pairs") -> str:
    """CTEs from ``pairs`` to ``measured`` (a column per measure) and ``long_scores``. Needs WITH RECURSIVE."""
    k = "".join(f"{c}, " for c in keys)
    x = "".join(f"x.{c}, " for c in keys)
    kk = "".join(f"k.{c}, " for c in keys)
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in (*keys, "target"))
    text = lambda r: f"string_agg(chr(CAST(32 + {r} AS INTEGER)), '' ORDER BY pos)"
    far = "CASE WHEN i >= 1 AND x[1] >= 2 AND la[i + 1] = lb[x[1] - 1] AND la[i] = lb[x[1]] THEN p2[x[1] - 1] + 1 ELSE 1000000 END"
    long = " UNION ALL ".join(f"SELECT {k}target, '{name}' AS metric, {m} AS value FROM measured" for m, name in METRICS.items())
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {k}target ORDER BY score_a DESC, pos) AS rank_a,
                     row_number() OVER (PARTITION BY {k}target ORDER BY score_b DESC, pos) AS rank_b,
                     row_number() OVER (PARTITION BY {k}target ORDER BY pos) AS place,
                     count(*) OVER (PARTITION BY {k}target) AS n FROM {pairs}),
per_target AS (SELECT {k}target, any_value(n) AS n,
    sum(rank_a / log2(n - rank_b + 2)) / sum(rank_b / log2(n - rank_b + 2)) AS ndcg,
    (avg(CAST(rank_a = rank_b AS INTEGER)) - 1.0 / any_value(n)) / (1 - 1.0 / any_value(n)) AS cohen_kappa,
    CASE WHEN min(score_a) = max(score_a) THEN CASE WHEN sum(power(score_a - score_b, 2)) = 0 THEN 1.0 ELSE 0.0 END
         ELSE 1 - sum(power(score_a - score_b, 2)) / (var_pop(score_a) * count(*)) END AS r2,
    1 - levenshtein({text('rank_a')}, {text('rank_b')}) / CAST(any_value(n) AS DOUBLE) AS levenshtein,
    jaro_winkler_similarity({text('rank_a')}, {text('rank_b')}) AS jaro_winkler,
    avg(CAST(rank_a = rank_b AS INTEGER)) AS hamming,
    string_agg(CAST(rank_a AS VARCHAR), '' ORDER BY pos) AS rank_join_a,
    string_agg(CAST(rank_b AS VARCHAR), '' ORDER BY pos) AS rank_join_b,
    list(CAST(rank_a AS BIGINT) ORDER BY pos) AS la, list(CAST(rank_b AS BIGINT) ORDER BY pos) AS lb
    FROM ranked GROUP BY {k}target),
taus AS (SELECT {x}x.target, sum(sg) / count(*) AS kendall_tau,
           (sum(sg * (1.0 / (n - xa + 1) + 1.0 / (n - ya + 1))) + sum(sg * (1.0 / (n - xb + 1) + 1.0 / (n - yb + 1))))
           / (2 * sum(1.0 / (n - xa + 1) + 1.0 / (n - ya + 1))) AS weighted_tau
         FROM (SELECT {x}x.target, x.n, x.rank_a AS xa, y.rank_a AS ya, x.rank_b AS xb, y.rank_b AS yb,
                      sign((x.rank_a - y.rank_a) * (x.rank_b - y.rank_b)) AS sg
               FROM ranked x JOIN ranked y ON {same('x', 'y')} AND x.pos < y.pos) x
         GROUP BY {x}x.target),
depths AS (SELECT {x}x.target, x.n, greatest(x.place, y.place) AS depth
           FROM ranked x JOIN ranked y ON {same('x', 'y')} AND x.rank_a = y.rank_b),
overlap AS (SELECT {k}target, sum(shared / CAST(d AS DOUBLE)) / any_value(n) AS rbo FROM (
              SELECT {kk}k.target, any_value(k.n) AS n, k.place AS d, count(e.depth) AS shared
              FROM ranked k LEFT JOIN depths e ON {same('e', 'k')} AND e.depth <= k.place
              GROUP BY {kk}k.target, k.place) GROUP BY {k}target),
osa AS (SELECT {k}target, n, la, lb, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS p2, range(0, n + 1) AS p1 FROM per_target
  UNION ALL
  SELECT {k}target, n, la, lb, i + 1, p1, list_reduce(list_transform(range(1, n + 1), lambda j: [j]),
     lambda acc, x: list_append(acc, least(acc[x[1]] + 1, p1[x[1] + 1] + 1,
        p1[x[1]] + CASE WHEN la[i + 1] = lb[x[1]] THEN 0 ELSE 1 END, {far})), [i + 1])
  FROM osa WHERE i < n),
aligned AS (SELECT {k}target, 1 - p1[n + 1] / CAST(n AS DOUBLE) AS damerau FROM osa WHERE i = n),
measured AS (SELECT * EXCLUDE (la, lb) FROM per_target JOIN taus USING ({k}target) JOIN overlap USING ({k}target)
             JOIN aligned USING ({k}target)),
long_scores AS ({long})"""


def keyed_scores_sql(keys) -> str:
    """CTE ``pairs`` of the importance rows that ``keyed_scores`` gives."""
    k = "".join(f"{c}, " for c in keys)
    cells = [
        f"SELECT {k}linestatus, '{t}' AS target, '{f}' AS feature, {j} AS pos, round(abs(corr({t}, {f})), 9) AS score"
        f" FROM lined GROUP BY {k}linestatus"
        for t in CONTINUOUS
        for j, f in enumerate(CONTINUOUS)
        if f != t
    ]
    return f"""{ITEMS_SQL},
lined AS (SELECT CAST(line AS INTEGER) AS run, returnflag AS method, * FROM items),
scores AS ({' UNION ALL '.join(cells)}),
pairs AS (SELECT {''.join(f'a.{c}, ' for c in keys)}a.target, a.feature, a.pos, a.score AS score_a, b.score AS score_b
          FROM scores a JOIN scores b USING ({k}target, feature) WHERE a.linestatus = 'F' AND b.linestatus = 'O')"""


RUN_SCORES_SQL = f"{keyed_scores_sql(['run'])},\n{measures_sql(['run'])}"


# ---------------------------------------------------------------- SQL for models


def inverse_sql(source: str, columns, by=(), name: str = "inv") -> str:
    """CTEs ``name``: per group the inverse ``m`` of the correlation matrix, with means ``mu`` and deviations ``sd``."""
    keys = "".join(f"{c}, " for c in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    size = len(columns)
    matrix = "[" + ", ".join("[" + ", ".join("1.0" if a == b else f"corr({a}, {b})" for b in columns) + "]" for a in columns) + "]"
    return f"""{name}_0 AS (SELECT {keys}1 AS k, {matrix} AS m, [{', '.join(f'avg({c})' for c in columns)}] AS mu,
       [{', '.join(f'stddev_pop({c})' for c in columns)}] AS sd, count(*) AS cnt FROM {source}{group}),
{name}_r AS (SELECT * FROM {name}_0 UNION ALL
  SELECT {keys}k + 1, list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j:
    CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k]
         ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)), mu, sd, cnt FROM {name}_r WHERE k <= {size}),
{name} AS (SELECT {keys}m, mu, sd, cnt FROM {name}_r WHERE k = {size + 1})"""


def linear_importance_sql(inverse: str, columns, targets, by=()) -> str:
    """Expected permutation importance of all targets from the inverse correlation matrix."""
    keys = "".join(f"{c}, " for c in by)
    rows = [
        f"SELECT {keys}'{t}' AS target, '{f}' AS feature, {j} AS pos, 2 * power(m[{i + 1}][{j + 1}] / m[{i + 1}][{i + 1}], 2) AS score FROM {inverse}"
        for i, t in enumerate(columns)
        if t in targets
        for j, f in enumerate(columns)
        if j != i
    ]
    return " UNION ALL ".join(rows)


def residual_sql(i: int, columns, alias: str = "i", row: str = "r") -> str:
    """Error of the regression of column ``i`` for one row."""
    z = ", ".join(f"({row}.{c} - {alias}.mu[{j + 1}]) / {alias}.sd[{j + 1}]" for j, c in enumerate(columns))
    return f"({alias}.sd[{i + 1}] / {alias}.m[{i + 1}][{i + 1}] * list_dot_product({alias}.m[{i + 1}], [{z}]))"


def nb_sql(name: str, train: str, rows: str, target: str, features, permuted_rows: bool = False) -> str:
    """CTE ``name``: Gaussian naive Bayes of ``target`` fitted on ``train``, predictions for ``rows``.

    ``rows`` needs a unique ``rid``. With ``permuted_rows``, every row appears once per feature (``variant``),
    that feature taken from ``_p_<feature>``, and once unchanged (variant -1).
    """
    stats = ", ".join(f"avg({f}) AS m{i}, var_pop({f}) AS v{i}" for i, f in enumerate(features))
    eps = "greatest(" + ", ".join(f"var_pop({f})" for f in features) + ")"
    x = lambda i, f: f"(CASE WHEN variant = {i} THEN r._p_{f} ELSE r.{f} END)" if permuted_rows else f"r.{f}"
    score = "ln(s.cn / CAST(e.total AS DOUBLE))" + "".join(
        f" - 0.5 * ln(2 * pi() * (s.v{i} + e.eps)) - power({x(i, f)} - s.m{i}, 2) / (2 * (s.v{i} + e.eps))"
        for i, f in enumerate(features)
    )
    source = f"(SELECT *, unnest(range(-1, {len(features)})) AS variant FROM {rows})" if permuted_rows else f"(SELECT *, -1 AS variant FROM {rows})"
    return f"""{name}_s AS (SELECT {target} AS code, count(*) AS cn, {stats} FROM {train} GROUP BY {target}),
{name}_e AS (SELECT count(*) AS total, 1e-9 * {eps} AS eps FROM {train}),
{name} AS (SELECT rid, variant, any_value(y) AS y, min_by(code, [-ll, code]) AS prediction FROM (
   SELECT r.rid, r.variant, r.{target} AS y, s.code, {score} AS ll FROM {source} r, {name}_s s, {name}_e e) GROUP BY rid, variant)"""


def rounded(expression: str, digits: int, name: str) -> str:
    return f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END AS {name}"


def rnd(column, digits: int):
    """Rounded value without a negative zero."""
    value = F.round(q(column) if isinstance(column, str) else column, digits)
    return F.when(value == 0, 0.0).otherwise(value)


def settled_sql(expression: str, digits: int, name: str) -> str:
    """Rounded in two steps of plain arithmetic: noise goes before the digits are cut, and all engines cut alike."""
    fine = f"floor(({expression}) * 1e10 + 0.5) / 1e10"
    return f"floor({fine} * 1e{digits} + 0.5) / 1e{digits} + 0.0 AS {name}"


def settled(column, digits: int):
    """The same as ``settled_sql``."""
    cut = lambda c, d: F.floor(c * F.lit(10.0**d) + 0.5) / F.lit(10.0**d)
    return cut(cut(q(column) if isinstance(column, str) else column, 10), digits) + F.lit(0.0)


# ---------------------------------------------------------------- smaller tables for the fitted models

DOCS = Roles(("n_chars", "n_words", "n_lines", "lang", "quality", "toxic"), ("n_chars", "n_words", "n_lines"))
DOC_SELECT = """
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS n_words,
       CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS n_lines,
       coalesce(d.lang, 'none') AS lang, coalesce(CAST(l.quality AS {s}), 'none') AS quality, coalesce(CAST(l.toxic AS {s}), 'none') AS toxic
FROM {d} d LEFT JOIN {l} l ON d.doc_id = l.doc_id"""


def coded_docs(spark: SparkSession, sf: str) -> Indexed:
    """All documents as numbers: lengths of the whole text, language and both labels; a missing label is a level of its own."""
    sql = DOC_SELECT.format(s="STRING", d="{d}", l="{l}")
    docs = spark.sql(sql, d=table(spark, sf, "documents"), l=table(spark, sf, "labels"))
    return coded(docs, ["doc_id"], DOCS)


#: The same codes: levels in the order of their texts.
DOCS_SQL = f"""docs AS (SELECT doc_id, n_chars, n_words, n_lines, {', '.join(
    f'CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}' for c in ('lang', 'quality', 'toxic'))}
  FROM ({DOC_SELECT.format(s="VARCHAR", d="documents", l="labels")}))"""


def newton_sql(source: str, columns, targets, name: str = "newton", rounds: int = 20) -> str:
    """CTEs ending in ``name``: ``(t, c, w)``, the logistic coefficients of class ``c`` of target ``t`` against the rest.

    Plain Newton steps from zero, each solved by elimination of the curvature, one nested SELECT per column.
    The intercept is the last coefficient and penalised like the others; targets need three classes or more.
    """
    size = len(columns)
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS t, k.c, CAST(r.{t} = k.c AS INT) AS y, [{', '.join(f'r.{c}' for c in columns if c != t)}, 1.0] AS x"
        f" FROM {source} r, (SELECT DISTINCT {t} AS c FROM {source}) k"
        for t in targets
    )
    every = range(1, size + 1)
    entries = [f"sum(p * (1 - p) * x[{i}] * x[{j}]) + {int(i == j)} AS a{i}_{j}" for i in every for j in every]
    entries += [f"sum((y - p) * x[{i}]) - any_value(w[{i}]) AS a{i}_{size + 1}" for i in every]
    query = (
        f"SELECT t, c, k, any_value(w) AS w, {', '.join(entries)} FROM (SELECT n.t, n.c, n.k, n.w, r.y, r.x,"
        f" 1 / (1 + exp(-list_dot_product(n.w, r.x))) AS p FROM {name}_r n JOIN {name}_rows r ON r.t = n.t AND r.c = n.c WHERE n.k < {rounds})"
        " GROUP BY t, c, k"
    )
    for k in every:
        left = range(k + 1, size + 2)
        cell = lambda i, j: f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}"  # noqa: E731,B023
        query = f"SELECT t, c, k, w, {', '.join(f'{cell(i, j)} AS a{i}_{j}' for i in every for j in left)} FROM ({query})"
    step = ", ".join(f"w[{i}] + a{i}_{size + 1}" for i in every)
    return f"""{name}_rows AS MATERIALIZED ({rows}),
{name}_r AS (SELECT DISTINCT t, c, 0 AS k, [{', '.join(['0.0::DOUBLE'] * size)}] AS w FROM {name}_rows
  UNION ALL SELECT t, c, k + 1, [{step}] FROM ({query})),
{name} AS (SELECT t, c, w FROM {name}_r WHERE k = {rounds})"""


PARTS = Roles(("size", "price", "brand", "kind"), ("size", "price"))


#: Six numbers of a part, none a function of the others.
SHAPES = Roles(*[("size", "price", "brand", "first_word", "second_word", "kind")] * 2)
SHAPE_SELECT = """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(substr(p_brand, 7) AS DOUBLE) AS brand,
       CAST(length(split_part(p_name, ' ', 1)) AS DOUBLE) AS first_word,
       CAST(length(split_part(p_name, ' ', 2)) AS DOUBLE) AS second_word, CAST(length(p_type) AS DOUBLE) AS kind
FROM {t}"""
SHAPES_SQL = f"""indexed AS (SELECT row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':0'), p_partkey) - 1 AS idx,
   CAST(count(*) OVER () AS BIGINT) AS n, * EXCLUDE (p_partkey) FROM ({SHAPE_SELECT.format(t='part')}))"""


def part_shapes(spark: SparkSession, sf: str) -> Indexed:
    shapes = row_index(spark.sql(SHAPE_SELECT.format(t="{t}"), t=table(spark, sf, "part")), ["p_partkey"])
    return Indexed(shapes.df.drop("p_partkey"), shapes.n)


def part_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
    )


def coded_parts(spark: SparkSession, sf: str) -> Indexed:
    return coded(part_rows(spark, sf), ["p_partkey"], PARTS)


PARTS_SQL = """parts AS (SELECT row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':0'), p_partkey) - 1 AS idx,
   CAST(count(*) OVER () AS BIGINT) AS n, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price,
   CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS brand,
   CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS kind FROM part)"""
