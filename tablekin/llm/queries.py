"""Registered queries of the corpus operators and, where SQL can express them, the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.llm import (
    decontaminate,
    html_extract,
    license_scan,
    line_dedup,
    lm_score,
    near_dup,
    prefix_trie,
    quality_rules,
    sentencepiece_bpe,
    simhash,
    substring_dedup,
    suffix_dedup,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ALPHABET = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWER = "translate(coalesce(text, ''), '{}', '{}')".format(*ALPHABET)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    "op1_decontaminate",
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + 12], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


@query(
    "op4_line_dedup",
    f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             '{ALPHABET[0]}', '{ALPHABET[1]}') AS key FROM l),
f AS (SELECT key, true AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def piece_model() -> str:
    """The public vocabulary file; its package tells where it is."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(documents(spark, sf_dir), piece_model())


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_documents(documents(spark, sf_dir))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select(*base, F.round("quality", 6).alias("quality"))


@query(
    "op9_jaccard_join",
    f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM (SELECT * FROM s SEMI JOIN common USING (sh)) a
      JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
b AS MATERIALIZED (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT u AS doc_id, u AS via FROM b UNION SELECT r.doc_id, b.v FROM r JOIN b ON r.via = b.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(via) AS component_id FROM r GROUP BY doc_id) g USING (doc_id)""",
)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(documents(spark, sf_dir))


@query(
    "op5_substring_dedup",
    """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS turn FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS pos FROM r WHERE turn > 1),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT u.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY u.pos) FILTER (g.pos IS NULL) AS kept
      FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source and the language are their directories."""
    docs = documents(spark, sf_dir)
    return license_scan.scan_licenses(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))


@query("op7_html_extract")
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


#: CRC-32 of the decimal conv_id, bit by bit (fixed values: the reversed polynomial and the mask of the standard).
CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda t: CAST(ascii(t) AS BIGINT))),
 lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


@query(
    "op11_prefix_trie",
    f"""
WITH o AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS n_bytes,
                  md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
           FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, g, n_bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS p FROM o),
m AS (SELECT conv_id AS c, count(*) AS n, {CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT m.c, m.h, m.base, least(m.h, coalesce(b.n, 0)) AS taken FROM m LEFT JOIN m b ON m.base = b.c),
r AS (SELECT k.c, t.p AS d, g, n_bytes FROM k JOIN t ON t.c = k.base WHERE t.p <= k.taken
      UNION ALL SELECT k.c, t.p - k.h + k.taken, g, n_bytes FROM k JOIN t ON t.c = k.c WHERE t.p > k.h),
x AS (SELECT c, d, n_bytes, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT *, max(d) OVER (PARTITION BY c) = d AS last FROM x),
n AS (SELECT path, d, min(c) AS c, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM l GROUP BY path, d),
u AS (SELECT n.*, p.c AS up FROM n LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.path = left(n.path, 32 * (n.d - 1))),
f AS (SELECT up, d - 1 AS d, count(*) AS kids FROM u WHERE d > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(f.kids, 0) AS kids FROM u LEFT JOIN f ON u.c = f.up AND u.d = f.d),
s AS (SELECT a.path, count(*) FILTER (w.kids = 0) AS leaves, sum((w.n_convs - 1) * w.n_bytes) AS saved
      FROM w JOIN x a ON a.c = w.c AND a.d <= w.d GROUP BY a.path)
SELECT c AS conv_id, CAST(d AS BIGINT) AS depth, up AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM w JOIN s USING (path)""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(documents(spark, sf_dir))
