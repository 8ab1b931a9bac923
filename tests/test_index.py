from collections import Counter

from pyspark.sql import functions as F

from tablekin.operators import index
from tablekin.operators.index import Indexed


def numbered(spark, n=5000, parts=3):
    return spark.range(n).repartition(parts).select(F.col("id").alias("key"), (F.col("id") % 7).alias("x"), (F.col("id") * 2).alias("y"))


def test_numbers_are_gapless_and_independent_of_partitioning(spark):
    runs = []
    for parts in (1, 4, 50):
        table = index.row_index(numbered(spark, parts=parts), ["key"])
        assert table.n == 5000
        runs.append({r["key"]: r["idx"] for r in table.df.collect()})
    assert sorted(runs[0].values()) == list(range(5000))
    assert runs[0] == runs[1] == runs[2]


def test_small_buckets_give_the_same_numbers(spark, monkeypatch):
    want = {r["key"]: r["idx"] for r in index.row_index(numbered(spark), ["key"]).df.collect()}
    monkeypatch.setattr(index, "ROWS_PER_BUCKET", 10)
    got = {r["key"]: r["idx"] for r in index.row_index(numbered(spark), ["key"]).df.collect()}
    assert got == want


def test_rows_without_a_key_keep_their_copies(spark):
    hot = spark.range(30_000).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    df = hot.unionByName(spark.range(100).select(F.col("id").cast("int").alias("a"), F.lit("y").alias("b")))
    table = index.row_index(df, None)
    rows = table.df.collect()
    assert sorted(r["idx"] for r in rows) == list(range(30_100))
    assert Counter((r["a"], r["b"]) for r in rows)[1, "x"] == 30_000


def test_split_has_the_exact_size(spark):
    table = index.row_index(numbered(spark, 103), ["key"])
    assert index.holdout_split(table, 0.2).where("is_test").count() == 21
    part = index.train_part(table, 0.05, 3)
    assert sorted(r["idx"] for r in part.df.collect()) == list(range(part.n)) and part.n == 97


def test_shuffle_moves_columns_as_a_unit(spark):
    table = index.row_index(numbered(spark), ["key"])
    before = table.df.collect()
    after = index.shuffle_columns(table, ["x", "y"], 4).df.collect()
    assert Counter((r["x"], r["y"]) for r in before) == Counter((r["x"], r["y"]) for r in after)
    assert sum(r["y"] == 2 * r["key"] for r in after) < 50


def test_sweep_matches_single_shuffles(spark):
    table = index.row_index(numbered(spark, 300), ["key"])
    table = Indexed(table.df.select("idx", "x", "y"), table.n)
    sweep = index.column_shuffle_sweep(table, ["x", "y"], 1, 2)
    for rep in range(2):
        chosen = index.sample_columns(["x", "y"], 1, rep)
        want = index.shuffle_columns(table, chosen, index.sweep_seed(1, rep)).df
        got = sweep.where(f"run = 1 AND rep = {rep}").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_group_is_numbered_in_pieces(spark):
    df = spark.range(9000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"))
    rows, sizes = index.group_index(df, ["g"], ["key"])
    hot = sorted(r["idx"] for r in rows.where("g = 0").collect())
    assert hot == list(range(sizes.where("g = 0").first()["n"]))
    assert "_b" in rows._jdf.queryExecution().toString()


def test_sorted_index(spark):
    df = numbered(spark, 400).select("key")
    assert all(r["key"] == r["idx"] for r in index.sorted_index(df, ["key"]).collect())


def test_no_cross_join_in_the_plans(spark):
    table = index.row_index(numbered(spark), ["key"])
    for df in (index.replicates(table, 4), index.column_shuffle_sweep(Indexed(table.df, table.n), ["x", "y"], 2, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
