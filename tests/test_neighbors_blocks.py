"""Blocks of a cell that hold points but no queries, or queries but no points."""

from tablekin.operators import neighbors
from tablekin.operators.neighbors import NearestNeighbours


def test_blocks_without_points_or_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 1)
    rows = [(i, float(i), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, x double, y double")
    model = NearestNeighbours(df, "y", ("x",), False, 1)
    got = {r["x"]: r["prediction"] for r in model.predict(df.where("x < 5")).collect()}
    assert got == {float(i): float(i % 3) for i in range(5)}
