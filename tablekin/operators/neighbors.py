"""Exact k nearest neighbours as a partitioned search.

Equal training vectors are first reduced to their ``k`` smallest row numbers, which loses no neighbour. Space is
cut into cells; a query searches its own cell, which bounds its k-th distance, and then only the cells whose
bounding box reaches into that bound. Cells with many points or queries are split into blocks.
Neighbours are ordered by distance, then by row number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .clean import q

CELL_POINTS = 2_000
MAX_CELLS = 16_384
BLOCK_ROWS = 20_000
SAMPLES_PER_CELL = 16

FOUND = T.StructType(
    [
        T.StructField("_v", T.ArrayType(T.DoubleType())),
        T.StructField("dist", T.DoubleType()),
        T.StructField("idx", T.LongType()),
        T.StructField("y", T.DoubleType()),
    ]
)


def _split(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes ``(axis, threshold, left, right)``; a negative child ``-c - 1`` is the cell ``c``."""
    nodes: list = []
    count = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal count
        if want > 1 and len(rows) > 1:
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            cut = float(np.median(rows[:, axis]))
            low = rows[:, axis] <= cut
            if low.all():
                cut = float(np.nextafter(rows[:, axis].max(), -np.inf))
                low = rows[:, axis] <= cut
            if low.any() and not low.all():
                here = len(nodes)
                nodes.append(None)
                left = grow(rows[low], want // 2)
                right = grow(rows[~low], want - want // 2)
                nodes[here] = (axis, cut, left, right)
                return here
        count += 1
        return -count

    root = grow(sample, cells)
    return nodes if root >= 0 else []


def _cells_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """Cell of each row; all rows walk down the tree together."""
    at = np.zeros(len(x), dtype=int) if nodes else np.full(len(x), -1)
    if nodes:
        axis, cut, left, right = (np.array(c) for c in zip(*nodes))
        while (moving := np.flatnonzero(at >= 0)).size:
            node = at[moving]
            low = x[moving, axis[node]] <= cut[node]
            at[moving] = np.where(low, left[node], right[node])
    return -at - 1


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


class NearestNeighbours:
    """``df`` needs a unique ``idx``; ``predict`` gives the majority class or the mean of the ``k`` nearest rows."""

    def __init__(self, df: DataFrame, target: str, features: Sequence[str], classifier: bool, k: int = 5):
        self.features, self.classifier, self.k = tuple(features), classifier, k
        same = Window.partitionBy("_v").orderBy("idx")
        points = (
            df.select(self._vector(), "idx", q(target).cast("double").alias("y"))
            .withColumn("_r", F.row_number().over(same))
            .where(F.col("_r") <= k)
            .drop("_r")
        )
        points = materialize(points, "points")
        gap = F.exists("_v", lambda x: x.isNull()) | F.col("y").isNull()
        self.n, missing = points.agg(F.count(F.lit(1)), F.count_if(gap)).first()
        if missing:
            raise ValueError(f"{missing} rows with null cells in {target} or its features: impute or filter them first")
        cells = min(MAX_CELLS, max(1, ceil(self.n / CELL_POINTS)))
        share = min(1.0, max(1_000, cells * SAMPLES_PER_CELL) / max(self.n, 1))
        picked = F.pmod(F.xxhash64("idx"), F.lit(1_000_000)) < int(share * 1_000_000)
        sample = points.where(picked).select("_v").toPandas() if cells > 1 else pd.DataFrame({"_v": []})
        self.nodes = _split(_matrix(sample["_v"]), cells) if len(sample) > 1 else []
        self.points = points.withColumn("cell", self._cell()("_v"))
        p = len(self.features)
        stats = self.points.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.min(F.col("_v")[i]) for i in range(p)]).alias("low"),
            F.array(*[F.max(F.col("_v")[i]) for i in range(p)]).alias("high"),
        )
        self.boxes = {r["cell"]: r for r in stats.collect()}

    def _vector(self):
        return F.array(*[q(f).cast("double") for f in self.features]).alias("_v")

    def _cell(self):
        nodes = self.nodes

        @F.pandas_udf(T.IntegerType())
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(_cells_of(_matrix(v), nodes) if len(v) else [], dtype="int32")

        return cell

    def _search(self, queries: DataFrame) -> DataFrame:
        """The ``k`` best points of each block for the queries sent to its cell."""
        k, spark = self.k, queries.sparkSession
        sizes = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = [
            (c, ceil(box["n"] / BLOCK_ROWS), ceil(sizes.get(c, 0) / BLOCK_ROWS) or 1) for c, box in self.boxes.items()
        ]
        plan = F.broadcast(spark.createDataFrame(blocks, "cell int, pb int, qb int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        points = (
            self.points.join(plan, "cell").withColumn("p", block("idx", "pb")).withColumn("s", spread("qb")).drop("pb", "qb")
        )
        asked = (
            queries.join(plan, "cell").withColumn("s", block("_v", "qb")).withColumn("p", spread("pb")).drop("pb", "qb")
        )

        def best(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if points.empty or asked.empty:
                return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in FOUND.fields})  # empty numbers are no arrays
            points = points.sort_values("idx")
            x, ids, ys = _matrix(points["_v"]), points["idx"].to_numpy(), points["y"].to_numpy()
            vectors, parts = asked["_v"].to_numpy(), []
            for start in range(0, len(vectors), 256):
                part = np.stack(vectors[start : start + 256])
                d = np.zeros((len(part), len(x)))
                for i in range(x.shape[1]):
                    d += (part[:, i, None] - x[None, :, i]) ** 2
                kk = min(k, d.shape[1])
                kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
                for row in range(len(part)):
                    near = np.flatnonzero(d[row] <= kth[row])
                    near = near[np.argsort(d[row][near], kind="stable")][:kk]
                    parts.append((start + row, near, d[row][near]))
            owner = np.concatenate([np.full(len(near), o) for o, near, _ in parts])
            near = np.concatenate([near for _, near, _ in parts])
            return pd.DataFrame(
                {"_v": list(vectors[owner]), "dist": np.concatenate([d for *_, d in parts]), "idx": ids[near], "y": ys[near]}
            )

        keys = ["cell", "p", "s"]
        return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, FOUND)

    def _other_cells(self, bounded: DataFrame) -> DataFrame:
        """Queries with every further cell whose box is not farther away than the k-th distance so far."""
        ids = np.array(sorted(self.boxes))
        low = np.array([self.boxes[c]["low"] for c in ids])
        high = np.array([self.boxes[c]["high"] for c in ids])

        def reach(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), 512):
                    part = pdf.iloc[start : start + 512]
                    x = _matrix(part["_v"])
                    gap = np.zeros((len(x), len(ids)))
                    for i in range(x.shape[1]):
                        out = np.maximum(low[None, :, i] - x[:, i, None], x[:, i, None] - high[None, :, i])
                        gap += np.maximum(out, 0.0) ** 2
                    near = gap <= part["bound"].to_numpy()[:, None] * (1 + 1e-9)
                    near &= ids[None, :] != part["cell"].to_numpy()[:, None]
                    rows, cols = np.nonzero(near)
                    yield pd.DataFrame({"_v": part["_v"].to_numpy()[rows], "cell": ids[cols]})

        return bounded.mapInPandas(reach, "_v array<double>, cell int")

    def neighbours(self, vectors: DataFrame) -> DataFrame:
        """Rows ``(_v, dist, idx, y, rank)`` for distinct query vectors ``_v``."""
        home = materialize(vectors.withColumn("cell", self._cell()("_v")), "queries")
        ranked = Window.partitionBy("_v").orderBy("dist", "idx")
        found = self._search(home)
        if len(self.boxes) > 1:
            found = materialize(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= self.k), "found")
            bounds = found.groupBy("_v").agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("d"))
            bounded = home.join(bounds, "_v", "left").withColumn(
                "bound", F.when(F.coalesce("c", F.lit(0)) >= min(self.k, self.n), F.col("d")).otherwise(float("inf"))
            )
            further = materialize(self._other_cells(bounded.select("_v", "cell", "bound")), "reach")
            found = found.drop("rank").unionByName(self._search(further))
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= self.k)

    def predict(self, df: DataFrame) -> DataFrame:
        asked = df.withColumn("_v", self._vector())
        found = self.neighbours(asked.select("_v").distinct())
        if self.classifier:
            votes = found.groupBy("_v", "y").agg(F.count(F.lit(1)).alias("c"))
            answer = votes.groupBy("_v").agg(F.min_by("y", F.struct(-F.col("c"), F.col("y"))).alias("prediction"))
        else:
            answer = found.groupBy("_v").agg(F.avg("y").alias("prediction"))
        return asked.join(answer, "_v").drop("_v")
