"""Exact classification and regression trees of many targets, repetitions and copies in one job, kept as a table of nodes.

Rows carry the path of their node (``""`` is the root, ``0`` goes left, ``1`` right). A node with more than ``LOCAL_ROWS`` rows is
split by DataFrame operations: counts of (node, feature, value, class) get running sums over range partitions, which give the
score of every possible cut. Smaller nodes are whole groups of one task, which grows the rest of the tree below them. Both ways
find the same cuts, so the bound decides where the work is done, not its result.

Every cut between two different values is tried; the best has the largest sum over both sides of the squared class counts (Gini)
or of the squared sum of the target (variance) divided by the side's weight, ties by feature and then by value. Nodes are split
until they are pure or all their rows are equal. Continuous targets are held as whole multiples of 2^-30 of their half range, so all
sums are exact integers and a tree depends neither on partitions nor on the order of rows. Null cells are refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..roles import Roles
from ..session import deal, materialize
from .clean import q

#: Rows of a node that one task may hold: some 100 bytes a row with its part of the tree, and a few times that while it is split.
LOCAL_ROWS = 1 << 20
#: Rows of one model that a task scores together, and top nodes that may be broadcast.
BLOCK_ROWS, TOP_NODES = 1 << 20, 1 << 16
#: Binary digits of a continuous target.
BITS = 30
#: Hexadecimal digits that make a uniform number, and the largest weight of a drawn row.
DIGITS, MOST = 13, 16


@dataclass(frozen=True)
class Rule:
    """When to stop, and for forests the trees per model and the number of features tried at each node."""

    max_depth: int | None = None
    min_leaf: int = 1
    trees: int = 0
    seed: int = 42
    subset: bool = False  # classifiers try the root of the number of features
    draw: tuple[str, ...] = ()  # key columns that change a forest's draws, so that equal tables give equal forests

    def tried(self, width: int, classifier: bool) -> int:
        return max(1, math.isqrt(width)) if self.subset and classifier else width


@dataclass(frozen=True)
class Trees:
    """The written table of nodes, its key columns (``target`` first), and what a target's unit is."""

    nodes: DataFrame
    keys: tuple[str, ...]
    roles: Roles
    targets: tuple[str, ...]
    scales: dict[str, tuple[float, float]]
    rule: Rule
    #: For a forest whose trees each fit a task: its rows with the key columns and ``row``, and the number of bins its trees are grown
    #: in. Its table of nodes is not written then, but grown when it is read.
    rows: DataFrame | None = None
    row: str = "idx"
    bins: int = 1

    @property
    def width(self) -> int:
        return len(self.roles.columns) - 1

    def only(self, target: str) -> Trees:
        return replace(self, nodes=self.nodes.where(F.col("target") == target), targets=(target,))


# ---------------------------------------------------------------- running sums


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` with ``<value>_upto``: sums up to and including each row of its group, in an order that is unique in it.

    Rows are range-partitioned by group and order and added up part by part, so a group may be of any size.
    """
    sort = [*by, *order]
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "sorted")
    runs = dealt.groupBy(*by, "_part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*by, "_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    upto = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_in_{v}": F.sum(v).over(upto) for v in values}).join(runs, [*by, "_part"])
    sums = [(F.col(f"_in_{v}") + F.col(f"_{v}")).alias(f"{v}_upto") for v in values]
    return summed.select(*df.columns, *sums)


# ---------------------------------------------------------------- samples


def target_scales(df: DataFrame, targets: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Middle and unit of each continuous target."""
    if not targets:
        return {}
    row = df.agg(*[f(q(t)).cast("double").alias(f"{k}{i}") for i, t in enumerate(targets) for k, f in (("a", F.min), ("b", F.max))]).first()
    out = {}
    for i, t in enumerate(targets):
        low, high = row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0
        half = (high - low) / 2
        out[t] = (low + half, 2.0 ** (math.ceil(math.log2(half)) - BITS) if half > 0 else 1.0)
    return out


def _uniform(*parts: Column | str) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def poisson_shares() -> list[float]:
    """Distribution function of a Poisson number with mean 1 at 0, 1, 2, …"""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(MOST):
        total += term
        out.append(round(total, 12))
        term /= k + 1
    return out


def drawn_weight(uniform: str) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, from a uniform number."""
    shares = F.array(*[F.lit(s) for s in poisson_shares()])
    return F.size(F.filter(shares, lambda s: s <= F.col(uniform))).cast("long")


def samples(df: DataFrame, roles: Roles, targets: Sequence[str], scales, keys: Sequence[str], rule: Rule, row: str = "idx") -> DataFrame:
    """One row per target (and tree) and row of ``df``: keys, w, cls, y, s, x0, x1, …"""
    cells = []
    for t in targets:
        classifier = roles.is_categorical(t)
        middle, unit = scales.get(t, (0.0, 1.0))
        y = q(t).cast("double")
        fields = [
            F.lit(t).alias("target"),
            F.lit(classifier).alias("cls"),
            F.lit(rule.tried(len(roles.columns) - 1, classifier)).alias("tried"),
            (y if classifier else F.lit(0.0)).alias("y"),
            (F.lit(0).cast("long") if classifier else F.floor((y - middle) / unit + 0.5)).alias("s"),
        ]
        cells.append(F.struct(*fields, *[q(f).cast("double").alias(f"x{j}") for j, f in enumerate(roles.features(t))]))
    xs = [f"x{j}" for j in range(len(roles.columns) - 1)]
    source = df
    if rule.trees:
        source = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(rule.trees - 1))))
        source = source.withColumn("_u", _uniform(row, "tree", *rule.draw, F.lit(rule.seed))).withColumn("w", drawn_weight("_u")).where("w > 0")
    else:
        source = df.withColumn("w", F.lit(1).cast("long"))
    more = ["tree"] if rule.trees else []
    return source.select(*keys, *more, "w", F.inline(F.array(*cells))).select("target", *keys, *more, "w", "cls", "tried", "y", "s", *xs)


# ---------------------------------------------------------------- rows that travel packed

#: Rows that a task packs together.
PACKED = 1 << 17


def packed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys…, _rows)``: the numbers of many rows with the same keys in one cell, column by column, so that rows are neither
    sorted nor sent one by one. The numbers must be exact as doubles."""
    keys, columns = list(keys), list(columns)

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        group = np.zeros(len(table), np.int64)
        for k in keys:
            coded = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        first = _first(group[order])
        cells = np.array([np.asarray(table.column(c).to_numpy(), float)[order] for c in columns]).reshape(len(columns), len(order))
        data = [cells[:, a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(order)])]
        names = {k: table.column(k).combine_chunks().take(pa.array(order[first])) for k in keys}
        yield pa.RecordBatch.from_pydict(names | {"_rows": pa.array(data, pa.binary())})

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PACKED:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from pack(pa.Table.from_batches(held))

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, *columns).mapInArrow(send, ", ".join([*kinds, "_rows binary"]))


def unpacked(group: pa.Table, width: int) -> np.ndarray:
    """The rows of a group that ``packed`` made, as an array of ``width`` columns in Fortran order."""
    parts = [np.frombuffer(c.as_buffer()).reshape(width, -1) for c in group.column("_rows")]
    return np.concatenate(parts, axis=1).T if parts else np.zeros((0, width))


# ---------------------------------------------------------------- small nodes: one task


def draw_keys(keys: Sequence[str], rule: Rule) -> list[str]:
    """The key columns that a forest's draws depend on."""
    return [k for k in keys if k in ("target", "tree", *rule.draw)]


def feature_order(key: str, node: str, features: Sequence[int], seed: int) -> list[int]:
    """The features in the order in which a node of a forest draws them."""
    return sorted(features, key=lambda f: hashlib.md5(f"{key}|{node}|{f}|{seed}".encode()).hexdigest())


def _first(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal numbers."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that start anew with each run."""
    total = np.cumsum(values)
    total -= np.repeat(total[first] - values[first], np.diff(np.r_[first, len(values)]))
    return total


@dataclass
class _Columns:
    """A group's rows by number: the places of their values, class or target, and weight; ``ws`` is weight times target."""

    places: list[np.ndarray]
    c: np.ndarray | None
    classes: int
    w: np.ndarray
    ws: np.ndarray | None


def _best_cuts(rows: _Columns, f: int, by_value: np.ndarray, by_class: np.ndarray | None, seg: np.ndarray, min_leaf: int):
    """Best cut of feature ``f`` in each node: (node, score, place to the left, place to the right).

    ``by_value`` numbers the rows in the order of node and value, ``by_class`` in that of node, class and value; ``seg`` numbers
    the nodes of both.
    """
    v, w = rows.places[f][by_value], rows.w[by_value]
    first = _first(seg)
    size = np.diff(np.r_[first, len(seg)])
    at = np.flatnonzero((seg[1:] == seg[:-1]) & (v[1:] != v[:-1]))
    if not len(at):
        return None
    left = _within(w, first)
    n_left = left[at]
    n_right = np.repeat(np.add.reduceat(w, first), size)[at] - n_left
    if min_leaf > 1:
        wide = (n_left >= min_leaf) & (n_right >= min_leaf)
        at, n_left, n_right = at[wide], n_left[wide], n_right[wide]
        if not len(at):
            return None
    if by_class is None:
        part = rows.ws[by_value]
        sums, total = _within(part, first)[at], np.repeat(np.add.reduceat(part, first), size)[at]
        a, b = sums.astype(float), (total - sums).astype(float)
        score = a * a / n_left + b * b / n_right
    else:
        own = rows.w[by_class]
        runs = _first(seg * np.int64(rows.classes) + rows.c[by_class])
        seen = _within(own, runs)
        total = np.repeat(np.add.reduceat(own, runs), np.diff(np.r_[runs, len(own)]))
        of_row = np.empty(len(rows.w), np.int64)
        of_row[by_class] = own * (2 * seen - own)  # by how much the sum of the squared counts grows with this row
        squares = _within(of_row[by_value], first)[at]
        of_row[by_class] = total * own
        part = of_row[by_value]
        mixed, every = _within(part, first)[at], np.repeat(np.add.reduceat(part, first), size)[at]
        score = squares / n_left + (every - 2 * mixed + squares) / n_right
    node = seg[at]
    first = _first(node)
    most = np.maximum.reduceat(score, first)
    top = np.flatnonzero(score == np.repeat(most, np.diff(np.r_[first, len(node)])))
    top = top[_first(node[top])]  # the smallest value of equally good ones
    return node[top], score[top], v[at[top]], v[at[top] + 1]


def grow_small(x: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray, cls: bool, tried: int, key: str, root: str, rule: Rule) -> pa.Table:
    """All nodes below (and with) ``root`` for the rows of one group, level by level, with the columns of ``NODE``.

    Rows are sorted once by each feature (and by class and feature). A split keeps the order on both sides, so every level only
    parts the sorted row numbers of its nodes.
    """
    levels, paths, width, depth = [], pa.array([root], pa.string()), x.shape[1], len(root)
    known, values = [], None
    places = []
    for f in range(width):
        found, place = np.unique(x[:, f], return_inverse=True)
        known.append(found)
        places.append(place.astype(np.int32))
    w = np.ascontiguousarray(w, np.int64)
    if cls:
        values, c = np.unique(y, return_inverse=True)
        rows = _Columns(places, c.astype(np.int32), len(values), w, None)
    else:
        rows = _Columns(places, None, 0, w, w * s)
    # 2 * width orders of a classifier's rows (width of a regressor's), each parted by the same nodes
    orders = [np.argsort(p, kind="stable").astype(np.int32) for p in places]
    if cls:
        orders += [o[np.argsort(rows.c[o], kind="stable")] for o in orders]
        if not width:
            orders = [np.argsort(rows.c, kind="stable").astype(np.int32)]
    elif not width:
        orders = [np.arange(len(x), dtype=np.int32)]
    seg = np.zeros(len(x), np.int64)
    table = np.stack(places) if width else np.zeros((0, len(x)), np.int32)
    side = np.zeros(len(x), bool)
    while len(seg):
        first = _first(seg)
        size = np.diff(np.r_[first, len(seg)])
        last = orders[-1]  # by class where there are classes
        weight = w[last]
        n = np.add.reduceat(weight, first)
        if cls:
            kind = seg * np.int64(len(values)) + rows.c[last]
            runs = _first(kind)
            cells, count = kind[runs], np.add.reduceat(weight, runs)
            of = cells // len(values)
            cell_first = _first(of)
            own = np.add.reduceat(count * count, cell_first) / n
            ends = np.r_[cell_first, len(cells)]
            pure = np.diff(ends) == 1
            largest = np.flatnonzero(count == np.repeat(np.maximum.reduceat(count, cell_first), np.diff(ends)))
            largest = largest[_first(of[largest])]  # the smallest of equally common classes
            label = values[cells[largest] % len(values)]
        else:
            total = np.add.reduceat(rows.ws[last], first)
            own, label = total.astype(float) * total.astype(float) / n, total / n
            target = s[last]
            pure = np.minimum.reduceat(target, first) == np.maximum.reduceat(target, first)
        best = np.full(len(first), -np.inf)
        feature, low, high = np.full(len(first), -1), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        deep = rule.max_depth is not None and depth >= rule.max_depth
        going = ~pure & (not deep)
        varied = [places[f][orders[f][first]] != places[f][orders[f][first + size - 1]] for f in range(width)]
        allowed = np.stack(varied, axis=1) if width else np.zeros((len(first), 0), bool)
        if tried < width:
            for k in np.flatnonzero(~pure & (allowed.sum(axis=1) > tried)):
                drawn = feature_order(key, paths[k].as_py(), np.flatnonzero(allowed[k]).tolist(), rule.seed)[:tried]
                allowed[k] = False
                allowed[k, drawn] = True
        allowed &= going[:, None]
        for f in range(width):
            if allowed[:, f].all():
                some, at = slice(None), seg
            else:
                some = np.flatnonzero(np.repeat(allowed[:, f], size))
                at = seg[some]
            found = _best_cuts(rows, f, orders[f][some], orders[width + f][some] if cls else None, at, rule.min_leaf) if len(at) else None
            if found is None:
                continue
            node, score, lower, upper = found
            won = score > best[node]
            node = node[won]
            best[node], feature[node], low[node], high[node] = score[won], f, lower[won], upper[won]
        leaf = feature < 0
        lower, upper = np.zeros(len(first)), np.zeros(len(first))
        for f in range(width):
            at = np.flatnonzero(feature == f)
            lower[at], upper[at] = known[f][low[at]], known[f][high[at]]
        half = lower + (upper - lower) / 2
        cut = np.where(half < upper, half, lower)
        if cls:
            counted = np.where(leaf, np.diff(ends), 0)
            kept = leaf[of]
            starts = np.r_[0, np.cumsum(counted)].astype(np.int32)
            lists = [(values[cells[kept] % len(values)], pa.float64()), (count[kept], pa.int64())]
            ends_ = pa.array(starts, mask=np.r_[~leaf, False])
            listed = [pa.ListArray.from_arrays(ends_, pa.array(v, t)) for v, t in lists]
        else:
            listed = [pa.nulls(len(first), pa.list_(t)) for t in (pa.float64(), pa.int64())]
        gain = np.where(leaf, 0.0, best - own)
        cells_ = [pa.array(n, pa.int64()), pa.array(feature, pa.int32(), mask=leaf), pa.array(cut, mask=leaf), pa.array(gain), pa.array(label.astype(float))]
        levels.append(pa.table([paths, pa.array([root] * len(first), pa.string()), *cells_, *listed], NODE_NAMES))
        split = np.flatnonzero(~leaf)
        if not len(split):
            break
        if leaf.any():
            stay = np.repeat(~leaf, size)
            orders = [o[stay] for o in orders]
            seg, size, feature, low = seg[stay], size[split], feature[split], low[split]
        at = np.repeat(np.arange(len(split)), size)
        right = table[feature[at], orders[0]] > low[at]
        side[orders[0]] = right
        on_right = np.add.reduceat(right, np.r_[0, np.cumsum(size)[:-1]], dtype=np.int64)
        sizes = np.column_stack([size - on_right, on_right]).ravel()
        seg = np.repeat(np.arange(len(sizes)), sizes)
        to_right = (seg & 1).astype(bool)
        for k, o in enumerate(orders):
            goes = side[o]
            parted = np.empty_like(o)
            parted[to_right], parted[~to_right] = o[goes], o[~goes]
            orders[k] = parted
        paths = pc.binary_join_element_wise(paths.take(pa.array(np.repeat(split, 2))), pa.array(["0", "1"] * len(split), pa.string()), "")
        depth += 1
    return pa.concat_tables(levels)


NODE = "node string, root string, n long, feature int, threshold double, gain double, label double, classes array<double>, counts array<long>"
NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]


def _grow_groups(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], rule: Rule) -> DataFrame:
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    drawn = draw_keys(keys, rule)
    group = [*keys, "node", "cls", "tried"]

    def grow(key: tuple, some: pa.Table) -> pa.Table:
        *own, root, cls, tried = key
        x = unpacked(some, len(xs) + 3)
        w, s = (x[:, j].astype(np.int64) for j in (0, 2))
        text = "|".join(str(k.as_py()) for k, name in zip(own, keys) if name in drawn)
        found = grow_small(x[:, 3:], x[:, 1], s, w, cls.as_py(), tried.as_py(), text, root.as_py(), rule)
        columns = [pa.array([k.as_py()] * len(found), k.type) for k in own]
        return pa.table([*columns, *found.columns], [*keys, *NODE_NAMES])

    some = packed(rows, group, ["w", "y", "s", *xs])
    return deal(some, *keys, "node").groupBy(*group).applyInArrow(grow, f"{schema}, {NODE}")


# ---------------------------------------------------------------- large nodes: one level at a time


def _split_level(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Records of the large nodes of one level, and their rows one level further down."""
    at = [*keys, "node"]
    kind = F.when(F.col("cls"), F.col("y")).otherwise(0.0).alias("c")
    cells = rows.select(*at, "w", "s", kind, F.posexplode(F.array(*xs)).alias("f", "v"))
    sums = [F.sum("w").alias("k"), F.sum(F.col("w") * F.col("s")).alias("s"), F.count(F.lit(1)).alias("r")]
    counted = materialize(cells.groupBy(*at, "f", "v", "c").agg(*sums), "counts")
    classes = counted.where("f = 0").groupBy(*at, "c").agg(F.sum("k").alias("total"))
    whole = rows.groupBy(*at).agg(
        F.first("cls").alias("cls"), F.first("tried").alias("tried"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("s")).alias("sum"),
        F.min("s").alias("low"), F.max("s").alias("high"), F.count(F.lit(1)).alias("rows"),
    )
    listed = F.array_sort(F.collect_list(F.struct("c", "total")))  # as many as the target has classes
    per_class = classes.groupBy(*at).agg(F.sum(F.col("total") * F.col("total")).alias("squares"), F.count(F.lit(1)).alias("n_classes"), listed.alias("cells"))
    whole = materialize(whole.join(per_class, at), "whole")
    seen = running_sums(counted, [*at, "f", "c"], ["v"], ["k"]).join(classes, [*at, "c"])
    before = F.col("k_upto") - F.col("k")
    steps = seen.groupBy(*at, "f", "v").agg(
        F.sum("k").alias("k"), F.sum(F.col("k") * (2 * before + F.col("k"))).alias("d"), F.sum(F.col("total") * F.col("k")).alias("m"),
        F.sum("s").alias("s"), F.sum("r").alias("r"),
    )
    upto = running_sums(steps, [*at, "f"], ["v"], ["k", "d", "m", "s", "r"]).select(*at, "f", "v", *[f"{c}_upto" for c in "kdmsr"])
    varied = counted.groupBy(*at, "f").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least < most").drop("least", "most")
    if rule.subset:
        digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in draw_keys(keys, rule)], "node", F.col("f").cast("string"), F.lit(str(rule.seed))))
        turn = F.row_number().over(Window.partitionBy(*at).orderBy(digest))  # a node has as many rows here as there are features
        varied = varied.withColumn("turn", turn).join(whole.select(*at, "tried"), at).where("turn <= tried").drop("turn", "tried")
    n_left, n_right = F.col("k_upto"), F.col("n") - F.col("k_upto")
    a, b = F.col("s_upto").cast("double"), (F.col("sum") - F.col("s_upto")).cast("double")
    score = F.when(F.col("cls"), F.col("d_upto") / n_left + (F.col("squares") - 2 * F.col("m_upto") + F.col("d_upto")) / n_right)
    score = score.otherwise(a * a / n_left + b * b / n_right)
    impure = F.when(F.col("cls"), F.col("n_classes") > 1).otherwise(F.col("low") < F.col("high"))
    if rule.max_depth is not None:
        impure &= F.length("node") < rule.max_depth
    tried = upto.join(whole.drop("cells"), at).join(varied, [*at, "f"]).where(impure & (n_left >= rule.min_leaf) & (n_right >= rule.min_leaf))
    best = F.max(F.struct(score.alias("score"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "r_upto")).alias("best")
    best = tried.groupBy(*at).agg(best).select(
        *at, F.col("best.score").alias("score"), (-F.col("best.f")).alias("feature"), (-F.col("best.v")).alias("low_v"), F.col("best.r_upto").alias("rows_left")
    )
    best = materialize(best, "best")
    above = counted.select(*at, F.col("f").alias("feature"), "v").join(best, [*at, "feature"]).where("v > low_v")
    above = above.groupBy(*at).agg(F.min("v").alias("high_v"))
    half = F.col("low_v") + (F.col("high_v") - F.col("low_v")) / 2
    cut = F.when(half < F.col("high_v"), half).otherwise(F.col("low_v"))
    best = materialize(best.join(above, at).select(*at, "feature", cut.alias("threshold"), "score", "rows_left"), "splits")

    own = F.when(F.col("cls"), F.col("squares") / F.col("n")).otherwise(F.col("sum").cast("double") * F.col("sum").cast("double") / F.col("n"))
    largest = F.element_at(F.array_sort(F.transform("cells", lambda x: F.struct((-x["total"]).alias("t"), x["c"].alias("c")))), 1)["c"]
    leaf = F.col("feature").isNull()
    of_class = lambda name: F.when(leaf & F.col("cls"), F.transform("cells", lambda x: x[name]))
    records = whole.join(best, at, "left").select(
        *at,
        F.when(leaf, F.col("node")).alias("root"),
        "n",
        F.col("feature").cast("int").alias("feature"),
        "threshold",
        F.when(leaf, 0.0).otherwise(F.col("score") - own).alias("gain"),
        F.when(F.col("cls"), largest).otherwise(F.col("sum") / F.col("n")).alias("label"),
        of_class("c").alias("classes"),
        of_class("total").alias("counts"),
    )
    left = F.element_at(F.array(*xs), F.col("feature").cast("int") + 1) <= F.col("threshold")
    down = rows.join(best.select(*at, "feature", "threshold", "rows_left"), at)
    down = down.withColumns(
        {
            "node": F.concat("node", F.when(left, "0").otherwise("1")),
            "rows": F.when(left, F.col("rows_left")).otherwise(F.col("rows") - F.col("rows_left")),
        }
    ).select(*rows.columns)
    return records, down


def grow(rows: DataFrame, keys: Sequence[str], width: int, rule: Rule = Rule()) -> DataFrame:
    """Nodes of the trees of all ``keys``; ``rows`` as ``samples`` gives them."""
    xs = [f"x{j}" for j in range(width)]
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    largest = size.agg(F.max("rows")).first()[0] or 0
    if largest <= LOCAL_ROWS:
        return materialize(_grow_groups(rows.withColumn("node", F.lit("")), keys, xs, rule).withColumn("big", F.lit(False)), "trees")
    level = materialize(rows.withColumn("node", F.lit("")).join(size, list(keys)), "level")
    parts, small = [], []
    while True:
        small.append(level.where(F.col("rows") <= LOCAL_ROWS).drop("rows"))
        large = level.where(F.col("rows") > LOCAL_ROWS)
        if not large.head(1):
            break
        records, down = _split_level(large, keys, xs, rule)
        parts.append(materialize(records.withColumn("big", F.lit(True)), "nodes"))
        level = materialize(down, "level")
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    nodes = _grow_groups(rest, keys, xs, rule).withColumn("big", F.lit(False))
    for part in parts:
        nodes = nodes.unionByName(part)
    return materialize(nodes, "trees")


def fit_trees(df: DataFrame, roles: Roles, targets: Sequence[str] | None = None, keys: Sequence[str] = (), rule: Rule = Rule(), row: str = "idx") -> Trees:
    """Trees of all ``targets`` on each part of ``df`` that ``keys`` tell apart, each on the other columns."""
    chosen = tuple(targets or roles.columns)
    missing = df.where(" OR ".join(f"`{c}` IS NULL" for c in roles.columns)).head(1)
    if missing:
        raise ValueError(f"null cells in {[c for c in roles.columns if missing[0][c] is None]}: impute or filter them first")
    scales = target_scales(df, [t for t in chosen if not roles.is_categorical(t)])
    own = ("target", *keys, *(("tree",) if rule.trees else ()))
    if rule.trees:
        size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("models")).first()
        drawn = (size["most"] or 0) * (1 - math.exp(-1))
        if drawn + 6 * math.sqrt(drawn) <= LOCAL_ROWS:
            bins = min(rule.trees, -(-2 * df.sparkSession.sparkContext.defaultParallelism // max(size["models"], 1)))
            own_rows = df.select(*keys, row, *map(q, roles.columns))
            grown = Trees(df, own, roles, chosen, scales, rule, own_rows, row, bins)
            return replace(grown, nodes=_forest_nodes(grown))
    rows = samples(df, roles, chosen, scales, keys, rule, row)
    return Trees(grow(rows, own, len(roles.columns) - 1, rule), own, roles, chosen, scales, rule)


# ---------------------------------------------------------------- forests whose trees each fit a task


def _draws(row: np.ndarray, tree: int, draw: Sequence[object], seed: int) -> np.ndarray:
    """How often each row is drawn for a tree; the same numbers as ``samples`` gives."""
    end = f"|{'|'.join(map(str, (tree, *draw, seed)))}".encode()
    digests = b"".join([hashlib.md5(b"%d%b" % (k, end)).digest() for k in row.tolist()])
    uniform = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(64 - 4 * DIGITS)).astype(float) / float(16**DIGITS)
    return np.searchsorted(np.array(poisson_shares()), uniform, "right")


def _forest_rows(trees: Trees) -> DataFrame:
    """The forest's rows, packed, once for each bin of trees."""
    keys = [k for k in trees.keys if k not in ("target", "tree")]
    columns = {f"_{j}": q(c).cast("double") for j, c in enumerate(trees.roles.columns)}
    rows = packed(trees.rows.select(*keys, F.col(trees.row).cast("long").alias("_row"), *[c.alias(n) for n, c in columns.items()]), keys, ["_row", *columns])
    return rows.withColumn("_trees", F.explode(F.sequence(F.lit(0), F.lit(trees.bins - 1))))


def _plant(trees: Trees):
    """A function that grows the trees of a bin: ``(target, tree, nodes)`` one by one, targets in order."""
    roles, targets, scales, rule, bins = trees.roles, trees.targets, dict(trees.scales), trees.rule, trees.bins
    columns, draws = list(roles.columns), draw_keys(trees.keys, rule)
    parts = [k for k in trees.keys if k not in ("target", "tree")]

    def plant(rows: np.ndarray, bin_: int, of: dict[str, object]) -> Iterator[tuple[str, int, pa.Table]]:
        ids = rows[:, 0].astype(np.int64)
        grown = range(bin_, rule.trees, bins)
        weights = [_draws(ids, t, [of[k] for k in rule.draw], rule.seed).astype(np.int8) for t in grown]
        for target in targets:
            classifier = roles.is_categorical(target)
            middle, unit = scales.get(target, (0.0, 1.0))
            y = rows[:, 1 + columns.index(target)]
            x = rows[:, [1 + columns.index(f) for f in roles.features(target)]]
            s = np.zeros(len(y), np.int64) if classifier else np.floor((y - middle) / unit + 0.5).astype(np.int64)
            y = y if classifier else np.zeros(len(y))
            for t, weight in zip(grown, weights):
                own = np.flatnonzero(weight)
                if len(own):
                    text = "|".join(str(v) for k, v in ({"target": target} | {k: of[k] for k in parts} | {"tree": t}).items() if k in draws)
                    yield target, t, grow_small(x[own], y[own], s[own], weight[own], classifier, rule.tried(x.shape[1], classifier), text, "", rule)

    return plant


def _forest_nodes(trees: Trees) -> DataFrame:
    rows, plant = _forest_rows(trees), _plant(trees)
    parts = [k for k in trees.keys if k not in ("target", "tree")]
    width = len(trees.roles.columns) + 1
    kinds = {"target": "string", "tree": "int"} | {k: rows.schema[k].dataType.simpleString() for k in parts}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in trees.keys)

    def grow(key: tuple, some: pa.Table) -> pa.Table:
        values = dict(zip([*parts, "_trees"], key))
        of, out = {k: v.as_py() for k, v in values.items()}, []
        for target, tree, nodes in plant(unpacked(some, width), of["_trees"], of):
            known = {"target": pa.scalar(target), "tree": pa.scalar(tree, pa.int32())} | values
            columns = [pa.repeat(known[k], len(nodes)) for k in trees_keys]
            out.append(pa.table([*columns, *nodes.columns, pa.repeat(False, len(nodes))], [*trees_keys, *NODE_NAMES, "big"]))
        return pa.concat_tables(out)

    trees_keys = trees.keys
    group = [*parts, "_trees"]
    return deal(rows, *group).groupBy(*group).applyInArrow(grow, f"{schema}, {NODE}, big boolean")


def _descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node each row of ``x`` ends in; the right child follows the left one."""
    at = np.zeros(len(x), np.int32)
    going = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        now = at[going]
        now = left[now] + ~(x[going, feature[now]] <= cut[now])
        at[going] = now
        going = going[feature[now] >= 0]
    return at


#: Rows that a forest gives votes on at once.
VOTERS = 1 << 15


def _forest_predict(df: DataFrame, trees: Trees, carry: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``predict`` of a forest that is grown for it: a task grows a bin of trees, sends its rows down and adds up their votes,
    and the votes of all bins on a block of rows meet. Only votes leave a task."""
    parts = [k for k in trees.keys if k not in ("target", "tree")]
    columns, targets, bins, scales = list(trees.roles.columns), trees.targets, trees.bins, dict(trees.scales)
    here = [j for j, c in enumerate(columns) if c in df.columns]
    carried, ys = [f"_k{j}" for j in range(len(carry))], [f"_y{j}" for j in range(len(targets))]
    classifiers = {t for t in targets if trees.roles.is_categorical(t)}
    y = lambda t: q(t).cast("double") if t in df.columns else F.lit(None).cast("double")
    plain = df.select(
        *[F.col(k) for k in parts], *[q(columns[j]).cast("double").alias(f"_{j}") for j in here],
        *[F.col(c).alias(n) for c, n in zip(carry, carried)], *[y(t).alias(n) for t, n in zip(targets, ys)],
    )

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            group = np.zeros(len(table), np.int64)
            for k in parts:
                coded = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            first = _first(group[order])
            for a, b in zip(first, np.r_[first[1:], len(order)]):
                some = table.take(pa.array(order[a:b])).combine_chunks()
                cells = np.full((len(columns), b - a), np.nan)
                for j in here:
                    cells[j] = np.asarray(some.column(f"_{j}").to_numpy(), float)
                sink = pa.BufferOutputStream()
                rest = some.select([*carried, *ys])
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_table(rest)
                names = [some.column(k).combine_chunks().slice(0, 1) for k in parts]
                data = [pa.array([v], pa.binary()) for v in (cells.tobytes(), sink.getvalue().to_pybytes())]
                yield pa.RecordBatch.from_arrays([*names, *data], [*parts, "_rows", "_rest"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= VOTERS:
                yield from cut(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from cut(pa.Table.from_batches(held))

    kinds = ", ".join(f"`{k}` {plain.schema[k].dataType.simpleString()}" for k in parts)
    blocks = plain.mapInArrow(block, f"{kinds}{', ' if kinds else ''}_rows binary, _rest binary")
    blocks = materialize(blocks.withColumn("_block", F.monotonically_increasing_id()), "blocks")
    each = blocks.withColumn("_trees", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("_rest", F.when(F.col("_trees") == 0, F.col("_rest")))
    plant, width = _plant(trees), len(columns)
    features = {t: [columns.index(f) for f in trees.roles.features(t)] for t in targets}
    names = [*parts, "target", "_block", "_votes", "_rest"]

    def vote(key: tuple, some: pa.Table, there: pa.Table) -> pa.Table:
        of = dict(zip([*parts, "_trees"], [k.as_py() for k in key]))
        out = []
        rows = unpacked(some, width + 1)
        if len(rows) and len(there):
            for target, planted in groupby(plant(rows, of["_trees"], of), lambda p: p[0]):
                classes = np.unique(rows[:, 1 + columns.index(target)]) if target in classifiers else None
                stand = [_stand(nodes, classes) for _, _, nodes in planted]
                for cells, number, rest in zip(there.column("_rows"), there.column("_block"), there.column("_rest")):
                    x = np.frombuffer(cells.as_buffer()).reshape(width, -1).T[:, features[target]]
                    out.append([*(of[k] for k in parts), target, number.as_py(), _votes(x, stand, classes), rest.as_py()])
        return pa.table([pa.array(v, f.type) for v, f in zip(list(zip(*out)) or [[]] * len(names), arrow)], names)

    kinds = f"{kinds}{', ' if kinds else ''}target string, _block long, _votes binary, _rest binary"
    arrow = to_arrow_schema(_parse_datatype_string(kinds))
    group = [*parts, "_trees"]
    grown = deal(_forest_rows(trees), *group).groupBy(*group).cogroup(deal(each, *group).groupBy(*group)).applyInArrow(vote, kinds)
    model = [k for k in trees.keys if k != "tree"]
    number = trees.rule.trees

    def count(key: tuple, some: pa.Table) -> pa.Table:
        of = dict(zip([*model, "_block"], key))
        target = of["target"].as_py()
        rest = pa.ipc.open_stream(next(v for v in some.column("_rest").to_pylist() if v is not None)).read_all()
        votes = [v.as_buffer() for v in some.column("_votes")]
        if target in classifiers:
            total = np.zeros(0)
            for v in votes:
                n = int(np.frombuffer(v, np.int64, 1)[0])
                values = np.frombuffer(v, np.float64, n, 8)
                size = int(np.frombuffer(v, np.int64, 1, 8 + 8 * n)[0])
                at, more = np.frombuffer(v, np.int64, size, 16 + 8 * n), np.frombuffer(v, np.float64, size, 16 + 8 * (n + size))
                total = total if len(total) else np.zeros(len(rest) * n)
                total[at] += more
            said = values[np.argmax(total.reshape(len(rest), n), axis=1)]  # the smallest of equal ones
        else:
            middle, unit = scales.get(target, (0.0, 1.0))
            said = middle + unit * (sum(np.frombuffer(v) for v in votes) / number)
        keys_ = [pa.repeat(of[k], len(rest)) for k in model]
        own = [rest.column(c) for c in (*carried, ys[targets.index(target)])]
        return pa.table([*keys_, *own, pa.array(said, pa.float64())], [*model, *carried, "y", "prediction"])

    schema = ", ".join(f"`{k}` {(grown if k in model else plain).schema[k].dataType.simpleString()}" for k in (*model, *carried))
    found = deal(grown, *model, "_block").groupBy(*model, "_block").applyInArrow(count, f"{schema}, y double, prediction double")
    return found.select(*model, *[F.col(n).alias(c) for c, n in zip(carry, carried)], "y", "prediction")


def _stand(nodes: pa.Table, classes: np.ndarray | None) -> tuple:
    """A grown tree as arrays: feature, cut and left child of each node, and the labels, or where a leaf's shares of the classes
    begin and end, their classes and shares (whole multiples of 2^-40)."""
    feature = nodes.column("feature").fill_null(-1).to_numpy().astype(np.int32)
    split = feature >= 0
    left = np.where(split, 2 * (np.cumsum(split) - split) + 1, 0).astype(np.int32)  # nodes come level by level, children in pairs
    cut = nodes.column("threshold").to_numpy()
    if classes is None:
        return feature, cut, left, nodes.column("label").to_numpy()
    sizes = pc.fill_null(pc.list_value_length(nodes.column("counts")), 0).to_numpy()
    count = pc.list_flatten(nodes.column("counts")).to_numpy()
    code = np.searchsorted(classes, pc.list_flatten(nodes.column("classes")).to_numpy())
    of = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(of, count, len(sizes))[of]
    ends = np.cumsum(sizes)
    return feature, cut, left, ends - sizes, sizes, code, np.floor(count / total * 2.0**40)


def _votes(x: np.ndarray, stand: Sequence[tuple], classes: np.ndarray | None) -> bytes:
    """What trees say about the rows of ``x``: sums of labels, or the classes and the sums of their shares that are not 0."""
    x = np.ascontiguousarray(x)
    if classes is None:
        return sum(label[_descend(x, *tree)] for *tree, label in stand).tobytes()
    total = np.zeros(len(x) * len(classes))
    for feature, cut, left, start, sizes, code, share in stand:
        at = _descend(x, feature, cut, left)
        n = sizes[at]
        cell = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        total += np.bincount(np.repeat(np.arange(len(x)), n) * len(classes) + code[cell], share[cell], len(total))
    at = np.flatnonzero(total)
    return b"".join([np.int64(len(classes)).tobytes(), classes.tobytes(), np.int64(len(at)).tobytes(), at.tobytes(), total[at].tobytes()])


# ---------------------------------------------------------------- what follows from the table of nodes


def impurity_importance(trees: Trees) -> DataFrame:
    """Rows ``(target, keys…, feature, pos, score)``: shares of the decrease of impurity; all 0 without a split.

    A forest's importance is the mean over its trees.
    """
    gains = trees.nodes.groupBy(*trees.keys, F.col("feature").alias("f")).agg(F.sum("gain").alias("gain"))  # with a row for the leaves of each tree
    gains = gains if trees.rows is None else materialize(gains, "gains")
    splits = gains.where("f IS NOT NULL")
    share = F.coalesce(F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy(*trees.keys))), F.lit(0.0))
    shares = splits.select(*trees.keys, "f", share.alias("score"))
    model = [k for k in trees.keys if k != "tree"]
    summed = shares.groupBy(*model, "f").agg((F.sum("score") / max(trees.rule.trees, 1)).alias("score"))
    places = F.array(
        *[
            F.struct(F.lit(t).alias("_t"), F.lit(j).alias("f"), F.lit(f).alias("feature"), F.lit(trees.roles.position(f)).alias("pos"))
            for t in trees.targets
            for j, f in enumerate(trees.roles.features(t))
        ]
    )
    grid = gains.where("f IS NULL").select(*model).distinct().select(*model, F.inline(places)).where("target = _t").drop("_t")
    return grid.join(summed, [*model, "f"], "left").select(*model, "feature", "pos", F.coalesce("score", F.lit(0.0)).alias("score"))


def _walk(x: np.ndarray, nodes: pa.Table) -> np.ndarray:
    """Row of ``nodes`` that each row of ``x`` ends in; ``nodes`` is one subtree."""
    paths = nodes.column("node").to_pylist()
    place = {p: k for k, p in enumerate(paths)}
    feature = np.array([-1 if f is None else f for f in nodes.column("feature").to_pylist()])
    cut = nodes.column("threshold").to_numpy(zero_copy_only=False)
    below = [np.array([place.get(p + side, -1) for p in paths]) for side in "01"]
    at = np.full(len(x), place[min(paths, key=len)])
    going = np.arange(len(x))
    while len(going := going[feature[at[going]] >= 0]):
        now = at[going]
        left = x[going, feature[now]] <= cut[now]
        at[going] = np.where(left, below[0][now], below[1][now])
    return at


def land(rows: DataFrame, trees: Trees, per_model: int) -> DataFrame:
    """``rows`` (keys, x0, x1, … and any others) with the leaf they end in: ``leaf``, ``leaf_n``, ``label``, ``classes``, ``counts``.

    ``per_model`` is about the number of rows of one key. Rows go down the large nodes by joins, then each subtree of a small
    node meets its rows in blocks.
    """
    keys, xs = list(trees.keys), [f"x{j}" for j in range(trees.width)]
    top = trees.nodes.where("big AND feature IS NOT NULL").select(*keys, "node", "feature", "threshold")
    levels = top.agg(F.max(F.length("node")).alias("deepest"), F.count(F.lit(1)).alias("n")).first()
    rows = rows.withColumn("_at", F.lit(""))
    for depth in range(0 if levels["deepest"] is None else levels["deepest"] + 1):
        splits = top.where(F.length("node") == depth).withColumnsRenamed({"node": "_at", "feature": "_f", "threshold": "_c"})
        splits = F.broadcast(splits) if levels["n"] <= TOP_NODES else splits
        left = F.element_at(F.array(*xs), F.col("_f") + 1) <= F.col("_c")
        step = F.when(F.col("_f").isNull(), "").when(left, "0").otherwise("1")
        rows = rows.join(splits, [*keys, "_at"], "left").withColumn("_at", F.concat("_at", step)).drop("_f", "_c")
    blocks = -(-max(per_model, 1) // BLOCK_ROWS)
    rows = rows.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    nodes = trees.nodes.where("root IS NOT NULL").withColumnRenamed("root", "_at")
    nodes = nodes.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    carried = [c for c in rows.columns if c not in ("_at", "_block")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    found = ["node", "n", "label", "classes", "counts"]

    def meet(key: tuple, some: pa.Table, subtree: pa.Table) -> pa.Table:
        if not len(some):
            at = np.zeros(0, np.int64)
        else:
            at = _walk(np.column_stack([some.column(c).to_numpy() for c in xs]), subtree)
        ends = subtree.select(found).take(pa.array(at))
        return pa.table([*[some.column(c) for c in carried], *ends.columns], [*carried, "leaf", "leaf_n", *found[2:]])

    group = [*keys, "_at", "_block"]
    both = deal(rows, *group).groupBy(*group).cogroup(deal(nodes, *group).groupBy(*group))
    return both.applyInArrow(meet, f"{schema}, leaf string, leaf_n long, label double, classes array<double>, counts array<long>")


def as_inputs(df: DataFrame, trees: Trees, carry: Sequence[str | Column], keys: Sequence[str] = ()) -> DataFrame:
    """One row per target (and tree) and row of ``df``: the features in the trees' order, ``y`` and the ``carry`` columns."""
    cells = []
    for t in trees.targets:
        xs = [q(f).cast("double").alias(f"x{j}") for j, f in enumerate(trees.roles.features(t))]
        y = q(t).cast("double") if t in df.columns else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(t).alias("target"), y.alias("y"), *xs))
    out = df.select(*keys, *carry, F.inline(F.array(*cells)))
    if trees.rule.trees:
        out = out.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees.rule.trees - 1))))
    return out


def in_units(trees: Trees, label: Column) -> Column:
    """A leaf's label as a value of its target."""
    out = label
    for t, (middle, unit) in trees.scales.items():
        out = F.when(F.col("target") == t, F.lit(middle) + F.lit(unit) * label).otherwise(out)
    return out


def predict(df: DataFrame, trees: Trees, per_model: int, carry: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(target, keys…, carry…, y, prediction)``; ``carry`` must tell the rows of ``df`` apart if the trees are forests.

    A tree gives its leaf's commonest class (the smallest of equal ones) or mean. A forest adds up the class shares of its
    leaves, as whole multiples of 2^-40, or takes the mean of its trees.
    """
    model = [k for k in trees.keys if k != "tree"]
    if trees.rows is not None:
        return _forest_predict(df, trees, carry, keys)
    landed = land(as_inputs(df, trees, carry, keys), trees, per_model)
    if not trees.rule.trees:
        return landed.select(*model, *carry, "y", in_units(trees, F.col("label")).alias("prediction"))
    classifier = F.col("target").isin([t for t in trees.targets if trees.roles.is_categorical(t)])
    each = F.when(classifier, F.arrays_zip("classes", "counts")).otherwise(F.array(F.struct(F.lit(0.0).alias("classes"), F.lit(1).cast("long").alias("counts"))))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    votes = landed.select(*model, *carry, "y", "label", F.when(classifier, total).otherwise(1).alias("_n"), F.inline(each))
    share = F.floor(F.col("counts") / F.col("_n") * F.lit(2.0**40)).cast("long")
    votes = votes.groupBy(*model, *carry, "y", "classes").agg(F.sum(share).alias("votes"), F.avg("label").alias("label"))
    best = F.max(F.struct("votes", (-F.col("classes")).alias("c"), "label")).alias("best")
    value = F.when(classifier, -F.col("best.c")).otherwise(in_units(trees, F.col("best.label")))
    return votes.groupBy(*model, *carry, "y").agg(best).select(*model, *carry, "y", value.alias("prediction"))


def add_prediction(df: DataFrame, trees: Trees) -> DataFrame:
    """``df`` with the ``prediction`` of the trees of one target."""
    names = {c: f"_c{k}" for k, c in enumerate(df.columns)}
    if trees.rule.trees:  # votes are added up by row, so rows need a number that stays
        df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    own = [q(c).alias(n) for c, n in names.items()]
    plain = df.select("*", *own)
    carry = [*(["_row"] if trees.rule.trees else []), *names.values()]
    found = predict(plain, trees, df.count(), carry)
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], "prediction")


# ---------------------------------------------------------------- Shapley values


def leaf_boxes(nodes: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the leaves in ``nodes``, and as arrays over the features their box ``low < x <= high`` and, for rows that are sent
    left or right by chance, the share that follows the leaf's path at the splits on each feature.

    ``nodes`` holds leaves of one tree and all nodes above them. Boxes are cut level by level, each from the box above.
    """
    paths = nodes.column("node").cast(pa.binary()).combine_chunks()
    depth = pc.binary_length(paths).to_numpy()
    feature = nodes.column("feature").fill_null(-1).to_numpy()
    cut, n = nodes.column("threshold").to_numpy(), nodes.column("n").to_numpy()
    order = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
    found = []
    for d in range(len(starts) - 1):
        at = order[starts[d] : starts[d + 1]]
        own = paths.take(pa.array(at))
        if d:
            up = pc.index_in(pc.binary_slice(own, 0, d - 1), above).to_numpy()
            low, high, share, of = low[up], high[up], share[up], above_at[up]
            right = pc.equal(pc.binary_slice(own, d - 1, d), pa.scalar(b"1", own.type)).to_numpy(zero_copy_only=False)
            f, row = feature[of], np.arange(len(at))
            low[row[right], f[right]] = cut[of[right]]
            high[row[~right], f[~right]] = cut[of[~right]]
            share[row, f] *= n[at] / n[of]
        else:
            low, high, share = np.full((len(at), width), -np.inf), np.full((len(at), width), np.inf), np.ones((len(at), width))
        leaf = feature[at] < 0
        found.append((at[leaf], low[leaf], high[leaf], share[leaf]))
        above, above_at, low, high, share = own.filter(pa.array(~leaf)), at[~leaf], low[~leaf], high[~leaf], share[~leaf]
    if not found:
        return np.zeros(0, np.int64), *(np.zeros((0, width)) for _ in range(3))
    return tuple(np.concatenate(part) for part in zip(*found))


def leaf_values(trees: Trees) -> DataFrame:
    """``(keys…, leaf, code, value)``: the share of each class at a leaf, or its mean with a null code; zeros are left out."""
    leaves = trees.nodes.where("feature IS NULL").withColumnRenamed("node", "leaf")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    shares = leaves.where("classes IS NOT NULL").withColumn("n", total).select(*trees.keys, "leaf", "n", F.inline(F.arrays_zip("classes", "counts")))
    shares = shares.select(*trees.keys, "leaf", F.col("classes").alias("code"), (F.col("counts") / F.col("n")).alias("value"))
    means = leaves.where("classes IS NULL").select(*trees.keys, "leaf", F.lit(None).cast("double").alias("code"), in_units(trees, F.col("label")).alias("value"))
    return shares.union(means)


def shapley_effects(x: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sum over the rows of ``x`` of each feature's Shapley weight for each leaf (leaves x features)."""
    return _weigh((x[:, None, :] > low) & (x[:, None, :] <= high), share)


def _weigh(follows: np.ndarray, share: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The sums of ``shapley_effects`` from what follows a leaf's path (rows x leaves x features), each counted ``times``.

    The product over the features of (share + t * follows) is extended feature by feature, and unwound by each feature in turn.
    Features that are not on a leaf's path have share and follows 1 and change nothing.
    """
    width = follows.shape[2]
    terms = np.zeros((width + 1, *follows.shape[:2]))
    terms[0] = 1.0
    for f in range(width):
        shifted = terms[:-1] * follows[:, :, f]
        terms *= share[:, f]
        terms[1:] += shifted
    weight = [math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) for k in range(width)]
    out = np.empty((len(share), width))
    for f in range(width):
        z, on = share[:, f], follows[:, :, f]
        carried, total_on, total_off = terms[width], 0.0, 0.0
        for k in range(width - 1, -1, -1):
            total_on = total_on + weight[k] * carried
            total_off = total_off + weight[k] * terms[k]
            carried = terms[k] - z * carried
        effect = np.where(on, (1.0 - z) * total_on, -total_off)
        out[:, f] = (effect if times is None else effect * times).sum(0)
    return out


def box_counts(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Number of rows with ``low < x <= high`` on two features, for each box.

    Rows are put in the order of the first feature and split by the bits of the second one's place among its values, so a box is
    a run of rows that is followed bit by bit: work grows with (rows + boxes) x bits, not with their product.
    """
    order = np.argsort(x[:, 0], kind="stable")
    first, last = (np.searchsorted(x[order, 0], v, "right") for v in (low[:, 0], high[:, 0]))
    values, place = np.unique(x[order, 1], return_inverse=True)
    bounds = np.concatenate([np.searchsorted(values, v, "right") for v in (high[:, 1], low[:, 1])])
    first, last = (np.tile(v, 2) for v in (first, np.maximum(first, last)))
    below = np.where(bounds >= len(values), last - first, 0)
    going = np.flatnonzero((bounds < len(values)) & (bounds > 0) & (first < last))
    bounds, first, last = bounds[going], first[going], last[going]
    for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
        one = (place >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        a, b = zeros[first], zeros[last]
        up = (bounds >> bit & 1).astype(bool)
        below[going] += np.where(up, b - a, 0)
        first, last = np.where(up, zeros[-1] + first - a, a), np.where(up, zeros[-1] + last - b, b)
        place = np.concatenate([place[~one], place[one]])
    return np.maximum(below[: len(low)] - below[len(low) :], 0)


def _inside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf the rows with ``low < x <= high`` on one feature as bits (leaves x words), and their number."""
    order = np.argsort(x, kind="stable")
    first, last = (np.searchsorted(x[order], v, "right") for v in (low, high))
    upto = np.zeros((len(x) + 1, -(-len(x) // 64)), np.uint64)
    upto[np.arange(1, len(x) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_or.accumulate(upto, axis=0, out=upto)
    last = np.maximum(first, last)
    return upto[first] ^ upto[last], last - first


def pattern_counts(x: np.ndarray, low: np.ndarray, high: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """How many rows follow exactly the path features of pattern p (bit f: feature f), for each leaf (patterns x leaves).

    ``inside`` is the number of rows in each whole box where it is known. Single features and pairs are counted in sorted rows,
    larger sets by bits of rows and leaves.
    """
    width = x.shape[1]
    counts = np.zeros((1 << width, len(low)), np.int64)
    counts[0] = len(x)
    for f in range(width):
        own = np.sort(x[:, f])
        counts[1 << f] = np.maximum(np.searchsorted(own, high[:, f], "right") - np.searchsorted(own, low[:, f], "right"), 0)
        for g in range(f):
            counts[1 << f | 1 << g] = box_counts(x[:, [f, g]], low[:, [f, g]], high[:, [f, g]])
    for at in range(0, len(x) if width > 3 or width == 3 and inside is None else 0, ROW_BLOCK):
        part = x[at : at + ROW_BLOCK]
        bits = [_inside(part[:, f], low[:, f], high[:, f])[0] for f in range(width)]

        def extend(pattern: int, both: np.ndarray, above: int, size: int) -> None:
            for f in range(above, width):
                more = both & bits[f]  # noqa: B023
                if size > 1:
                    counts[pattern | 1 << f] += np.bitwise_count(more).sum(1, dtype=np.int64)
                extend(pattern | 1 << f, more, f + 1, size + 1)

        for f in range(width - 1):
            extend(1 << f, bits[f], f + 1, 1)
    if inside is not None and width:
        counts[-1] = inside
    for f in range(width):  # from at least these features to exactly these
        by = counts.reshape(-1, 2, 1 << f, len(low))
        by[:, 0] -= by[:, 1]
    return counts


def shapley_totals(x: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """The same as ``shapley_effects`` for many rows: a row's weight depends only on which path features it follows.

    Leaves with the same path features are taken together, and the rows counted by what they follow. Leaves with
    too many features for that, or few of a kind, are met row by row. ``inside`` is the number of rows in each box if it is known;
    it may be a share of them in several calls whose results are added up.
    """
    out = np.zeros(low.shape)
    bounded = np.isfinite(low) | np.isfinite(high)
    kinds, kind = np.unique(bounded, axis=0, return_inverse=True)
    plain = not np.isfinite(x).all()
    for k, own in enumerate(kinds):
        leaves, path = np.flatnonzero(kind.ravel() == k), np.flatnonzero(own)
        if not len(path) and not plain:
            continue
        if plain or len(path) > PATTERN_FEATURES or 1 << len(path) > 16 * len(leaves):
            for at in range(0, len(x), ROWS_AT_ONCE):
                for a in range(0, len(leaves), LEAVES_AT_ONCE):
                    some = leaves[a : a + LEAVES_AT_ONCE]
                    out[some] += shapley_effects(x[at : at + ROWS_AT_ONCE], low[some], high[some], share[some])
            continue
        follows = (np.arange(1 << len(path))[:, None] >> np.arange(len(path)) & 1).astype(bool)
        many = max(LEAVES_AT_ONCE, LEAVES_AT_ONCE << 10 >> len(path))
        for a in range(0, len(leaves), many):
            some = leaves[a : a + many, None]
            counts = pattern_counts(x[:, path], low[some, path], high[some, path], None if inside is None else inside[some[:, 0]])
            for b in range(0, len(some), step := max(1, many >> 4)):
                few = some[b : b + step]
                met = counts[:, b : b + step]
                out[few, path] = _weigh(np.broadcast_to(follows[:, None, :], (*met.shape, len(path))), share[few, path], met)
    return out


#: Rows of one task's meeting, and leaves of the subtrees that meet them; rows whose bits, and leaves whose counts, are held at once;
#: the same row by row.
MOST_ROWS, MOST_LEAVES, ROW_BLOCK, ROWS_AT_ONCE, LEAVES_AT_ONCE = 1 << 20, 1 << 20, 2048, 256, 1024
#: Path features of a leaf up to which its rows are counted by pattern.
PATTERN_FEATURES = 10


def _with_ancestors(trees: Trees, bins: int) -> DataFrame:
    """The leaves and small subtrees of all trees dealt to ``bins``, each bin with the large nodes above them."""
    own = list(trees.keys)
    columns = [*own, "_bin", "node", "feature", "threshold", "n", "label", "classes", "counts"]
    bin_ = F.pmod(F.xxhash64("root"), F.lit(bins)).cast("int").alias("_bin")
    low = trees.nodes.where("root IS NOT NULL")
    if trees.nodes.where("root IS NULL").isEmpty():
        return low.select("*", bin_).select(*columns)
    roots = low.select(*own, "root", bin_).distinct()
    ups = roots.select(*own, "_bin", F.explode(F.sequence(F.lit(0), F.length("root"))).alias("d"), "root").where("d < length(root)")
    ups = ups.select(*own, "_bin", F.expr("left(root, d)").alias("node")).distinct()
    above = trees.nodes.where("root IS NULL").join(ups, [*own, "node"])
    return low.select("*", bin_).select(*columns).unionByName(above.select(*columns))


def shapley_sums(df: DataFrame, trees: Trees, per_model: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, f, code, effect)``: sums over the leaves and the rows of each model of the Shapley weight of a feature at a leaf
    times the leaf's value, which is the share of each class, or its mean with a null code.

    ``df`` must be the rows the trees were grown on: how many lie in a leaf's box is its number of rows. Rows travel packed; every
    block of a model's rows meets every bin of its subtrees, where the boxes are made and the sums are added up.
    """
    own, xs = list(trees.keys), [f"x{j}" for j in range(trees.width)]
    row_blocks = -(-max(per_model, 1) // MOST_ROWS)
    most = trees.nodes.where("feature IS NULL").groupBy(*own).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    bins = -(-most // MOST_LEAVES)
    rows = as_inputs(df, trees, [], keys).select(*own, *xs, F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks)).cast("int").alias("_r"))
    rows = packed(rows, [*own, "_r"], xs).withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    nodes = _with_ancestors(trees, bins).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in own)
    scales = dict(trees.scales)

    def meet(key: tuple, some: pa.Table, there: pa.Table) -> pa.Table:
        width, values = len(xs), dict(zip([*own, "_r"], key))
        at, low, high, share = leaf_boxes(there, width)
        x = unpacked(some, width)
        leaves = there.select(["n", "label", "classes", "counts"]).take(pa.array(at)).combine_chunks()
        inside = leaves.column("n").to_numpy() if values["_r"].as_py() == 0 else np.zeros(len(at), np.int64)
        total = shapley_totals(x, low, high, share, inside)
        lists = leaves.column("counts").combine_chunks()
        if len(at) and lists.null_count == 0:
            of = np.repeat(np.arange(len(at)), pc.list_value_length(lists).to_numpy())
            count = lists.flatten().to_numpy()
            worth = count / np.bincount(of, count, len(at))[of]
            codes, place = np.unique(leaves.column("classes").combine_chunks().flatten().to_numpy(), return_inverse=True)
            sums = np.array([np.bincount(place, total[of, f] * worth, len(codes)) for f in range(width)])
            code = pa.array(np.tile(codes, width), pa.float64())
        else:
            middle, unit = scales.get(values["target"].as_py(), (0.0, 1.0))
            sums = ((middle + unit * leaves.column("label").to_numpy()) @ total).reshape(width, 1)
            code = pa.nulls(width, pa.float64())
        rows_ = sums.size
        columns = [pa.array([values[k].as_py()] * rows_, values[k].type) for k in own]
        f = pa.array(np.repeat(np.arange(width, dtype=np.int32), sums.shape[1]))
        return pa.table([*columns, f, code, pa.array(sums.ravel())], [*own, "f", "code", "effect"])

    group = [*own, "_r", "_bin"]
    met = deal(rows, *group).groupBy(*group).cogroup(deal(nodes, *group).groupBy(*group)).applyInArrow(meet, f"{schema}, f int, code double, effect double")
    return met.groupBy(*own, "f", "code").agg(F.sum("effect").alias("effect"))
