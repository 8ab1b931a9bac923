"""Conversation prefix trie with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Rounds of joins contract the tree: leaves are raked into their parents, and of
every unary chain nodes are spliced out that are not adjacent, by a bit of their depth, so that a chain halves each round.
The spliced nodes are then put back in reverse order, each with the total of the node below it.

Rows of a conversation are numbered over range partitions, so a conversation may hold any share of all rows; sequences are
identified by 128 bits (exclusive ors of hashes of position and turn), so that no task needs a whole conversation.

Nulls, ties and odd tables: rows without conv_id belong to no conversation and are ignored; null role or text is the empty
one; turns sort null first, equal ones by the digest of role and text, copies of a row are turns of their own. Texts of any
length are met as digest and length only. An empty table has no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekin.session import materialize

#: The part number of a row number (bits above those that count rows of a part), and that of the turns taken over.
PART, TAKEN = 33, -1
#: Rounds that tell neighbours of a chain apart by a bit of the depth; later ones do so by a hash.
DEPTH_BITS = 24
#: Ids of one slice of a member list: 2^12 at most.
SLICE = 12


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, digest, n_bytes): numbers rise along each conversation, without gaps inside a part of the table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.select("conv_id", F.monotonically_increasing_id().alias("no"), "digest", "n_bytes"), "turns")


def _conversations(runs: DataFrame, modulus: int, most: int) -> DataFrame:
    """(conv_id, base, skip, taken, length): how each conversation is rebuilt from the first turns of another."""
    own = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % modulus).alias("base"), skip.alias("skip"))
    other = own.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least("skip", F.coalesce("there", F.lit(0)))
    both = own.join(other, "base", "left").withColumn("taken", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))
    return materialize(both.select("conv_id", "base", "skip", "taken", length.alias("length")), "conversations")


def rebuild(conversations: DataFrame, modulus: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, run, pos, digest, n_bytes, last) and the conversations they belong to.

    Conversation c takes the first ``skip = crc32(c) % most`` turns of c - c % modulus in place of its own.
    """
    turns = _turns(conversations).withColumn("run", F.shiftright("no", PART))
    runs = turns.groupBy("conv_id", "run").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    runs = materialize(runs.select("conv_id", "run", start.alias("start"), "n"), "runs")
    convs = _conversations(runs, modulus, most)
    # a run is a conversation's part of one partition, so no key of this join has more rows than a partition
    placed = turns.join(runs.drop("n"), ["conv_id", "run"]).withColumn("at", F.col("no") + F.col("start"))
    own = placed.join(runs.join(convs, "conv_id").select("conv_id", "run", "skip", "taken", "length"), ["conv_id", "run"]).filter("at > skip")
    own = own.select("conv_id", "run", (F.col("at") - F.col("skip") + F.col("taken")).alias("pos"), "digest", "n_bytes", "length")
    head = placed.filter(F.col("at") < most).select(F.col("conv_id").alias("base"), "at", "digest", "n_bytes")
    taken = head.join(convs.filter("taken > 0"), "base").filter("at <= taken")
    taken = taken.select("conv_id", F.lit(TAKEN).cast("long").alias("run"), F.col("at").alias("pos"), "digest", "n_bytes", "length")
    both = own.withColumn("run", F.col("run").cast("long")).union(taken)
    return both.select("conv_id", "run", "pos", "digest", "n_bytes", (F.col("pos") == F.col("length")).alias("last")), convs


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, id, up, n_bytes, last): the sequence up to each turn and the one without the turn."""
    marks = {"a": F.xxhash64("pos", "digest"), "b": F.xxhash64("digest", "pos", F.lit(7))}
    turns = materialize(turns.withColumns(marks).drop("digest"), "marks")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = turns.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    runs = runs.select("conv_id", "run", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}0") for x in "ab"])
    upto = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    done = turns.withColumns({f"{x}1": F.bit_xor(x).over(upto) for x in "ab"}).join(runs, ["conv_id", "run"])
    here = [F.col(f"{x}0").bitwiseXOR(F.col(f"{x}1")) for x in "ab"]
    return materialize(
        done.select(
            "conv_id",
            F.col("pos").alias("depth"),
            _name(F.col("pos"), *here).alias("id"),
            _name(F.col("pos") - 1, *[h.bitwiseXOR(F.col(x)) for h, x in zip(here, "ab")]).alias("up"),
            "n_bytes",
            "last",
        ),
        "prefixes",
    )


def _name(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, a, b)))


def _root() -> Column:
    return _name(F.lit(0), F.lit(0), F.lit(0))


def _ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ids of conversations that end at a node, ascending and joined by commas.

    Ids are joined in slices of the id range, 2^SLICE ids at most; a task streams a node's slices in order through the hash,
    so it never holds a node's members.
    """
    ends = steps.filter("last").select("id", "conv_id").union(convs.filter("length = 0").select(_root().alias("id"), "conv_id"))
    part = ends.groupBy("id", F.shiftright("conv_id", SLICE).alias("slice")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    part = part.select("id", "slice", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names, sums = [], []
            for node, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    names.append(now)
                    sums.append(state.hexdigest())
                now, state = node, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(sums, pa.string())], ["id", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    return part.repartition("id").sortWithinPartitions("id", "slice").mapInArrow(digest, "id binary, ends_sha256 string")


def _coin(conv: str, depth: str, turn: int) -> Column:
    if turn < DEPTH_BITS:
        return F.shiftright(depth, turn).bitwiseAND(F.lit(1)) == 1
    return F.xxhash64(conv, depth, F.lit(turn)).bitwiseAND(F.lit(1)) == 1


SUMS = ("saved", "leaves")
STATE = ["conv", "depth", "up_conv", "up_depth", "kids", *SUMS, *[f"pass_{s}" for s in SUMS]]


def _contract(live: DataFrame, turn: int) -> DataFrame:
    """One round: leaves go into their parents, then single nodes of unary chains are spliced out (``spliced``).

    A node passes its own total and ``pass_*`` to its parent. Spliced rows name the node below and what to add to its total.
    """
    leaf = F.col("kids") == 0
    below = live.filter("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth"))
    below = below.agg(
        F.count_if(leaf).alias("raked"),
        *[F.coalesce(F.sum(F.when(leaf, F.col(s) + F.col(f"pass_{s}"))), F.lit(0)).alias(f"from_{s}") for s in SUMS],
        *[F.sum(F.when(~leaf, F.col(f"pass_{s}"))).alias(f"below_{s}") for s in SUMS],
        *[F.min(F.when(~leaf, F.col(x))).alias(f"below_{x}") for x in ("conv", "depth", "kids")],
    )
    rows = live.filter(~leaf).join(below, ["conv", "depth"])
    chain = (F.col("kids") == 1) & (F.col("raked") == 0) & F.col("up_conv").isNotNull()
    spliced = chain & _coin("conv", "depth", turn) & ((F.col("below_kids") > 1) | ~_coin("below_conv", "below_depth", turn))
    rows = rows.withColumns(
        {"spliced": spliced, "kids": F.col("kids") - F.col("raked"), **{s: F.col(s) + F.col(f"from_{s}") for s in SUMS}}
    ).select(*STATE, "spliced", "below_conv", "below_depth", *[(F.col(s) + F.col(f"below_{s}")).alias(f"add_{s}") for s in SUMS])
    moved = rows.filter("spliced").select(
        F.col("below_conv").alias("conv"),
        F.col("below_depth").alias("depth"),
        F.col("up_conv").alias("to_conv"),
        F.col("up_depth").alias("to_depth"),
        *[(F.col(f"add_{s}") + F.col(f"pass_{s}")).alias(f"to_{s}") for s in SUMS],
    )
    return rows.join(moved, ["conv", "depth"], "left").select(
        "conv",
        "depth",
        *[F.coalesce(f"to_{x}", f"up_{x}").alias(f"up_{x}") for x in ("conv", "depth")],
        "kids",
        *SUMS,
        *[F.coalesce(f"to_{s}", f"pass_{s}").alias(f"pass_{s}") for s in SUMS],
        "spliced",
        "below_conv",
        "below_depth",
        *[f"add_{s}" for s in SUMS],
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(conv, depth, saved, leaves) summed over each node's subtree.

    ``tree`` has conv and depth (the node), up_conv and up_depth (its parent, null at the root), kids, saved and leaves.
    Every round is written to the shared folder; the number of rounds grows with the logarithm of the nodes.
    """
    first = tree.select(*STATE[:7], *[F.lit(0).cast("long").alias(x) for x in STATE[7:]])
    extra = {"spliced": F.lit(False), **{x: F.lit(None).cast("long") for x in ("below_conv", "below_depth", "add_saved", "add_leaves")}}
    rounds = [materialize(first.withColumns(extra), "round")]
    spliced = [0]
    while True:
        live = rounds[-1].filter("NOT spliced").select(*STATE)
        if not live.filter("kids > 0").head(1):
            break
        rounds.append(materialize(_contract(live, len(rounds) - 1), "round"))
    key = ["conv", "depth"]
    done = [x.filter("NOT spliced AND kids = 0").select(*key, *SUMS) for x in rounds]
    totals = done[0]
    for more in done[1:]:
        totals = totals.union(more)
    totals = materialize(totals, "totals")
    for back in reversed(rounds[1:]):
        out = back.filter("spliced")
        if not out.head(1):
            continue
        below = totals.select(F.col("conv").alias("below_conv"), F.col("depth").alias("below_depth"), *SUMS)
        found = out.select(*key, "below_conv", "below_depth", "add_saved", "add_leaves").join(below, ["below_conv", "below_depth"])
        totals = totals.union(materialize(found.select(*key, *[(F.col(s) + F.col(f"add_{s}")).alias(s) for s in SUMS]), "totals"))
    return totals


def prefix_trie(conversations: DataFrame, modulus: int = 5, most: int = 9) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the textless root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns, convs = rebuild(conversations, modulus, most)
    steps = _prefixes(turns)
    nodes = steps.groupBy("id", "up", "depth", "n_bytes").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    top = convs.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    top = top.select(_root().alias("id"), none.alias("up"), zero.alias("depth"), zero.alias("n_bytes"), "conv", "n_convs")
    nodes = materialize(nodes.unionByName(top), "nodes")
    # children of one node are many rows on one side of this join; such a side is split at run time
    up = nodes.select(F.col("id").alias("up"), F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth"))
    kids = nodes.groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    tree = nodes.join(up, "up", "left").join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    tree = tree.withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_bytes"), "leaves": (F.col("kids") == 0).cast("long")})
    tree = materialize(tree.select("id", "n_convs", "conv", "depth", "up_conv", "up_depth", "kids", *SUMS), "tree")
    totals = subtree_totals(tree)
    found = tree.drop(*SUMS).join(totals, ["conv", "depth"]).join(_ends(steps, convs), "id", "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("up_conv").alias("parent_conv_id"),
        "n_convs",
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
