"""Prefix trie, whitening and SimHash against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablekin.llm import prefix_trie, simhash, whitening
from tablekin.llm.common import group_starts

TURNS = "conv_id long, turn long, role string, text string, depth string, id int"
SF = Path("/root/testdata/sf0.001")


# prefix trie


def trie_of(rows):
    """Nodes of the trie by plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for turns in own.values():
        turns.sort(key=lambda t: t[:3])
    said = {c: [t[3:] for t in turns] for c, turns in own.items()}
    built = {}
    for c, turns in said.items():
        skip = zlib.crc32(str(c).encode()) % 9
        built[c] = said.get(c - int(math.fmod(c, 5)), [])[:skip] + turns[skip:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        cost = (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += cost
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), len(kids[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path)).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def nodes_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(names).collect())


def conversations():
    draw = random.Random(11)
    said = lambda: draw.choice(["yes", "no", "é ß", "", None, "long " * 40])
    rows = [(c, t, draw.choice(["user", None, ""]), said()) for c in range(40) for t in range(draw.randint(1, 12))]
    rows += [(c, t, "user", f"turn {t}") for c in (100, 101, 105, 110, 111) for t in range(60)]  # a chain shared by copies
    rows += [(c, None, "user", said()) for c in (3, 3, 7, 200)] + [(c, 1, "user", "tie") for c in (3, 3, 7)]
    rows += [(None, 0, "user", "no conversation"), (-3, 0, "user", "below zero"), (-7, 2, "user", "x"), (300, 0, "user", "y" * 3_000_000)]
    rows += rows[:4]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_equals_brute_force(spark, parts):
    rows = conversations()
    assert nodes_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(parts))) == trie_of(rows)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = spark.createDataFrame([(None, 1, "user", "x", "", 1)], TURNS)
    assert prefix_trie.prefix_trie(alone).count() == 0


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    conv = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(conv, 0, "user", "gone", "", 1)]
    assert nodes_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == trie_of(rows)


def test_long_chain_contracts_in_few_rounds(spark):
    n = 3000
    tree = spark.range(n).select(
        F.lit(0).cast("long").alias("conv"), F.col("id").alias("depth"), F.when(F.col("id") > 0, 0).cast("long").alias("up_conv"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("up_depth"), (F.col("id") < n - 1).cast("long").alias("kids"),
        F.lit(1).cast("long").alias("saved"), (F.col("id") == n - 1).cast("long").alias("leaves"),
    )
    rounds = []
    made = prefix_trie.materialize
    prefix_trie.materialize = lambda df, label="": rounds.append(label) or made(df, label)
    try:
        found = prefix_trie.subtree_totals(tree).collect()
    finally:
        prefix_trie.materialize = made
    assert sorted((r["depth"], r["saved"], r["leaves"]) for r in found) == [(d, n - d, 1) for d in range(n)]
    assert rounds.count("round") <= 2 * math.ceil(math.log2(n)) + 2


def test_member_lists_over_several_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 2)
    rows = [(c, 0, "user", "same", "", 1) for c in (-9, 0, 5, 10, 15, 20, 25, 1000)]
    assert nodes_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == trie_of(rows)


# whitening

VECTORS = "vec_id long, embedding array<float>, label int, component string, n int"


def vectors(width=7, n=60):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(n, width)) @ np.diag(np.linspace(3, 0.5, width)) @ rng.normal(size=(width, width))
    return [(k // 2 if k < 6 else k, [float(np.float32(v)) for v in row], 1, "x", 2) for k, row in enumerate(mixed)]


def plain_whitening(rows, wanted):
    x = np.floor(np.array([r[1] for r in rows]) * 64).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), centred @ directions[:, :wanted] / np.sqrt(values[:wanted]), values[:wanted] / values.sum()


def test_whitening_equals_dense_eigenvectors(spark):
    rows = vectors()
    odd = [(90, None, 1, "x", 2), (91, [None] + [0.0] * 6, 1, "x", 2), (92, [math.nan] * 7, 1, "x", 2), (93, [math.inf] * 7, 1, "x", 2), (94, [1.0], 1, "x", 2), (95, [3e38] * 7, 1, "x", 2)]
    found = whitening.whiten(spark.createDataFrame(rows + odd + [(None, rows[0][1], 1, "x", 2)], VECTORS).repartition(3)).toPandas()
    rows = rows + [rows[0]]
    n, deviation, whitened, share = plain_whitening(rows, 7)
    assert len(found) == 7 * n and found["n"].eq(n).all()
    assert sorted(found[found.component == 1].deviation) == sorted(deviation)
    for k in range(7):
        got = np.sort(found[found.component == k + 1].whitened)
        want = whitened[:, k]
        assert min(np.abs(got - np.sort(want)).max(), np.abs(got - np.sort(-want)).max()) < 1e-9
    np.testing.assert_allclose(found.groupby("component").explained.first(), share, rtol=1e-10)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    same = [(k, [1.0, 2.0], 1, "x", 2) for k in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, VECTORS)).count() == 0
    line = [(k, [k / 4, 5.0, k / 2], 1, "x", 2) for k in range(5)]  # one dimension of variance
    found = whitening.whiten(spark.createDataFrame(line, VECTORS)).toPandas()
    assert found.component.eq(1).all() and len(found) == 5 and abs(found.explained[0] - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, "x", 2)], VECTORS)).count() == 0


def test_deviation_is_exact_beyond_doubles():
    sums = [3 * 10**12 + 1, 7]
    middle = whitening.Centre(1_000_003, sums)
    x = np.array([[3_000_000, 5], [2**40, -5]])
    want = [sum((1_000_003 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert middle.deviations(x).to_pylist() == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("width, wanted, spectrum", [(200, 32, "near"), (90, 32, "gaps"), (40, 32, "equal"), (60, 5, "low")])
def test_solver_reaches_double_precision(width, wanted, spectrum):
    rng = np.random.default_rng(width)
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    values = {"near": 1 + rng.random(width) / 50, "gaps": 2.0 ** -np.arange(width), "equal": np.ones(width), "low": np.r_[np.arange(1, 5), np.zeros(width - 4)]}[spectrum]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, directions = whitening.leading_pairs(lambda b: matrix @ b, width, wanted)
    np.testing.assert_allclose(found, np.sort(values)[::-1][:wanted], atol=1e-12 * values.max())
    assert np.abs(matrix @ directions - directions * found).max() < 1e-12 * values.max()
    assert np.abs(directions.T @ directions - np.eye(wanted)).max() < 1e-12


# SimHash

DOCS = "doc_id long, text string, fp string, first int, n string"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints):
    """Least member that each fingerprint reaches by links."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    marks = np.array(prints, np.uint64)
    for k, p in enumerate(prints):
        for other in k + 1 + np.flatnonzero(np.bitwise_count(marks[k + 1 :] ^ marks[k]) <= 3):
            a, b = find(p), find(prints[other])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def texts():
    draw = random.Random(8)
    base = [draw.choice(["alpha", "beta", "Gamma", "délta", "x"]) + str(draw.randint(0, 400)) for _ in range(300)]
    out = [None, "", " \n", "one", "ONE", "two words", "a b c", "A  b\tc", "w " * 50_000]
    for k in range(40):
        words = list(base)
        words[draw.randrange(300)] = f"new{k}"
        out.append(" ".join(words))
    out += [" ".join(base)] * 5 + [" ".join(draw.choices(base, k=draw.randint(1, 60))) for _ in range(40)]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_simhash_equals_brute_force(spark, hot, monkeypatch):
    if hot:  # every list longer than three is spread before the shuffle
        monkeypatch.setattr(simhash, "LONG", 3)
        monkeypatch.setattr(simhash, "HOT_LISTS", 1 << 20)
    rows = list(enumerate(texts())) + [(None, "one"), (None, "only here and nowhere else at all"), (3, "one"), (4, "another text under an id used before")]
    found = simhash.near_duplicate_groups(spark.createDataFrame([(*r, "clash", 1, "c") for r in rows], DOCS).repartition(4)).collect()
    prints = [fingerprint(t) for _, t in rows]
    root = classes_of(set(prints))
    least = defaultdict(list)
    for (k, _), p in zip(rows, prints):
        least[root[p]] += [] if k is None else [k]
    want = [(k, f"{p:016x}", min(least[root[p]], default=None)) for (k, _), p in zip(rows, prints)]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


def test_simhash_of_no_documents(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_pieces_of_a_text_give_the_same_fingerprint(monkeypatch):
    long = " ".join(random.Random(2).choices(["a", "Bb", "cé"], k=999))
    monkeypatch.setattr(simhash, "PIECE", 17)
    monkeypatch.setattr(simhash, "HASHES", 5)
    assert [int(v) for v in simhash._majority(iter([long.encode(), b"", b"a b"]), 3)] == [fingerprint(long), 0, fingerprint("a b")]


def _close(n, far, rng):
    out = set()
    while len(out) < n:
        out.add(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, far), replace=False)))
    return out


@pytest.mark.parametrize("long, spread", [(2048, False), (16, False), (16, True)])
def test_lists_lose_no_link(long, spread, monkeypatch):
    """Pair tallies, lists of five bytes and neighbour look-ups give the same classes as all pairs."""
    rng = np.random.default_rng(9)
    prints = {int(v) for v in rng.integers(0, 2**63, 300)} | _close(900, 6, rng)
    monkeypatch.setattr(simhash, "LONG", long)
    rows = np.zeros(len(prints), simhash.ENTRY)
    rows["fp"] = sorted(prints)
    keys, n = np.unique(simhash._list_keys(rows["fp"]), return_counts=True)
    listed = simhash._index(rows, keys[n > 30] if spread else keys[:0])
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    sent = 0
    for found in simhash._forest(listed):
        for a, b in found["fp"].tolist():
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        sent += len(found)
    assert {p: find(p) for p in prints} == classes_of(prints)
    assert sent < len(listed) * (10 if long == 16 else 1)
    assert len(group_starts(np.sort(listed, order="key"), ("key",))) <= len(listed)
