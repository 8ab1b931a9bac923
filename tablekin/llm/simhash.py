"""SimHash near-duplicates by an inverted index of fingerprint bytes with count filtering.

Fingerprints of 64 bits that differ in at most ``DIFFER`` bits share at least ``SHARED`` of their eight positional bytes, three
of them in one half. The index lists a fingerprint under each three bytes of a half (eight lists). Pairs of a list get the tally
of positional bytes they share; those that reach the guaranteed minimum are verified bit by bit. A list leaves a forest of its
verified links, never all its pairs, and the links of all lists are brought together by star contraction.

Long lists are those of large groups of near copies. They are listed again under two more shared bytes: in their task, or, for
the at most 2^15 longest ones, before the shuffle, so that they spread over tasks. Five bytes leave 2^24 different fingerprints
at most; such a list is searched pair by pair or, when that is cheaper, through all neighbours of each of its fingerprints.
Documents of one fingerprint are one entry of the index.

Nulls, ties and odd tables: null and empty texts have no words and fingerprint zero, which links like any other; texts of fewer
words than a shingle have one; a bit set in exactly half of the hashes is zero. Texts are read in pieces, so one may be of any
length. Rows with equal or null doc_id stay rows of their own; a component's id is its smallest id that isn't null, and null if
it has none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import HOT_SHARE, PACKED, group_starts, mix64, pack_rows, shuffle_width, slices, text_bytes
from tablekin.llm.components import connected_components
from tablekin.session import materialize

WORDS, SEED, BYTES = 3, 42, 8
DIFFER = 3
SHARED = BYTES - DIFFER
#: Bytes of text and number of hashes that are in work at once.
PIECE, HASHES = 1 << 22, 1 << 17
#: Fingerprints of a list up to which all its pairs are tallied, entries of one bucket, and lists known to all tasks.
LONG, BUCKET, HOT_LISTS = 2048, 1 << 20, 1 << 15

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The positions of the bytes of each list: three of a half.
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
ENTRY = np.dtype([("key", "<u8"), ("fp", "<u8"), ("first", "<i8"), ("none", "?")])
NODE = "struct<none: boolean, first: bigint, fp: bigint>"


def _shingles(text: bytes) -> Iterator[list[int]]:
    """Hashes of all shingles of a text, in pieces."""
    at, tail, any_yet = 0, [], False
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = tail + text[at:end].lower().split()
        at = end
        if len(words) >= WORDS:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[: -WORDS] + 1)) if len(words) > WORDS else np.zeros(1, np.int64)
            yield [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1 :].tolist())]
            any_yet = True
            words = words[1 - WORDS :]
        tail = words
    if tail and not any_yet:
        yield [xxhash.xxh64_intdigest(b" ".join(tail), SEED)]


def _majority(texts: Iterator[bytes], rows: int) -> np.ndarray:
    """Fingerprint of each text."""
    counts, sizes = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, BYTES), axis=1)
            first = np.cumsum([0, *[n for _, n in owners[:-1]]])
            np.add.at(counts, [k for k, _ in owners], np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        hashes.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for piece in _shingles(text):
            for at in range(0, len(piece), HASHES):
                part = piece[at : at + HASHES]
                hashes.extend(part)
                owners.append((k, len(part)))
                sizes[k] += len(part)
                if len(hashes) >= HASHES:
                    flush()
    flush()
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            found = _majority(text_bytes(batch.column("text")), batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fp long")


def _bytes_at(fp: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    key = np.zeros(len(fp), np.uint64)
    for p in positions:
        key = (key << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255))
    return key


def _list_keys(fp: np.ndarray) -> np.ndarray:
    """The key of each fingerprint in each of the eight lists of three bytes, one row a list."""
    return np.stack([(np.uint64(k) << np.uint64(24)) | _bytes_at(fp, c) for k, c in enumerate(TRIPLES)])


def _longer(entries: np.ndarray, triple: int) -> np.ndarray:
    """Entries of lists of three bytes listed under every two more bytes; the key names the five positions."""
    out = []
    for more in combinations([p for p in range(BYTES) if p not in TRIPLES[triple]], SHARED - 3):
        positions = tuple(sorted(TRIPLES[triple] + more))
        listed = entries.copy()
        listed["key"] = np.uint64(sum(1 << p for p in positions) << 40) | _bytes_at(entries["fp"], positions)
        out.append(listed)
    return np.concatenate(out)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``root`` points at the least member of each set."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of zero bytes of each exclusive or: the positional bytes that a pair shares."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return BYTES - np.bitwise_count(((x & low) + low | x) & ~low)


def _tally(rows: np.ndarray, starts: np.ndarray, root: np.ndarray) -> None:
    """Link entries of the same list, all pairs of each, by the distance of their places in it."""
    size = np.diff(np.append(starts, len(rows)))
    ends = np.repeat(starts + size, size)
    fp, at = rows["fp"], np.arange(len(rows))
    for shift in range(1, int(size.max(initial=1))):
        at = at[at + shift < ends[at]]
        x = fp[at] ^ fp[at + shift]
        kept = shared_bytes(x) >= SHARED
        kept[kept] = np.bitwise_count(x[kept]) <= DIFFER
        if kept.any():
            _unite(root, at[kept], at[kept] + shift)


def _neighbours(rows: np.ndarray, root: np.ndarray) -> None:
    """Link entries of one list of five shared bytes: every fingerprint looks up all that differ in few of the other bits."""
    mask = int(rows["key"][0]) >> 40
    rest = tuple(p for p in range(BYTES) if not mask >> p & 1)
    value = _bytes_at(rows["fp"], rest)
    place = np.full(1 << 8 * len(rest), -1, np.int32)
    place[value] = np.arange(len(rows))
    for n in range(1, DIFFER + 1):
        for flip in combinations(range(8 * len(rest)), n):
            other = place[value ^ np.uint64(sum(1 << b for b in flip))]
            at = np.flatnonzero(other > np.arange(len(rows)))
            _unite(root, at, other[at])


def _forest(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of entries that link all linked entries of each list; ``rows`` are whole lists."""
    rows = rows[np.lexsort((rows["fp"], rows["key"]))]
    starts = group_starts(rows, ("key",))
    size = np.diff(np.append(starts, len(rows)))
    level = np.where((size > 1) & (size <= LONG), np.ceil(np.log2(size)), 0)  # lists of like sizes together
    for turn in np.unique(level[level > 0]):
        some = rows[np.repeat(level == turn, size)]
        root = np.arange(len(some))
        _tally(some, group_starts(some, ("key",)), root)
        at = np.flatnonzero(root != np.arange(len(some)))
        yield np.stack([some[at], some[root[at]]], axis=1)
    for k in np.flatnonzero(size > LONG):
        some = rows[starts[k] : starts[k] + size[k]]
        if int(some["key"][0]) >> 40:
            root = np.arange(len(some))
            _neighbours(some, root)
            at = np.flatnonzero(root != np.arange(len(some)))
            yield np.stack([some[at], some[root[at]]], axis=1)
        else:
            yield from _forest(_longer(some, int(some["key"][0]) >> 24))


def _frequent(classes: DataFrame, n: int) -> np.ndarray:
    """Keys of the lists so long that they must be spread before the shuffle, at most HOT_LISTS of them, sorted."""
    most = max(LONG, -(-len(TRIPLES) * n // HOT_LISTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            keys, times = np.unique(_list_keys(fp), return_counts=True)
            yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], ["key", "n"])

    counted = classes.select("fp").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["key"] for r in counted.filter(F.col("n") > most).select("key").collect()), np.uint64)


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.zeros(batch.num_rows, ENTRY)
    rows["fp"] = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
    first = batch.column("first")
    rows["none"] = first.is_null().to_numpy(zero_copy_only=False)
    rows["first"] = first.fill_null(0).to_numpy(zero_copy_only=False)
    return rows


def _index(rows: np.ndarray, hot: np.ndarray) -> np.ndarray:
    out = []
    for k, keys in enumerate(_list_keys(rows["fp"])):
        listed = rows.copy()
        listed["key"] = keys
        often = np.isin(keys, hot)
        out += [listed[~often], _longer(listed[often], k)]
    return np.unique(np.concatenate(out))


def links(classes: DataFrame) -> DataFrame:
    """(u, v): links that join all fingerprints of ``classes`` (fp, first) that are linked, a forest for each list."""
    n = classes.count()
    hot = _frequent(classes, n)
    shared = classes.sparkSession.sparkContext.broadcast(hot)
    buckets = max(shuffle_width(classes), -(-len(TRIPLES) * n // BUCKET))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            rows = _index(_entries(batch), shared.value)
            yield pack_rows((mix64(rows["key"]) % np.uint64(buckets)).astype(np.int64), rows, buckets)

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for found in _forest(rows):
            pairs = np.unique(found[["fp", "first", "none"]], axis=0) if len(found) else found
            ends = [
                pa.StructArray.from_arrays(
                    [
                        pa.array(pairs["none"][:, s]),
                        pa.array(pairs["first"][:, s].copy(), mask=pairs["none"][:, s].copy()),
                        pa.array(pairs["fp"][:, s].copy().view(np.int64)),
                    ],
                    ["none", "first", "fp"],
                )
                for s in (0, 1)
            ]
            yield pa.record_batch(ends, ["u", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
                if bucket != now and parts:
                    yield from linked(np.concatenate(parts))
                    parts = []
                now = bucket
                parts.append(np.frombuffer(payload, ENTRY))
        if parts:
            yield from linked(np.concatenate(parts))

    dealt = classes.select("fp", "first").mapInArrow(spread, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, f"u {NODE}, v {NODE}")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable by links) of every row."""
    marked = materialize(fingerprints(docs), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    found = connected_components(links(classes))
    # a component's root is the node with the least id, so the id comes with it
    node = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    roots = found.select(F.col("u").alias("node"), F.col("root.first").alias("least"), F.lit(True).alias("moved"))
    least = F.when(F.col("moved"), F.col("least")).otherwise(F.col("first"))
    classes = classes.withColumn("node", node).join(roots, "node", "left").select("fp", least.alias("component_id"), "n")
    classes = materialize(classes, "components")
    often = classes.filter(F.col("n") * HOT_SHARE >= marked.count()).drop("n")  # at most HOT_SHARE rows
    rest = classes.join(F.broadcast(often.select("fp")), "fp", "left_anti").drop("n")
    common = marked.join(F.broadcast(often), "fp")
    others = marked.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(rest, "fp")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return common.unionByName(others).select("doc_id", digits.alias("fingerprint"), "component_id")
