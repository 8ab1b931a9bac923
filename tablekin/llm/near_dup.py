"""N-gram Jaccard join by a size-aware heavy-light split.

Documents become sets of word shingles; equal sets are one class. The overlap that two sets need follows from their
sizes. Light sets (few shingles) list every subset of the size that a partner of each possible size has to share with
them. Heavy sets, and light ones within reach of a heavy partner, are entered in inverted lists under the shingles of
their prefix, rarest first as far as counted. The boundary between light and heavy is where the cost of both, by the sizes that occur, is
least. Sets that meet under a subset or in a list are routed to blocks of classes, where the inverted lists of the block
are scanned and the overlaps counted exactly. Linked classes form components.

Every set is sent to the blocks in which it may have a later partner (by block, then digest), never paired with each of
them, and a block returns spanning links only. The block of a class is that of the first class it can be linked with in any
of its lists, so near copies mostly share one block and are sent once each; a list with more shingles than a block should
hold is cut into ranges of digests first. The most frequent shingles come last in every prefix (any order gives the same links;
this one keeps lists short); those whose lists would be longer than the number of blocks are not gathered: their sets go
to all later blocks.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component. Texts with fewer words than a shingle have one shingle. Rows with equal sets, repeated rows too, are in one
component. A null ``doc_id`` takes part, but does not name a component unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import ASCII_SPACE, PACKED, group_starts, lean, mix64, own_names, pack_rows, plain_names, shuffle_width, text_bytes, unpack_rows
from tablekin.llm.components import connected_components
from tablekin.llm.shingles import WordHash, shingle_set
from tablekin.session import materialize

#: Shingles that a task holds at a time, and that a block of classes has on average.
CHUNK, BLOCK = 1 << 21, 1 << 20
#: Shingles in the lowest COUNTED of the hash range are counted over all sets (prefixes hardly reach further); of those in
#: at least OFTEN sets, the HOT_MOST most frequent come last in the prefixes' order. This bounds what is broadcast.
COUNTED, OFTEN, HOT_MOST = 0.3, 3, 1 << 19
#: Largest size that the cost model considers light.
LIGHT_MOST = 24
#: Shingles that the members of one list bring to a block, about, and that times the number of these members.
RUN, RUN_WORK = BLOCK // 2, 1 << 28
#: Codes beside the blocks that a class is sent to: all blocks from its own on; from STAYS_IN down, the block that it stays in.
EVERY_BLOCK, STAYS_IN = -1, -2


class Threshold:
    """Jaccard similarity of at least ``percent`` / 100, in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a, b):
        """Shingles that sets of these sizes have to share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def smallest(self, n):
        """Size of the smallest possible partner."""
        return -(-self.percent * n // 100)

    def largest(self, n: int) -> int:
        return 100 * n // self.percent

    def prefix(self, n: int) -> int:
        """Any partner shares one of so many first shingles."""
        return n - self.smallest(n) + 1

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def subsets(self, n: int, boundary: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, subset size) of the subsets that a light set of size n lists."""
        sizes = range(self.smallest(n), min(self.largest(n), boundary) + 1)
        return [(min(n, m), max(n, m), self.overlap(n, m)) for m in sizes]

    def boundary(self, sizes: dict[int, int]) -> int:
        """The size up to which listing subsets is cheaper for all sets together than prefix lists and scans."""
        most = LIGHT_MOST

        def cost(x: int) -> int:
            light = sum(k * sum(comb(n, c) for _, _, c in self.subsets(n, x)) for n, k in sizes.items() if n <= x)
            heavy = sum(k * (self.prefix(n) + n) for n, k in sizes.items() if n >= self.smallest(x + 1))
            return light + heavy

        return min(range(most + 1), key=cost)


def squeeze(values: np.ndarray, less: int) -> bytes:
    """Sorted numbers without their ``less`` lowest bytes; like bytes stand together, as the high ones hardly change."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, less:].T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueeze(raw: bytes, less: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8 - less, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, less:] = planes.T
    return out.view(np.uint64)[:, 0]


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def _short(digests: list[bytes]) -> np.ndarray:
    """First 64 bits, whose order is that of the digests."""
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def block_of(short: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of the digests' order."""
    return ((short >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, dict[bytes, np.ndarray]]]:
    """(doc_id, size, class) of the rows, with the key if there is one, and the sets of their classes, in chunks."""
    hashes, rows, sets, total = WordHash(), [], {}, 0
    for batch in batches:
        carried = [batch.column(c).to_pylist() for c in batch.schema.names if c == "key"]
        for doc, text, *key in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), *carried, strict=True):
            own = shingle_set(text, hashes, size)
            cls = set_digest(own) if len(own) else None
            rows.append((doc, len(own), cls, *key))
            if cls is not None and cls not in sets:
                sets[cls] = own
                total += len(own)
            if total >= CHUNK:
                yield rows, sets
                rows, sets, total = [], {}, 0
    if rows:
        yield rows, sets


SUMMARY = "doc_id long, n long, cls binary, bucket int, payload binary"


def _summary(size: int, buckets: int):
    """A row for each document, and the low shingles of a chunk's sets packed by bucket (the leading five bytes of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _chunks(batches, size):
            doc, n, cls, *key = (list(x) for x in zip(*rows, strict=True))
            top = np.uint64(int(COUNTED * 2**64))
            low = np.concatenate([np.zeros(0, np.uint64), *(s[: np.searchsorted(s, top)] for s in sets.values())])
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((low, bucket))
            low, bounds = low[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            payload = [squeeze(low[bounds[b] : bounds[b + 1]], 3) for b in used]
            rest, lead = [None] * len(used), [None] * len(doc)
            columns = [doc + rest, n + rest, cls + rest, lead + used, lead + payload, *(k + rest for k in key)]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), *(pa.binary() for _ in key)]
            names = ["doc_id", "n", "cls", "bucket", "payload", *("key" for _ in key)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading five bytes of the shingles of a bucket that stand in at least OFTEN sets, and in how many."""
    parts = [unsqueeze(raw, 3) >> np.uint64(24) for batch in batches for raw in batch.column("payload").to_pylist()]
    if parts:
        value, seen = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
        yield pa.record_batch([pa.array(value[seen >= OFTEN]), pa.array(seen[seen >= OFTEN])], ["shingle", "seen"])


def _signatures(shingles: np.ndarray, limit: Threshold, boundary: int, hot: np.ndarray, hot_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subset and prefix signatures of a set, how far on in the prefix each stands (in 255ths of the set, rounded down),
    and the places in the hot list of the prefix's hot shingles, -1 elsewhere."""
    n, out, far, places = len(shingles), [], [], []
    if n <= boundary:
        each = mix64(shingles)
        total = each.sum(dtype=np.uint64)
        for a, b, c in limit.subsets(n, boundary):
            left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
            out.append(mix64((total - each[left_out].sum(1, dtype=np.uint64)) ^ np.uint64((a << 40) + (b << 8) + 1)))
            far.append(np.zeros(len(left_out), np.int64))
            places.append(np.full(len(left_out), -1))
    if n >= limit.smallest(boundary + 1):
        lead = (shingles >> np.uint64(24)).astype(np.int64)
        at = np.minimum(np.searchsorted(hot, lead), max(0, len(hot) - 1))
        place = np.where(hot[at] == lead, hot_place[at], -1) if len(hot) else np.full(n, -1)
        first = np.lexsort((shingles, place))[: limit.prefix(n)]
        out.append(mix64(shingles[first]))
        far.append(np.arange(len(first)) * 255 // n)
        places.append(place[first])
    return np.concatenate(out), np.concatenate(far), np.concatenate(places)


def _enter(size: int, limit: Threshold, boundary: int, hot: np.ndarray, count: np.ndarray, buckets: int, blocks: int):
    """Entries of the lists, packed by bucket; a class of the longest lists goes to every block at once (kind 1)."""
    order = np.argsort(hot)
    values, place = hot[order], order  # hot comes with the rarest first
    gathered = count < 2 * blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _chunks(batches, size):
            short = _short(list(sets))
            signatures, owners, fars, everywhere = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for k, shingles in enumerate(sets.values()):
                own, far, places = _signatures(shingles, limit, boundary, values, place)
                long_ = (places >= 0) & ~gathered[places]
                if long_.any():
                    everywhere.append(k)
                signatures.append(own[~long_])
                fars.append(far[~long_])
                owners.append(np.full(len(signatures[-1]), k))
            sig, owner, far = np.concatenate(signatures), np.concatenate(owners), np.concatenate(fars).astype(np.uint8)
            size_class = np.array([_size_class(len(x)) for x in sets.values()], np.uint8)
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            columns, bounds = (sig[by], short[owner[by]], size_class[owner[by]], far[by]), np.searchsorted(bucket[by], np.arange(buckets + 1))
            used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            payload = [_pack(*(x[bounds[b] : bounds[b + 1]] for x in columns)) for b in used]
            kind = [0] * len(used)
            if everywhere:
                used, payload, kind = [*used, int(short[everywhere[0]] % np.uint64(buckets))], [*payload, short[everywhere].tobytes()], [*kind, 1]
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "kind", "payload"])

    return run


#: Sizes within a factor of STEP fall into one size class.
STEP, LAST_CLASS = 1.05, 255
ENTRY = np.dtype([("sig", "u1", 5), ("owner", "<u8"), ("size", "u1"), ("far", "u1")])
#: Entries with the first owner that theirs can be linked with, and then with their owner's block.
HEADED, PLACED = (np.dtype([*ENTRY.descr, x]) for x in (("head", "<u8"), ("home", "<i4")))


def _size_class(n: int) -> int:
    return min(LAST_CLASS, int(log(n) / log(STEP) + 1e-9))


def _pack(sig: np.ndarray, owner: np.ndarray, size: np.ndarray, far: np.ndarray) -> bytes:
    """Entries of a bucket, with five bytes of each signature (the bucket has more of it)."""
    out = np.empty(len(sig), ENTRY)
    out["sig"] = sig.view(np.uint8).reshape(-1, 8)[:, 3:]
    out["owner"], out["size"], out["far"] = owner, size, far
    return out.tobytes()


class Fit:
    """Whether two entries of a list can belong to similar sets, by their rounded sizes and places.

    The sizes differ by a factor of the threshold at most; and if the list is the first that both sets stand in, what
    follows in either set is at least the needed overlap.
    """

    def __init__(self, percent: int):
        t = percent / 100
        self.apart = int(log(1 / t) / log(STEP)) + 1
        share = t / (1 + t)
        self.far = np.full(2 * self.apart + 1, 255)
        for d in range(-self.apart, self.apart + 1):  # of two entries, the other one's size class is d higher
            ratio = STEP ** (d - 1)  # the other set is at least so many times as large
            self.far[d + self.apart] = int(255 * (1 - share * (1 + ratio)) + 2)

    def __call__(self, size_a, far_a, size_b, far_b):
        d = size_b.astype(np.int64) - size_a
        near = np.abs(d) <= self.apart
        d = np.clip(d, -self.apart, self.apart)
        capped = (size_a == LAST_CLASS) | (size_b == LAST_CLASS)
        fits = near & (far_a <= self.far[d + self.apart]) & (far_b <= self.far[self.apart - d])
        return fits | (capped & (near | (np.minimum(size_a, size_b) + self.apart >= LAST_CLASS)))


ROUTE = np.dtype([("short", "<u8"), ("block", "<i4")])


def _in_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of the lists with two owners and more, by list and owner; where the lists begin, and their sizes."""
    sig = np.zeros((len(entries), 8), np.uint8)
    sig[:, 3:] = entries["sig"]
    sig = sig.view(np.uint64)[:, 0]
    order = np.lexsort((entries["owner"], sig))
    sig, entries = sig[order], entries[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (entries["owner"][1:] != entries["owner"][:-1])
    sig, entries = sig[new], entries[new]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)])
    sizes = np.diff(np.append(starts, len(sig)))
    entries, sizes = entries[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    return entries, np.cumsum(sizes) - sizes, sizes


def _first_fits(entries: np.ndarray, fit: Fit, few: int = 16) -> np.ndarray:
    """Entries of lists with owners that may fit each other, headed by the first fitting owner of the ``few`` first of a run.

    A run is a range of owners in a list, so that a head gathers about RUN shingles of one list at most, and sets that cost
    a block RUN_WORK to scan. Heads only say where sets meet; the links do not depend on them.
    """
    entries, starts, sizes = _in_lists(entries)
    out = np.zeros(len(entries), HEADED)
    for name in ENTRY.names:
        out[name] = entries[name]
    owner, size, far = (np.ascontiguousarray(entries[c]) for c in ("owner", "size", "far"))
    weight = np.add.reduceat(STEP ** size.astype(float), starts) if len(starts) else np.zeros(0)
    bits = np.ceil(np.log2(np.maximum(1, np.maximum(weight / RUN, np.sqrt(weight * sizes / RUN_WORK))))).astype(np.uint64)
    run = np.where(np.repeat(bits, sizes) > 0, owner >> (np.uint64(64) - np.maximum(np.repeat(bits, sizes), np.uint64(1))), np.uint64(0))
    first = np.zeros(len(owner), bool)
    first[starts] = True
    first[1:] |= run[1:] != run[:-1]
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(owner)))
    head, fits_any = owner.copy(), np.repeat((sizes > few) | (bits > 0), sizes)
    for step in reversed(range(few)):  # the first one is the last to be set
        long_ = length > step + 1
        a = np.repeat(begin[long_] + step, length[long_] - step - 1)
        b = a + 1 + _counting(length[long_] - step - 1)
        fits = fit(size[a], far[a], size[b], far[b])
        head[b[fits]] = owner[a[fits]]
        fits_any[a[fits]] = fits_any[b[fits]] = True
    out["head"] = head
    return out[fits_any]


LISTS = "bucket int, kind int, list int, payload binary"


def _lists(rows: list[tuple[int, int, int | None, bytes]]) -> pa.RecordBatch:
    bucket, kind, list_, payload = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(list_, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "kind", "list", "payload"])


def _head(percent: int, buckets: int):
    """Headed entries of a bucket of lists, on their way to their owners; owners of the longest lists (kind 1) pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, own, out = [np.zeros(0, ENTRY)], 0, []
        for batch in batches:
            for bucket, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
                if kind == 1:
                    out.append((bucket, 1, None, raw))
                else:
                    own = bucket
                    entries.append(np.frombuffer(raw, ENTRY))
        headed = pack_rows_of(_first_fits(np.concatenate(entries), Fit(percent)), buckets)
        yield _lists(out + [(b, 0, own, raw) for b, raw in headed])

    return run


def pack_rows_of(rows: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Entries packed by bucket of their owner."""
    packed = pack_rows((rows["owner"] % np.uint64(buckets)).astype(np.int64), rows, buckets)
    return list(zip(*(packed.column(c).to_pylist() for c in ("bucket", "payload")), strict=True))


def _place(blocks: int):
    """Entries of a bucket of owners, back to their lists with the block of the owner's least head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lists, out = [np.zeros(0, HEADED)], [], []
        for batch in batches:
            for bucket, kind, list_, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "list", "payload")), strict=True):
                if kind == 1:
                    out.append((bucket, 1, None, raw))
                else:
                    parts.append(np.frombuffer(raw, HEADED))
                    lists.append(list_)
        sizes, rows = [len(p) for p in parts[1:]], np.concatenate(parts)
        owners, at = np.unique(rows["owner"], return_inverse=True)
        least = np.full(len(owners), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, at, rows["head"])
        placed = np.zeros(len(rows), PLACED)
        for name in ENTRY.names:
            placed[name] = rows[name]
        placed["home"] = block_of(least, blocks)[at]
        ends = np.cumsum(sizes).tolist()
        yield _lists(out + [(b, 0, None, placed[end - n : end].tobytes()) for b, n, end in zip(lists, sizes, ends, strict=True)])

    return run


ROUTE = np.dtype([("short", "<u8"), ("block", "<i4")])


def _meet(percent: int, buckets: int):
    """Routes (class, block) of the classes that stand in one list, on their way to their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, routes = [np.zeros(0, PLACED)], []
        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == 1:
                    owner = np.frombuffer(raw, np.uint64)
                    routes.append((owner, np.full(len(owner), EVERY_BLOCK)))
                else:
                    entries.append(np.frombuffer(raw, PLACED))
        routes += _routes(np.concatenate(entries), Fit(percent))
        rows = np.zeros(sum(len(r[0]) for r in routes), ROUTE)
        rows["short"] = np.concatenate([r[0] for r in routes])
        rows["block"] = np.concatenate([r[1] for r in routes])
        rows = _unique_routes(rows)
        yield pack_rows((rows["short"] % np.uint64(buckets)).astype(np.int64), rows, buckets)

    return run


def _unique_routes(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows["block"], rows["short"]))]
    return rows[group_starts(rows, ("short", "block"))]


def _class_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each class."""
    rows = _unique_routes(unpack_rows(batches, ROUTE))
    starts = group_starts(rows, ("short",))
    blocks = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(np.ascontiguousarray(rows["block"])))
    yield pa.record_batch([pa.array(rows["short"][starts].view(np.int64)), blocks], ["short", "blocks"])


def _routes(entries: np.ndarray, fit: Fit, few: int = 16, rows: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each member of a list goes to the blocks of the later members (by block and owner) that fit it; these stay in their own."""
    entries, starts, sizes = _in_lists(entries)
    order = np.lexsort((entries["owner"], entries["home"], np.repeat(np.arange(len(sizes)), sizes)))
    owner, size, far, block = (entries[c][order] for c in ("owner", "size", "far", "home"))
    out, stay = [], np.zeros(len(owner), bool)

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        fits = fit(size[a], far[a], size[b], far[b])
        out.append((owner[a[fits]], block[b[fits]]))
        stay[b[fits]] = True

    for step in range(1, few):
        own = (sizes > step) & (sizes <= few)
        at = np.repeat(starts[own], sizes[own] - step) + _counting(sizes[own] - step)
        meet(at, at + step)
    for first, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
        later = np.arange(first, first + n)
        heads = np.flatnonzero(np.concatenate(([True], np.diff(block[first : first + n]) > 0)))  # blocks ascend
        for a in range(first, first + n, rows):
            own = later[a - first : a - first + rows]
            fits = fit(size[own][:, None], far[own][:, None], size[later], far[later]) & (own[:, None] < later)
            stay[later[fits.any(0)]] = True
            x, b = np.nonzero(np.logical_or.reduceat(fits, heads, axis=1))
            out.append((owner[own[x]], block[later[heads[b]]]))
    staying, first = np.unique(owner[stay], return_index=True)
    return [*out, (staying, STAYS_IN - block[stay][first])]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _send(size: int, blocks: int):
    """Sets of the candidate classes: one to stay in its block, one for each block that it is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            block, role, cls, sets = [], [], [], []
            for text, want, to in zip(text_bytes(batch.column("text")), batch.column("cls").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                shingles = shingle_set(text, hashes, size)
                if set_digest(shingles) != want:
                    continue  # another text with this id
                least, every = min(to), EVERY_BLOCK in to
                stays = least <= STAYS_IN
                own = STAYS_IN - least if stays else int(block_of(_short([want]), blocks)[0])
                roles = {b: ASKS for b in to if b >= 0}
                if every:
                    roles |= {b: ASKS for b in range(own, blocks)}
                if stays or every:
                    roles[own] = STAYS_AND_ASKS if own in roles else STAYS
                block += roles.keys()
                role += roles.values()
                cls += [want] * len(roles)
                sets += [squeeze(shingles, 2)] * len(roles)
            yield pa.record_batch([pa.array(block, pa.int32()), pa.array(role, pa.int32()), pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["block", "role", "cls", "shingles"])

    return run


STAYS, STAYS_AND_ASKS, ASKS = 0, 1, 2


class Lists:
    """Inverted lists of some sets, by their numbers in the block."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray):
        every = np.concatenate([*(sets[k] for k in numbers), np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(numbers, [len(sets[k]) for k in numbers])[order]
        self.values, self.start = np.unique(every[order], return_index=True)
        self.stop = np.append(self.start[1:], len(every))

    def overlaps(self, shingles: np.ndarray, sets: int) -> np.ndarray:
        """Shingles shared with each set of the block."""
        if not len(self.values):
            return np.zeros(sets, np.int64)
        at = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        at = at[self.values[at] == shingles]
        length = self.stop[at] - self.start[at]
        return np.bincount(self.owner[np.repeat(self.start[at], length) + _counting(length)], minlength=sets)


class Block:
    """Inverted lists of the sets that stay in a block.

    In a block of MANY sets, those linked with a pilot are one group from the start. A set that is linked with the pilot
    then searches the lists of the others only, so a group of near copies does not cost the square of its size.
    """

    MANY, PILOTS = 32, 4

    def __init__(self, limit: Threshold):
        self.limit, self.sets, self.asks, self.every = limit, {}, {}, None

    def add(self, cls: bytes, shingles: np.ndarray, asks: bool) -> None:
        self.sets[cls] = shingles
        if asks:
            self.asks[cls] = shingles

    def close(self) -> list[tuple[bytes, bytes]]:
        """Make the lists; links of the sets that stay and ask, and those of the pilot."""
        self.cls, sets = list(self.sets), list(self.sets.values())
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.group = np.arange(len(sets))
        self.every, self.others, self.pilot = Lists(sets, self.group), None, None
        found: list[tuple[bytes, bytes]] = []
        if len(sets) >= self.MANY:
            near = [self._linked(self.every, sets[k]) for k in range(0, len(sets), -(-len(sets) // self.PILOTS))]
            best = int(np.argmax([len(x) for x in near]))
            first, near = best * -(-len(sets) // self.PILOTS), near[best]
            if 4 * len(near) >= len(sets):
                self.group[near] = first
                self.pilot, self.others = (self.cls[first], sets[first]), Lists(sets, np.flatnonzero(self.group != first))
                found += [(self.cls[k], self.cls[first]) for k in near if k != first]
        self.sets = {}
        return found + [x for cls, shingles in self.asks.items() for x in self.links(cls, shingles)]

    def _linked(self, lists: Lists, shingles: np.ndarray) -> np.ndarray:
        both = lists.overlaps(shingles, len(self.cls))
        return np.flatnonzero((both > 0) & self.limit.linked(both, len(shingles), self.sizes))

    def links(self, cls: bytes, shingles: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links of a set to one member of each group that it is linked with; the groups become one."""
        out, lists = [], self.every
        if self.pilot is not None:
            name, own = self.pilot
            if self.limit.linked(len(np.intersect1d(own, shingles, assume_unique=True)), len(shingles), len(own)):
                out, lists = [(cls, name)] if cls != name else [], self.others
        found = self._linked(lists, shingles)
        found = found[[self.cls[k] != cls for k in found]] if len(found) else found
        groups, first = np.unique(self.group[found], return_index=True)
        if len(groups) > 1:
            self.group[np.isin(self.group, groups)] = groups[0]
        return out + [(cls, self.cls[k]) for k in found[first]]


def _scan(percent: int):
    """Rows come by block, the sets that stay before those that only ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, now, block = Threshold(percent), None, Block(Threshold(percent))
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for b, role, cls, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "role", "cls", "shingles")), strict=True):
                if b != now:
                    found += block.close() if block.every is None else []
                    now, block = b, Block(limit)
                if role == ASKS:
                    found += block.close() if block.every is None else []
                    found += block.links(cls, unsqueeze(raw, 2))
                else:
                    block.add(cls, unsqueeze(raw, 2), role == STAYS_AND_ASKS)
            yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["u", "v"])
        if block.every is None and (found := block.close()):
            yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["u", "v"])

    return run


def _linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, cls) of every row, with ``key`` if ``docs`` has one; (cls, least) of the classes; (cls, root) of those
    that are linked and not the least of their component."""
    limit, width = Threshold(percent), shuffle_width(docs)
    mine = docs.select("doc_id", "text")
    key = ["key"] if "key" in docs.columns else []
    schema = SUMMARY + "".join(f", {k} binary" for k in key)
    summary = materialize(docs.select("doc_id", "text", *key).mapInArrow(lean(_summary(size, width)), schema), "shingles")
    members = summary.filter("n is not null").select("doc_id", "n", "cls", *key)
    counted = summary.filter("bucket is not null").select("bucket", "payload").repartitionById(width, F.col("bucket"))
    top = counted.mapInArrow(lean(_frequent), "shingle long, seen long").orderBy(F.desc("seen"), "shingle").limit(HOT_MOST)
    hot = materialize(top, "hot").orderBy(F.desc("seen"), "shingle").toPandas()  # written: a collect would take HOT_MOST rows of each task
    values, seen = (hot[c].to_numpy(np.int64)[::-1].copy() for c in ("shingle", "seen"))
    total = members.agg(F.sum("n")).first()[0] or 0
    few = members.filter(F.col("n").between(1, LIGHT_MOST + LIGHT_MOST // 2)).groupBy("n").count().collect()
    boundary = limit.boundary({r["n"]: r["count"] for r in few})
    blocks = -(-total // BLOCK) or 1

    entries = mine.mapInArrow(lean(_enter(size, limit, boundary, values, seen, width, blocks)), "bucket int, kind int, payload binary")
    routes = (
        entries.repartitionById(width, F.col("bucket")).mapInArrow(lean(_head(percent, width)), LISTS)
        .repartitionById(width, F.col("bucket")).mapInArrow(lean(_place(blocks)), LISTS)
        .repartitionById(width, F.col("bucket")).mapInArrow(lean(_meet(percent, width)), PACKED)
        .repartitionById(width, F.col("bucket")).mapInArrow(lean(_class_routes), "short long, blocks array<int>")
    )
    classes = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    short = F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")
    candidates = classes.withColumn("short", short).join(routes, "short").select("cls", "blocks", F.col("least").alias("of"))
    sets = mine.join(candidates, F.col("doc_id").eqNullSafe(F.col("of"))).select("text", "cls", "blocks")
    sent = sets.mapInArrow(lean(_send(size, blocks)), "block int, role int, cls binary, shingles binary")
    scanned = sent.repartition(width, "block").sortWithinPartitions("block", "role").mapInArrow(lean(_scan(percent)), "u binary, v binary")
    links = materialize(scanned, "links")
    return members, classes, connected_components(links).withColumnRenamed("u", "cls")


def near_duplicate_groups(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents are linked if their Jaccard similarity is at least ``percent`` %."""
    members, classes, roots = _linked(docs.select("doc_id", "text"), size, percent)
    grouped = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = grouped.filter(F.col("root") != F.col("cls")).select("root").distinct()
    linked = grouped.join(least, "root", "left_semi")
    component = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.select("cls", "root").join(component, "root").select("cls", "component_id")
    named = materialize(
        classes.join(moved, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id")), "components"
    )
    return members.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component, and all rows without words.

    The row is that of the least id (null last), then of the least set and text digest. Rows of one id and text differ in
    other columns only; the least of them stays.
    """
    plain = plain_names(docs).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    members, _, roots = _linked(plain.select("doc_id", "text", "key"), size, percent)
    texts = members.filter("n > 0")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "key")
    first = texts.groupBy("cls").agg(F.min(own).alias("first")).join(roots, "cls", "left")
    first = first.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first"))
    kept = first.select("first.doc_id", "first.key").union(members.filter("n = 0").select("doc_id", "key").distinct())
    kept = kept.toDF("kept_id", "kept_key")
    out = plain.join(kept, (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    if texts.groupBy("doc_id", "key").count().filter("count > 1").head(1):
        blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(ASCII_SPACE)) == ""
        ordered = [f.name for f in plain.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
        least = F.min_by(F.struct(*plain.columns), F.struct(*ordered)).alias("least")
        out = out.filter(blank).union(out.filter(~blank).groupBy("doc_id", "key").agg(least).select("least.*"))
    return own_names(out, docs)
