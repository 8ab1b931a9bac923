"""Repeated windows across documents, found in buckets of packed runs that share a minimiser.

A text is a row of units (bytes or words), a window k of them. The minimiser of a window is its m-gram with the least
hash. Consecutive windows with one minimiser are a run, and equal windows have equal minimisers, so that

1. every run is entered under its minimiser's hash; those that only one run has are done with,
2. the runs of the others travel as one packed string each to the bucket of their minimiser, where a solver sees all
   windows that can be equal and says which units are to go,
3. the spans go back to their documents.

Tasks combine first: of the runs of a chunk with one minimiser, or one string, a bucket gets one. The documents are
shuffled once, by a 128-bit key of id and text; both joins use that shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import PACKED, group_starts, lean, mix64, pack_rows, shuffle_width, unpack_rows
from tablekin.llm.shingles import WordHash, window_hashes

PLACE_BITS = 24
#: A run of a document; known: 1 if its chunk has another with the minimiser, 2 on its way to its document.
RUN = np.dtype([("sig", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("start", "<u4"), ("windows", "<u2"), ("known", "u1")])
ITEM = np.dtype([("sig", "<u8"), ("start", "<u4"), ("windows", "<u2")])
#: A string in a bucket: its document, its rank among documents, its first unit, whether it is known to occur again.
HEAD = np.dtype([("sig", "<u8"), ("rank", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("start", "<u4"), ("length", "<u4"), ("again", "u1")])
SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<u4"), ("end", "<u4")])
#: Strings of several minimisers are solved together up to so many bytes.
TOGETHER = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257))

#: From heads and strings of a bucket to (head, spans in units of the document).
Solver = Callable[[np.ndarray, list[bytes]], Iterator[tuple[int, np.ndarray]]]


def byte_grams(raw: np.ndarray, m: int) -> np.ndarray:
    """Hash of each m-gram of bytes, by differences of a running polynomial."""
    n = len(raw)
    if n < m:
        return np.zeros(0, np.uint64)
    power = np.full(n + 1, _MULTIPLIER, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(n + 1, pow(_MULTIPLIER, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:n])))
    return mix64((total[m:] - total[:-m]) * inverse[: n - m + 1])


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values, from running minima of blocks."""
    n = len(key)
    if n < w:
        return np.zeros(0, key.dtype)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(key.dtype).max, key.dtype)
    padded[:n] = key
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


@dataclass(frozen=True)
class Windows:
    """What is compared: windows of ``size`` words or bytes, with minimisers of ``gram`` of them."""

    words: bool
    size: int
    gram: int

    @property
    def chunk(self) -> int:
        return 1 << 20 if self.words else 1 << 21

    def units(self, text: str | None) -> list[bytes] | bytes:
        raw = (text or "").encode()
        return raw.split() if self.words else raw

    def pack(self, units: list[bytes] | bytes, a: int, b: int) -> bytes:
        return b" ".join(units[a:b]) if self.words else units[a:b]

    def runs(self, texts: list[list[bytes] | bytes], hashes: WordHash) -> tuple[np.ndarray, ...]:
        """Of the runs of the texts: text, first window, number of windows, hash of the minimiser."""
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths)))
        if begin[-1] < self.size:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        if self.words:
            grams = window_hashes(np.concatenate([hashes.of(t) for t in texts]), self.gram)
        else:
            grams = byte_grams(np.frombuffer(b"".join(texts), np.uint8), self.gram)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(key, self.size - self.gram + 1) & mask).astype(np.int64)
        last = np.repeat(begin[1:], lengths)[: len(place)]
        valid = np.flatnonzero(np.arange(len(place)) + self.size <= last)
        if not len(valid):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        place = place[valid]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1))))
        first = valid[new]
        text = np.searchsorted(begin, first, "right") - 1
        return text, first - begin[text], np.diff(np.append(new, len(valid))), grams[place[new]]


def pieces(units: list[bytes] | bytes, windows: Windows) -> Iterator[tuple[int, list[bytes] | bytes]]:
    """A text in pieces whose windows are all windows of the text, once each."""
    most = windows.chunk
    if len(units) <= 2 * most:
        yield 0, units
        return
    for a in range(0, len(units) - windows.size + 1, most):
        yield a, units[a : a + most + windows.size - 1]


def _chunks(rows: Iterator[tuple], windows: Windows) -> Iterator[list[tuple[tuple, int, list[bytes] | bytes]]]:
    """Pieces of the rows' texts (row, offset, units), some at a time."""
    held, size = [], 0
    for row in rows:
        for offset, units in pieces(windows.units(row[-1]), windows):
            held.append((row, offset, units))
            size += len(units)
            if size >= windows.chunk:
                yield held
                held, size = [], 0
    if held:
        yield held


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _enter(windows: Windows, buckets: int):
    """Runs by bucket of their minimiser. If a chunk has several runs with one, they are known to have company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for held in _chunks(_columns(batches, "k1", "k2", "text"), windows):
            text, first, count, sig = windows.runs([h[2] for h in held], hashes)
            rows = np.zeros(len(sig), RUN)
            key = np.array([h[0][:2] for h in held], np.int64).reshape(-1, 2)
            rows["k1"], rows["k2"] = key[text, 0], key[text, 1]
            rows["start"] = first + np.array([h[1] for h in held], np.int64)[text]
            rows["sig"], rows["windows"] = sig, count
            order = np.lexsort((rows["start"], rows["k2"], rows["k1"], rows["sig"]))
            rows = rows[order]
            same = np.zeros(len(rows), bool)
            same[1:] = rows["sig"][1:] == rows["sig"][:-1]
            twin = same.copy()  # a repeated row of the same document
            twin[1:] &= (rows["k1"][1:] == rows["k1"][:-1]) & (rows["k2"][1:] == rows["k2"][:-1]) & (rows["start"][1:] == rows["start"][:-1])
            rows, same = rows[~twin], same[~twin]
            known = same.copy()
            known[:-1] |= same[1:]
            rows["known"] = known
            # known runs go with their documents; the first of them also tells the minimiser's bucket
            lead = ~known | ~same
            by_doc = rows[known]
            by_sig = rows[lead]
            bucket = np.concatenate([by_sig["sig"] % np.uint64(buckets), by_doc["k1"].view(np.uint64) % np.uint64(buckets)]).astype(np.int64)
            by_doc["known"] = 2
            yield pack_rows(bucket, np.concatenate([by_sig, by_doc]), buckets)

    return run


def _company(buckets: int):
    """Runs whose minimiser another run has too, on their way to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpack_rows(batches, RUN)
        told, rows = rows[rows["known"] == 2], rows[rows["known"] < 2]
        rows = rows[np.lexsort((rows["start"], rows["k2"], rows["k1"], rows["sig"]))]
        rows = rows[group_starts(rows, ("sig", "k1", "k2", "start"))]
        starts = group_starts(rows, ("sig",))
        alone = np.zeros(len(rows), bool)
        alone[starts[np.diff(np.append(starts, len(rows))) == 1]] = True
        rows = np.concatenate([told, rows[~alone & (rows["known"] == 0)]])
        yield pack_rows((rows["k1"].view(np.uint64) % np.uint64(buckets)).astype(np.int64), rows, buckets)

    return run


def _gather(kind: np.dtype, values: np.dtype, name: str):
    """Packed values of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpack_rows(batches, kind)
        rows = rows[np.lexsort((rows["start"], rows["k2"], rows["k1"]))]
        starts = group_starts(rows, ("k1", "k2"))
        own = np.zeros(len(rows), values)
        for field in values.names:
            own[field] = rows[field]
        bounds = np.append(starts, len(rows)).tolist()
        payload = [own[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.record_batch([pa.array(rows["k1"][starts]), pa.array(rows["k2"][starts]), pa.array(payload, pa.binary())], ["k1", "k2", name])

    return run


def _send(windows: Windows, buckets: int, all_go: bool):
    """Strings of the runs with company, packed by bucket. Of equal strings of a chunk one is sent.

    The others are spans already: with ``all_go`` those of all of them, else those of all but the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1).compress
        held: dict[bytes, list[tuple]] = {}
        signature: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            heads: dict[int, list[tuple]] = {}
            strings: dict[int, list[bytes]] = {}
            for string, places in held.items():
                if len(places) > 1:
                    places = sorted(set(places))
                several = len(places) > 1
                sig = signature[string]
                heads.setdefault(sig % buckets, []).append((sig, *places[0][:4], len(string), several))
                strings.setdefault(sig % buckets, []).append(string)
                for rank, k1, k2, start, n in places if several and all_go else places[1:]:
                    b = k1 % buckets
                    heads.setdefault(b, []).append((0, rank, k1, k2, start, n, 2))
                    strings.setdefault(b, [])
            used = sorted(heads)
            payload = [squeeze(len(heads[b]).to_bytes(8, "little") + np.array(heads[b], HEAD).tobytes() + b"".join(strings[b])) for b in used]
            return pa.record_batch([pa.array(used, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])

        for rank, k1, k2, packed, text in _columns(batches, "rank", "k1", "k2", "items", "text"):
            units = windows.units(text)
            for sig, start, count in np.frombuffer(packed, ITEM).tolist():
                end = start + count + windows.size - 1
                string = windows.pack(units, start, end)
                places = held.get(string)
                if places is None:
                    held[string] = [(rank, k1, k2, start, end)]
                    signature[string] = sig
                    size += len(string)
                else:
                    places.append((rank, k1, k2, start, end))
                size += 200
            if size >= 1 << 24:
                yield out()
                held, signature, size = {}, {}, 0
        if held:
            yield out()

    return run


def _solve(solver: Solver, buckets: int, all_go: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        heads, strings, spans = [np.zeros(0, HEAD)], [], [np.zeros(0, SPAN)]
        for (raw,) in _columns(batches, "payload"):
            raw = unsqueeze(raw)
            n = int.from_bytes(raw[:8], "little")
            own = np.frombuffer(raw, HEAD, n, 8)
            told, own = own[own["again"] == 2], own[own["again"] < 2]
            spans.append(_as_spans(told, told["start"], told["length"]))
            end = 8 + n * HEAD.itemsize + np.cumsum(own["length"].astype(np.int64))
            strings += [raw[e - k : e] for e, k in zip(end.tolist(), own["length"].tolist(), strict=True)]
            heads.append(own)
        head, found = np.concatenate(heads), []
        # by minimiser; a document's run comes once, however often its row is repeated
        order = np.lexsort((~head["again"].astype(bool), head["start"], head["k2"], head["k1"], head["rank"], head["sig"]))
        order = order[group_starts(head[order], ("sig", "rank", "k1", "k2", "start"))]
        head, strings = head[order], [strings[k] for k in order.tolist()]
        starts = np.append(group_starts(head, ("sig",)), len(head)).tolist()
        a = 0
        for at, end in zip(starts, starts[1:], strict=False):
            if end == len(head) or int(head["length"][a:end].sum()) >= TOGETHER:
                found += _distinct(head[a:end], strings[a:end], solver, all_go)
                a = end
        for k, (start, end) in found:
            spans.append(_as_spans(np.repeat(k, len(start)), start, end))
        rows = np.concatenate(spans)
        yield pack_rows((rows["k1"].view(np.uint64) % np.uint64(buckets)).astype(np.int64), rows, buckets)

    return run


def _as_spans(heads: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(heads), SPAN)
    out["k1"], out["k2"], out["start"], out["end"] = heads["k1"], heads["k2"], start, end
    return out


def _distinct(heads: np.ndarray, strings: list[bytes], solver: Solver, all_go: bool) -> Iterator[tuple[np.ndarray, tuple]]:
    """Spans of all strings; equal ones are solved once, as the first of them."""
    first: dict[bytes, int] = {}
    heads = heads.copy()
    # of equal strings the first by document and start stands for all; heads come in that order within a minimiser
    lead = [first.setdefault(s, k) for k, s in enumerate(strings)]
    units = [s.count(b" ") + 1 for s in strings] if not all_go else heads["length"].tolist()
    for k, to in enumerate(lead):
        if k != to:
            if all_go and not heads["again"][to]:
                heads["again"][to] = 1
                yield heads[to : to + 1], (heads["start"][to : to + 1], heads["start"][to : to + 1] + np.uint32(units[to]))
            if not heads["again"][k] or not all_go:
                yield heads[k : k + 1], (heads["start"][k : k + 1], heads["start"][k : k + 1] + np.uint32(units[k]))
    own = list(first.values())
    for k, found in solver(heads[own], [strings[k] for k in own]):
        yield heads[own[k] : own[k] + 1], (found[:, 0], found[:, 1])


def merge_spans(packed: bytes | None) -> np.ndarray:
    """Maximal runs of units (start, end) that the spans cover."""
    if not packed:
        return np.zeros((0, 2), np.int64)
    spans = np.frombuffer(packed, "<u4").reshape(-1, 2).astype(np.int64)  # by start
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack([spans[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])], 1)


def repeated_spans(docs: DataFrame, windows: Windows, solver: Solver, all_go: bool) -> DataFrame:
    """(doc_id, text, spans): each row with the packed spans of units that have to go, null if none."""
    width = shuffle_width(docs)
    keyed = docs.select(
        "doc_id",
        "text",
        F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text").alias("k1"),
        F.xxhash64(F.lit(2), "text", "doc_id", F.col("text").isNull()).alias("k2"),
    )
    bucket, part = F.col("bucket"), np.dtype([("start", "<u4"), ("end", "<u4")])
    company = (
        keyed.select("k1", "k2", "text").mapInArrow(lean(_enter(windows, width)), PACKED).repartitionById(width, bucket)
        .mapInArrow(lean(_company(width)), PACKED).repartitionById(width, bucket)
        .mapInArrow(lean(_gather(RUN, ITEM, "items")), "k1 long, k2 long, items binary")
    )
    rank = F.coalesce("doc_id", F.lit(-(2**63))).alias("rank")
    found = (
        keyed.join(company, ["k1", "k2"]).select(rank, "k1", "k2", "items", "text")
        .mapInArrow(lean(_send(windows, width, all_go)), PACKED).repartitionById(width, bucket)
        .mapInArrow(lean(_solve(solver, width, all_go)), PACKED).repartitionById(width, bucket)
        .mapInArrow(lean(_gather(SPAN, part, "spans")), "k1 long, k2 long, spans binary")
    )
    return keyed.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
