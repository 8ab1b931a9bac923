"""Benchmark decontamination: an FM-index per shard of documents is searched for the windows of every benchmark item.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Each task indexes its documents in shards
of bounded size, searches every window backward through wavelet ranks, locates the occurrences by sampled suffix
positions and merges the spans that they cover. Words that no item has are one symbol, as no window holds it.

Items travel to the tasks in blocks of bounded size; the spans of several blocks are merged per document.

Defined results: a null text has no words; an item without words has no window; items with a null id mark words but are
not named. Items are told apart by id. Each document row gives one row, repeated rows too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import cover, lean, own_names, plain_names, spans_of, text_bytes
from tablekin.llm.fm_index import END, MOST_SYMBOLS, FmIndex

# fixed values: bytes that make words; the others part them
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
OTHER = 1

SPANS = "array<struct<start:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Patterns:
    """Distinct windows of a block of items, as symbols, by length."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int | None]] = {}
        for item, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words_of(text)]
            for k in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[k : k + window]), set()).add(item)
        self.sigma = len(self.symbol) + 2
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for length in sorted({len(p) for p in found}):
            own = sorted(p for p in found if len(p) == length)
            self.by_length[length] = np.array(own, np.int64), [[i for i in found[p] if i is not None] for p in own]
        self.longest = max(self.by_length, default=1)


def search_shard(symbols: list[np.ndarray], patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Occurrences in a shard of texts: text, start, length, and the items of the window."""
    index = FmIndex(np.concatenate([x for s in symbols for x in (s, [END])]).astype(np.int32), patterns.sigma)
    begin = np.concatenate(([0], np.cumsum([len(s) + 1 for s in symbols])))
    which, start, length, items = [], [], [], []
    for size, (windows, owners) in patterns.by_length.items():
        low, high = index.search(windows)
        count = high - low
        total = int(count.sum())
        if total:
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
            at = index.locate(rows)
            text = np.searchsorted(begin, at, "right") - 1
            which.append(text)
            start.append(at - begin[text])
            length.append(np.full(total, size))
            for k in np.flatnonzero(count):
                items.extend([owners[k]] * int(count[k]))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(which), join(start), join(length), items


def _pieces(words: int, overlap: int) -> Iterator[tuple[int, int]]:
    """A text of more words than a shard takes is cut into pieces that share ``overlap`` words."""
    most = MOST_SYMBOLS // 2
    start = 0
    while True:
        yield start, min(words, start + most)
        if start + most >= words:
            return
        start += most - overlap


def _flush(held: list, patterns: Patterns) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Spans and items of the held documents, in order."""
    symbols, of, offset = [], [], []
    for k, (_, ids) in enumerate(held):
        for a, b in _pieces(len(ids), patterns.longest - 1):
            symbols.append(ids[a:b])
            of.append(k)
            offset.append(a)
    hits: list[list] = [[] for _ in held]
    named: list[set[int]] = [set() for _ in held]
    at, size = 0, 0
    for end in range(len(symbols) + 1):
        if end == len(symbols) or (size + len(symbols[end]) + 1 > MOST_SYMBOLS and size):
            if end > at:
                which, start, length, items = search_shard(symbols[at:end], patterns)
                order = np.argsort(which, kind="stable")
                bounds = np.searchsorted(which[order], np.arange(end - at + 1))
                for j in range(end - at):
                    if own := order[bounds[j] : bounds[j + 1]].tolist():
                        k = of[at + j]
                        hits[k].append((start[own] + offset[at + j], length[own]))
                        named[k].update(i for o in own for i in items[o])
            at, size = end, 0
        if end < len(symbols):
            size += len(symbols[end]) + 1
    for (_, ids), own, items in zip(held, hits, named, strict=True):
        if own:
            starts, lengths = (np.concatenate(x) for x in zip(*own, strict=True))
            yield len(ids), spans_of(cover(len(ids), starts, lengths)), sorted(items)
        else:
            yield len(ids), np.zeros((0, 2), np.int64), []


def _search(items: list[tuple[int | None, bytes]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(items, window)
        numbers = patterns.symbol.get

        def out(held: list, rows: list[dict], names: list[str]) -> pa.RecordBatch:
            found = list(_flush(held, patterns))
            columns = {n: pa.concat_arrays([r[n] for r in rows]) for n in names}
            columns["n_words"] = pa.array([f[0] for f in found], pa.int64())
            columns["spans"] = pa.array([[{"start": int(a), "end": int(b)} for a, b in f[1]] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns["items"] = pa.array([f[2] for f in found], pa.list_(pa.int64()))
            return pa.record_batch(columns)

        held: list = []
        rows: list[dict] = []
        size, names = 0, []
        for batch in batches:
            names, at = batch.schema.names, 0
            for k, text in enumerate(text_bytes(batch.column("text"))):
                words = words_of(text)
                held.append((k, np.fromiter(map(numbers, words, [OTHER] * len(words)), np.int32, len(words))))
                size += len(words) + 1
                if size >= MOST_SYMBOLS * 0.9:
                    rows.append({n: batch.column(n).slice(at, k + 1 - at) for n in names})
                    yield out(held, rows, names)
                    held, rows, size, at = [], [], 0, k + 1
            if at < batch.num_rows:
                rows.append({n: batch.column(n).slice(at) for n in names})
        if held:
            yield out(held, rows, names)

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items with words, in blocks of about ``block_bytes``; at least one block, perhaps empty."""
    block, size, any_ = [], 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        block.append((row["item_id"], text))
        size += len(text) + 100
        if size >= block_bytes:
            yield block
            block, size, any_ = [], 0, True
    if block or not any_:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with n_words, spans (merged word ranges that items cover) and items (ids, sorted as numbers).

    ``docs`` must not have columns of these names. With more than one block of items, documents are put together by all
    their columns, so that repeated rows need no id.
    """
    field = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in field.items()), "n_words long", f"spans {SPANS}", "items array<long>"])
    parts = [docs.mapInArrow(lean(_search(block, window)), schema) for block in item_blocks(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    merged = whole.groupBy(*[F.col(f"`{c}`") for c in docs.columns], "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("times"),
    )
    union = F.aggregate(
        "spans",
        F.expr(f"cast(array() as {SPANS})"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return merged.withColumn("spans", union).select(*columns, "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def n_hit(spans: str = "spans"):
    """Words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES.replace(b"\n", b" ")))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows (hit words are 1 / ``share`` of all or more) and, in the others, without the spans."""
    plain = plain_names(docs)
    found = find_contamination(plain, benchmark, window)
    hit = n_hit()
    clean = found.filter(~((hit > 0) & (share * hit >= F.col("n_words"))))
    return own_names(clean.select(*plain.columns, "spans").mapInArrow(lean(_cut), plain.schema), docs)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        names = [n for n in batch.schema.names if n != "spans"]
        columns = {n: batch.column(n) for n in names}
        if any(spans):
            text = batch.column("text").to_pylist()
            cut = [cut_spans(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(text, spans, strict=True)]
            columns["text"] = pa.array(cut, batch.schema.field("text").type)
        yield pa.record_batch(columns)
