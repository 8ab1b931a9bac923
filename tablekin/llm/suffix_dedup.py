"""Suffix-array dedup: every byte that lies in a string of 400 bytes which also starts elsewhere goes.

In each bucket, the strings that share a minimiser are put together and their suffixes sorted in two stages: those smaller
than their successors directly, the others by a scan over the buckets of first bytes, in which each sorted suffix places
the one before it. Neighbours with a common prefix of 400 bytes start repeated strings.

Defined results: a null or empty text has no bytes. Matches never cross documents. Rows with the same id and text are one
document: they are not "elsewhere" for each other. Kept bytes may cut a character in two; the text column then has
replacement characters, the digest is of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablekin.llm.common import cover, lean, spans_of
from tablekin.llm.repeats import Windows, merge_spans, repeated_spans


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last symbol and all 0 count as such."""
    n = len(symbols)
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    out = np.ones(n, bool)
    until = np.append(change, n - 1)  # last place of each run of equal symbols
    up = np.append(symbols[change] < symbols[change + 1], True)
    out[:] = np.repeat(up, np.diff(np.concatenate(([-1], until))))
    return out | (symbols == 0)


def _ranks(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(differs, np.arange(len(order)), 0))
    return rank


def sort_direct(symbols: np.ndarray, places: np.ndarray, typed: np.ndarray, depth: int) -> np.ndarray:
    """``places`` (all suffixes smaller than their successors) in order, by ``depth`` symbols and then position.

    From one such suffix to the next is a short substring. The substrings are ranked, then pairs of ranks of doubled
    reach; suffixes end at a 0, and equal ones follow their position. Equal symbols are told apart by the kind of suffix
    that they start, so that no substring is a prefix of another.
    """
    n, m = len(symbols), len(places)
    ends = np.append(places[1:], n - 1)
    code = symbols.astype(np.int64) * 2 + typed
    stop = symbols[places] == 0
    rank, step, take = np.zeros(m, np.int64), 0, 5
    open_ = np.arange(m)
    while len(open_):  # substrings, five symbols at a time
        key = np.zeros(len(open_), np.int64)
        for k in range(take):
            at = places[open_] + step + k
            key = key * 1024 + np.where(at <= ends[open_], code[np.minimum(at, n - 1)], 0)
        if step == 0:
            key = np.where(stop[open_], open_ - m, key)  # a 0 is smaller than all, and before later ones
        sub = np.lexsort((key, rank[open_]))
        own, group = key[sub], rank[open_][sub]
        differs = np.concatenate(([True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])))
        first = np.concatenate(([True], group[1:] != group[:-1]))
        base = np.maximum.accumulate(np.where(first, np.arange(len(sub)), 0))
        place = np.maximum.accumulate(np.where(differs, np.arange(len(sub)), 0))
        rank[open_[sub]] = group + place - base
        step += take
        tied = ~(differs & np.append(differs[1:], True))
        open_ = open_[sub[tied]]
        open_ = open_[places[open_] + step <= ends[open_]]
    # every element of a tie has the rank of the tie's first place, so ties can be refined in place
    reach = 1
    while reach < depth:
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        tied = np.zeros(m, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        open_ = order[tied]
        if not len(open_):
            break
        second = rank[np.minimum(open_ + reach, m - 1)]
        sub = np.lexsort((second, rank[open_]))
        group, own = rank[open_][sub], second[sub]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        differs = first | np.concatenate(([True], own[1:] != own[:-1]))
        base = np.maximum.accumulate(np.where(first, np.arange(len(sub)), 0))
        place = np.maximum.accumulate(np.where(differs, np.arange(len(sub)), 0))
        rank[open_[sub]] = group + place - base
        reach *= 2
    return places[np.lexsort((places, rank))]


def two_stage_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` symbols at least; ``symbols`` ends with 0, as does each string."""
    small = smaller_than_next(symbols)
    direct = sort_direct(symbols, np.flatnonzero(small), small, depth)
    sigma = int(symbols.max()) + 1
    head = np.searchsorted(symbols[direct], np.arange(sigma + 1))
    placed: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    out = []
    for c in range(sigma):
        wave = np.concatenate([*placed[c], np.zeros(0, np.int64)])
        large = [wave]
        while len(wave):  # runs of c: the suffix before one in this bucket is in it too
            wave = wave[wave > 0] - 1
            wave = wave[(symbols[wave] == c) & ~small[wave]]
            large.append(wave)
        bucket = np.concatenate([*large, direct[head[c] : head[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(symbols[before] > c) & ~small[before]]
        placed[c] = []
        if not len(before):
            continue
        by = np.argsort(symbols[before], kind="stable")
        before = before[by]
        first = symbols[before]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(first)), strict=True):
            placed[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefix(raw: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether suffixes a and b share ``size`` bytes within their strings (``room`` bytes are left of each)."""
    alive = np.flatnonzero((room[a] >= size) & (room[b] >= size))
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(raw), 8), (1, 1))
    for k in range(0, size, 8):
        at = min(k, max(0, size - 8))
        x, y = words[a[alive] + at], words[b[alive] + at]
        alive = alive[x.view(np.uint64)[:, 0] == y.view(np.uint64)[:, 0]] if size >= 8 else alive[(x[:, :size] == y[:, :size]).all(1)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def mark_repeated(size: int):
    def solve(heads: np.ndarray, strings: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        lengths = np.array([len(s) for s in strings], np.int64)
        raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        begin = np.cumsum(lengths + 1) - lengths - 1
        symbols = raw.astype(np.int32) + 1
        symbols[begin + lengths] = 0
        order = two_stage_order(symbols, size)
        of = np.repeat(np.arange(len(strings)), lengths + 1)
        room = (begin + lengths)[of] - np.arange(len(raw))
        order = order[room[order] >= size]
        equal = common_prefix(raw, room, order[:-1], order[1:], size)
        again = np.zeros(len(raw), bool)
        again[order[:-1][equal]] = True
        again[order[1:][equal]] = True
        for k in np.unique(of[again]).tolist():
            if not heads["again"][k]:
                a = int(begin[k])
                starts = np.flatnonzero(again[a : a + int(lengths[k])])
                yield k, spans_of(cover(int(lengths[k]), starts, size)) + int(heads["start"][k])

    return solve


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, runs, kept, sha = [], [], [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, spans = (text or "").encode(), merge_spans(packed)
            n.append(len(raw))
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            runs.append(len(spans))
            edges = [0, *spans.ravel().tolist(), len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            kept.append(left.decode("utf-8", "replace"))
            sha.append(hashlib.sha256(left).hexdigest())
        numbers = [pa.array(x, pa.int64()) for x in (n, removed, runs)]
        yield pa.record_batch(
            [batch.column("doc_id"), *numbers, pa.array(kept, pa.string()), pa.array(sha)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "text", "kept_sha256"],
        )


def remove_repeated_bytes(docs: DataFrame, size: int = 400, gram: int = 160) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, text, kept_sha256) without the repeated strings of ``size`` bytes."""
    spans = repeated_spans(docs, Windows(False, size, gram), mark_repeated(size), all_go=True)
    return spans.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, text string, kept_sha256 string")
