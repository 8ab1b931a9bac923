"""Substring dedup by super-k-mers: a window of words that has started earlier goes, with all words that it covers.

Runs of windows that share a minimiser travel as one packed string to its bucket. There the windows are numbered exactly
and sorted by document and start; all but the first of each number are marked.

Defined results: a null or empty text has no words. Rows with the same id and text are one document, so that each of
them gets that document's result; rows with one id and different texts are different documents, ordered by their key. A
null id is smaller than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablekin.llm.common import cover, lean, spans_of
from tablekin.llm.repeats import Windows, merge_spans, repeated_spans


def number_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Equal numbers for equal windows: pairs of numbered windows of half the length are numbered in turn."""
    number, length = ids, 1
    while length < size:
        step = min(length, size - length)
        if len(number) <= step:
            return np.zeros(0, np.int64)
        key = number[:-step] * (int(number.max()) + 1) + number[step:]
        number = np.unique(key, return_inverse=True)[1]
        length += step
    return number


def mark_later(size: int):
    def solve(heads: np.ndarray, strings: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        words = [s.split(b" ") for s in strings]
        lengths = np.array([len(w) for w in words], np.int64)
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), np.int64, int(lengths.sum()))
        window = number_windows(ids, size)
        begin = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(strings)), lengths)[: len(window)]
        at = np.arange(len(window)) - begin[of]
        whole = at + size <= lengths[of]
        window, of, at = window[whole], of[whole], at[whole]
        start = heads["start"][of].astype(np.int64) + at
        order = np.lexsort((start, heads["k2"][of], heads["k1"][of], heads["rank"][of], window))
        later = np.zeros(len(order), bool)
        later[order[1:]] = window[order[1:]] == window[order[:-1]]
        bounds = np.searchsorted(of, np.arange(len(strings) + 1))
        for k in np.unique(of[later]).tolist():
            own = slice(bounds[k], bounds[k + 1])
            gone = cover(int(lengths[k]), at[own][later[own]], size)
            yield k, spans_of(gone) + int(heads["start"][k])

    return solve


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept, sha = [], [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, spans = (text or "").encode().split(), merge_spans(packed)
            n.append(len(words))
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            for a, b in spans[::-1].tolist():
                del words[a:b]
            kept.append(b" ".join(words).decode())
            sha.append(hashlib.sha256(kept[-1].encode()).hexdigest())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha)]
        yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "text", "kept_sha256"])


def remove_repeats(docs: DataFrame, size: int = 20, gram: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, text, kept_sha256): kept words joined by one space."""
    spans = repeated_spans(docs, Windows(True, size, gram), mark_later(size), all_go=False)
    return spans.mapInArrow(lean(_cut), "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")
