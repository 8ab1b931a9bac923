"""Line dedup: lines found in many documents are dropped from all of them.

Every document's distinct normalised lines become rows of a 128-bit hash, documents are counted per hash, hashes over
the threshold go back to their documents, and the other lines are put together again by position.

Defined results: a null or empty text is one empty line. Rows with one ``doc_id`` (a null id included) count as one
document, and every row comes out. A line whose key is shorter than ``min_chars`` always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import ASCII_SPACE, HOT_SHARE, lean, slices
from tablekin.session import materialize

PAIRS = "doc_id long, h1 long, h2 long"
CLEAN = "doc_id long, n_lines long, n_dropped long, text string"


def line_keys(text: str) -> list[str]:
    """Keys of all lines: ASCII white space stripped at both ends, A-Z in lower case."""
    lines = pa.array(text.split("\n"), pa.string())
    return pc.utf8_trim(pc.ascii_lower(lines), characters=ASCII_SPACE).to_pylist()


def key_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode())


def split_batch(texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
    """Offsets of the texts' lines, all lines, all keys."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.split_pattern(filled, "\n")
    lines = parts.flatten()
    keys = pc.utf8_trim(pc.ascii_lower(lines), characters=ASCII_SPACE)
    return parts.offsets.to_numpy(), lines.to_pylist(), keys.to_pylist()


def _pairs(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, _, keys = split_batch(batch.column("text"))
            ids, out_ids, out = batch.column("doc_id").to_pylist(), [], []
            for k, doc in enumerate(ids):
                own = {x for x in keys[offsets[k] : offsets[k + 1]] if len(x) >= min_chars}
                out.extend(map(key_hash, own))
                out_ids.extend([doc] * len(own))
            halves = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(out_ids, pa.int64()), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["doc_id", "h1", "h2"],
            )

    return run


def _clean(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, lines, keys = split_batch(batch.column("text"))
            drops, n_lines, n_dropped, kept = batch.column("drops").to_pylist(), [], [], []
            for k, drop in enumerate(drops):
                a, b = offsets[k], offsets[k + 1]
                n_lines.append(int(b - a))
                if drop:
                    gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in drop}
                    stay = [line for line, key in zip(lines[a:b], keys[a:b], strict=True) if len(key) < min_chars or key_hash(key) not in gone]
                else:
                    stay = lines[a:b]
                n_dropped.append(int(b - a) - len(stay))
                kept.append("\n".join(stay))
            columns = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            rest = [c for c in batch.schema.names if c not in ("doc_id", "text", "drops")]
            names = ["doc_id", "n_lines", "n_dropped", "text"]
            yield pa.record_batch(columns + [batch.column(c) for c in rest], names + rest)

    return run


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, DataFrame, int]:
    """Distinct lines of each document, lines of at least ``min_docs`` documents, and the number of the former."""
    pairs = materialize(docs.select("doc_id", "text").mapInArrow(lean(_pairs(min_chars)), PAIRS), "lines")
    counts = pairs.groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n"))
    return pairs, materialize(counts.filter(F.col("n") >= min_docs), "frequent"), pairs.count()


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) with the lines of at least ``min_docs`` documents gone; ``carry`` names more columns to keep.

    The few lines that hold a large share of all rows are found by a broadcast of at most ``HOT_SHARE`` hashes, the
    others by a shuffle in which no key is large.
    """
    pairs, frequent, total = frequent_lines(docs, min_docs, min_chars)
    key = ["h1", "h2"]
    is_hot = F.col("n") * HOT_SHARE >= total
    hot = F.broadcast(frequent.filter(is_hot).select(key))
    found = pairs.join(hot, key, "left_semi").unionByName(
        pairs.join(hot, key, "left_anti").join(frequent.filter(~is_hot).select(key), key, "left_semi")
    )
    drops = found.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops")).withColumnRenamed("doc_id", "of")
    mine = docs.select("doc_id", "text", *carry)
    joined = mine.join(drops, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields[2:])
    return joined.mapInArrow(lean(_clean(min_chars)), CLEAN + more)
