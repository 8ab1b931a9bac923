"""Masked pseudo-likelihood: a small two-sided window network predicts every word from its neighbours.

Words are counted over all texts. The ``words`` most frequent ones (ties in byte order) form classes of neighbouring
frequency, the others classes by length. A word's probability is that of its class, given the classes of the two words
on either side, times its own count's share of the class: every word of the corpus keeps its count, in a table that grows
with the corpus. Texts are cut into words twice, to count and to turn them into classes; the classes are written.

The network (one table per neighbour into a tanh layer, then a softmax over classes) is trained in numpy inside the tasks
on every word. Documents are dealt by a hash of id and classes to shards of about ``shard_words`` words and sorted inside, so
the shards, and with them the weights, don't depend on the input's partitions. The means of the shards' weights, by words
seen, start the next round. Every word of every text is scored.

Defined results: a null or empty text has no words, a sum of 0 and no mean. Places beyond a text's ends are a class of
their own. Each row gives one row; repeated ids and null ids are rows like others, and rows with one id and one text lie in
one shard. Other columns are not read. A text is held whole, however long. Sums of weights and of shares are integers, so
that results do not depend on task order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import PACKED, shuffle_width, text_bytes
from tablekin.llm.shingles import WordHash
from tablekin.session import materialize

LENGTHS = 16
SIDES = (-2, -1, 1, 2)
#: Weights are summed as multiples of 1 / FIXED, times thousands of words.
FIXED = 2.0**24
#: Log shares are summed as multiples of 1 / SHARES.
SHARES = 2.0**30
CHUNK_WORDS, CHUNK_ROWS = 1 << 20, 8192
#: Scores of at most this size need not be shifted before their exponentials are taken and added up.
SAFE = 60.0

#: Kinds of coded rows: documents to score, documents to train on, rare words on their way to their counts, and their log counts.
TO_SCORE, TO_TRAIN, RARE, COUNTED = range(4)
CODED = "kind int, part long, chunk long, ids array<long>, sizes array<long>, sums array<long>, payload binary"


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(buckets: int):
    """Words and counts of a chunk, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze = WordHash(), zstandard.ZstdCompressor(1).compress
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            held: dict[int, list[bytes]] = {}
            for word in counts:
                held.setdefault(hashes[word] % buckets, []).append(word)
            used = sorted(held)
            payload = [squeeze(np.array([counts[w] for w in held[b]], "<i8").tobytes() + b"\n".join(held[b])) for b in used]
            sizes = [len(held[b]) for b in used]
            return pa.record_batch([pa.array(used, pa.int32()), pa.array([n.to_bytes(8, "little") + p for n, p in zip(sizes, payload, strict=True)], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for text in text_bytes(batch.column("text")):
                counts.update(_words(text))
                if len(counts) > 1_000_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return run


def _top(most: int):
    """The ``most`` most frequent words of a bucket, words and tokens of each length, and the counts of all words by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        counts: Counter[bytes] = Counter()
        bucket = None
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                n, raw = int.from_bytes(raw[:8], "little"), unsqueeze(raw[8:])
                for word, k in zip(raw[8 * n :].split(b"\n"), np.frombuffer(raw, "<i8", n).tolist(), strict=True):
                    counts[word] += k
        if bucket is None:
            return
        rows = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
        total = Counter()
        for w, k in counts.items():
            total[min(len(w), LENGTHS)] += k
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
        order = np.argsort(hashes)
        packed = hashes[order].tobytes() + np.fromiter(counts.values(), np.int64, len(counts))[order].tobytes()
        words = [w for w, _ in rows] + [None] * len(total) + [None]
        lengths = [None] * len(rows) + list(total) + [None]
        n = [k for _, k in rows] + list(total.values()) + [None]
        last = len(n) - 1
        columns = [pa.array(words, pa.binary()), pa.array(lengths, pa.int32()), pa.array(n, pa.int64())]
        columns += [pa.array([None] * last + [bucket], pa.int32()), pa.array([None] * last + [packed], pa.binary())]
        yield pa.record_batch(columns, ["word", "length", "n", "bucket", "payload"])

    return run


@dataclass
class Vocabulary:
    """Class of each frequent word, and the log share of a word in its class in units of 1 / SHARES.

    Rare words have classes by length; the share kept here lacks their own log count, which ``counts`` holds:
    rows ``(bucket, payload)`` of sorted hashes and counts of all words.
    """

    number: dict[bytes, int]
    class_of: np.ndarray
    share: np.ndarray
    classes: int
    total: int
    counts: DataFrame | None = None

    def read(self, words: list[bytes]) -> np.ndarray:
        """Numbers of a text's words; from ``len(number)`` on they are lengths of rare words."""
        get, rare = self.number.get, len(self.number)
        return np.fromiter([k if (k := get(w)) is not None else rare + min(len(w), LENGTHS) for w in words], np.int64, len(words))

    def plain(self) -> Vocabulary:
        """What the tasks need."""
        return Vocabulary(self.number, self.class_of, self.share, self.classes, self.total)


def class_type(classes: int) -> np.dtype:
    """Smallest kind of number for classes and the place beyond the ends."""
    return np.dtype(np.min_scalar_type(classes))


def vocabulary(docs: DataFrame, words: int, classes: int) -> Vocabulary:
    """Counts over all texts; at most ``words`` words reach the driver, the counts of all stay in a written table."""
    width = shuffle_width(docs)
    packed = docs.select("text").mapInArrow(_counts(width), PACKED).repartitionById(width, F.col("bucket"))
    counted = materialize(packed.mapInArrow(_top(words), "word binary, length int, n long, bucket int, payload binary"), "words")
    best = counted.filter("word is not null").select("word", "n").orderBy(F.desc("n"), "word").limit(words)
    top = sorted(materialize(best, "vocabulary").collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    lengths = counted.filter("length is not null").groupBy("length").agg(F.sum("n").alias("n")).collect()
    n = np.array([r["n"] for r in top], np.int64)
    tokens = np.zeros(LENGTHS + 1, np.int64)
    for r in lengths:
        tokens[r["length"]] = r["n"]
    total = int(tokens.sum())
    for r in top:
        tokens[min(len(r["word"]), LENGTHS)] -= r["n"]
    before = np.cumsum(n) - n
    own = (before * classes // max(1, int(n.sum()))).astype(np.int64)
    own = np.unique(own, return_inverse=True)[1] if len(own) else own
    used = int(own.max()) + 1 if len(own) else 0
    mass = np.bincount(own, n, minlength=max(1, used))
    share = np.concatenate([np.log(n / mass[own]) if len(n) else np.zeros(0), -np.log(np.maximum(tokens, 1).astype(float))])
    class_of = np.concatenate([own, used + np.arange(LENGTHS + 1)])
    counts = counted.filter("bucket is not null").select("bucket", "payload")
    fixed = np.rint(share * SHARES).astype(np.int64)
    return Vocabulary({bytes(r["word"]): k for k, r in enumerate(top)}, class_of, fixed, used + LENGTHS + 1, total, counts)


def _coded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in CODED.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _encode(words: Vocabulary, shards: int, buckets: int):
    """Documents as classes, per chunk: whole for scoring, by shard for training, and rare words by bucket of their hash."""
    kind = class_type(words.classes)
    class_of = words.class_of.astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHash(), TaskContext.get().partitionId() << 32
        ids, lines, sums, rare, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            sizes = [len(x) for x in lines]
            rows = [(TO_SCORE, None, number, ids, sizes, sums, b"".join(x.tobytes() for x in lines))]
            dealt: dict[int, list[tuple[int, bytes]]] = {}
            for doc_id, line in zip(ids, lines, strict=True):
                if len(line):
                    raw = line.tobytes()
                    h = xxhash.xxh3_64_intdigest(raw, seed=0 if doc_id is None else doc_id & (1 << 64) - 1)
                    dealt.setdefault(h % shards, []).append((h >> 1, raw))
            for shard, docs in dealt.items():
                sized = [len(raw) // kind.itemsize for _, raw in docs]
                rows.append((TO_TRAIN, shard, number, [h for h, _ in docs], sized, None, b"".join(raw for _, raw in docs)))
            hashed = np.concatenate([np.zeros(0, np.uint64), *rare])
            if len(hashed):
                owner = np.repeat(np.arange(len(rare), dtype=np.int32), [len(x) for x in rare])
                bucket = (hashed % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, hashed, owner = bucket[order], hashed[order], owner[order]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True):
                    rows.append((RARE, int(bucket[a]), number, None, None, None, hashed[a:b].tobytes() + owner[a:b].tobytes()))
            return _coded(rows)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                own = _words(text)
                numbers = words.read(own)
                ids.append(doc_id)
                lines.append(class_of[numbers])
                sums.append(int(words.share[numbers].sum()))
                rare.append(hashes.of([own[k] for k in np.flatnonzero(numbers >= len(words.number)).tolist()]))
                size += len(own)
                if size >= CHUNK_WORDS or len(ids) >= CHUNK_ROWS:
                    yield out()
                    number += 1
                    ids, lines, sums, rare, size = [], [], [], [], 0
        if ids:
            yield out()

    return run


def _log_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rare words of chunks, after their bucket's counts: per chunk, the rows and the sums of their words' log counts."""
    keys, logs, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for batch in batches:
        for kind, chunk, raw in zip(*[batch.column(c).to_pylist() for c in ("kind", "chunk", "payload")], strict=True):
            if kind != RARE:
                n = len(raw) // 16
                keys = np.frombuffer(raw, np.uint64, n)
                logs = np.rint(np.log(np.frombuffer(raw, np.int64, n, 8 * n)) * SHARES).astype(np.int64)
                continue
            n = len(raw) // 12
            hashed, owner = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int32, n, 8 * n)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums = np.add.reduceat(logs[np.searchsorted(keys, hashed)], first)
            rows.append((COUNTED, None, chunk, None, None, None, sums.tobytes() + owner[first].tobytes()))
        if len(rows) >= 256:
            yield _coded(rows)
            rows = []
    if rows:
        yield _coded(rows)


class Network:
    """Tables of the neighbours' classes into the hidden layer, and the softmax over classes."""

    def __init__(self, classes: int, hidden: int):
        draw = np.random.default_rng(7)
        self.tables = draw.normal(0, 0.1, (len(SIDES), classes + 1, hidden)).astype(np.float32)
        self.out = draw.normal(0, 0.1, (hidden + 1, classes)).astype(np.float32)
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, rows: int, width: int) -> np.ndarray:
        """Space that every step uses again; new arrays of this size cost as much as what is done with them."""
        if name not in self.rooms or len(self.rooms[name]) < rows:
            self.rooms[name] = np.empty((rows, width), np.float32)
        return self.rooms[name][:rows]

    def vector(self) -> np.ndarray:
        return np.concatenate([self.tables.ravel(), self.out.ravel()])

    def load(self, vector: np.ndarray) -> Network:
        cut = self.tables.size
        self.tables = vector[:cut].reshape(self.tables.shape).astype(np.float32)
        self.out = vector[cut:].reshape(self.out.shape).astype(np.float32)
        return self

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """The hidden layer, in a room that the next call overwrites."""
        n, width = len(near[0]), self.tables.shape[2]
        total, more = self.room("total", n, width), self.room("more", n, width)
        self.tables[0].take(near[0], 0, total, "clip")
        for k in range(1, len(SIDES)):
            total += self.tables[k].take(near[k], 0, more, "clip")
        return np.tanh(total, out=total)

    def small(self) -> bool:
        """Whether no score can exceed SAFE, as hidden values lie between -1 and 1."""
        return np.abs(self.out).sum(0).max() <= SAFE

    def log_chance(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target class given the neighbours' classes."""
        score = np.matmul(self.hidden(near), self.out[:-1], out=self.room("score", len(target), self.out.shape[1]))
        score += self.out[-1]
        if not self.small():
            score -= score.max(1, keepdims=True)
        own = score[np.arange(len(target)), target]
        return own - np.log(np.exp(score, out=score) @ np.ones(score.shape[1], np.float32))

    def learn(self, near: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float = 0.05) -> None:
        """One step of Adagrad on the mean of the conditional log probabilities."""
        n, width = len(target), self.tables.shape[2]
        flat, h = self.hidden(near), self.room("h", n, width + 1)
        h[:, :-1], h[:, -1] = flat, 1
        error = np.matmul(h, self.out, out=self.room("error", n, self.out.shape[1]))
        if not self.small():
            error -= error.max(1, keepdims=True)
        np.exp(error, out=error)
        total = error @ np.ones(error.shape[1], np.float32)
        error[np.arange(n), target] -= total
        part = (1 / (total * n))[:, None]
        back = np.matmul(error, self.out[:-1].T, out=self.room("back", n, width))
        flat *= flat
        np.subtract(1, flat, out=flat)
        flat *= part
        back *= flat
        h *= part
        gradient = h.T @ error
        memory[0] += gradient**2
        self.out -= rate * gradient / np.sqrt(memory[0] + 1e-8)
        for k in range(len(SIDES)):
            order = np.argsort(near[k], kind="stable")
            found = near[k][order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            used, own = found[first], np.add.reduceat(back.take(order, 0, self.room("more", n, width), "clip"), first, axis=0)
            memory[1][k, used] += own**2
            self.tables[k, used] -= rate * own / np.sqrt(memory[1][k, used] + 1e-8)


def neighbours(classes: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes beside each word of several texts (one row per side), and the words' own."""
    gap = np.full(2, outside, classes[0].dtype)
    line = np.concatenate([x for c in classes for x in (gap, c)] + [gap])
    lengths = np.array([len(c) for c in classes])
    begin = np.cumsum(lengths + 2) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    return np.stack([line[at + s] for s in SIDES]), line[at]


def _train(classes: int, start: np.ndarray, hidden: int, batch_size: int = 2048):
    """Every shard of a task trains on its own from the same start; the task adds the shards' weights up."""
    kind = class_type(classes)

    def shard(docs: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
        net = Network(classes, hidden).load(start)
        memory = [np.zeros_like(net.out), np.zeros_like(net.tables)]
        held, size, seen = [], 0, 0

        def step() -> int:
            near, target = neighbours(held, classes)
            for a in range(0, len(target), batch_size):
                net.learn(near[:, a : a + batch_size], target[a : a + batch_size], memory)
            return len(target)

        for _, raw in sorted(docs):
            held.append(np.frombuffer(raw, kind))
            size += len(held[-1])
            if size >= 1 << 17:
                seen += step()
                held, size = [], 0
        if size:
            seen += step()
        thousands = -(-seen // 1024)
        return thousands, np.rint(net.vector().astype(np.float64) * FIXED).astype(np.int64) * thousands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, part, docs = None, 0, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "ids", "sizes", "payload")]
            for number, order, sizes, raw in zip(*columns, strict=True):
                if number != part and docs:
                    n, own = shard(docs)
                    total, seen, docs = own if total is None else total + own, seen + n, []
                part = number
                ends = np.cumsum(sizes) * kind.itemsize
                docs += [(h, raw[b - n * kind.itemsize : b]) for h, n, b in zip(order, sizes, ends.tolist(), strict=True)]
        if docs:
            n, own = shard(docs)
            total, seen = own if total is None else total + own, seen + n
        if total is not None:
            yield pa.record_batch([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["seen", "weights"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of weights times words seen; integers, so that the order does not matter."""
    total, seen = None, 0
    for batch in batches:
        for n, raw in zip(batch.column("seen").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            own = np.frombuffer(raw, np.int64).copy()
            total = own if total is None else total + own
            seen += n
    if total is not None:
        yield pa.record_batch([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["seen", "weights"])


def train(coded: DataFrame, classes: int, hidden: int = 32, rounds: int = 2) -> np.ndarray:
    """Weights of the network after ``rounds`` rounds over all texts; sums travel through 16 tasks, one row reaches the driver."""
    schema, weights = "seen long, weights binary", Network(classes, hidden).vector()
    shards = coded.filter(F.col("kind") == TO_TRAIN).select("part", "ids", "sizes", "payload")
    for _ in range(rounds):
        dealt = shards.repartitionById(shuffle_width(coded), F.col("part").cast("int")).sortWithinPartitions("part")
        own = dealt.mapInArrow(_train(classes, weights, hidden), schema)
        part = F.pmod(F.xxhash64("weights"), F.lit(16)).cast("int")
        total = own.repartitionById(16, part).mapInArrow(_sum, schema).coalesce(1).mapInArrow(_sum, schema).collect()
        if not total:
            break
        weights = np.frombuffer(total[0]["weights"], np.int64) / total[0]["seen"] / FIXED
    return weights


def _score(classes: int, weights: np.ndarray, hidden: int):
    """Chunks of documents, each followed by the log counts of its rare words, to a row per document."""
    kind = class_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(classes, hidden).load(weights)
        held: tuple | None = None

        def out() -> pa.RecordBatch:
            ids, sizes, shares, raw = held
            lengths = np.array(sizes)
            line = np.split(np.frombuffer(raw, kind), np.cumsum(lengths)[:-1])
            near, target = neighbours(line, classes)
            chance = np.concatenate([np.zeros(0)] + [net.log_chance(near[:, a : a + 1024], target[a : a + 1024]) for a in range(0, len(target), 1024)])
            sums = np.bincount(np.repeat(np.arange(len(ids)), lengths), chance, minlength=len(ids)) + shares / SHARES
            mean = [s / n if n else None for s, n in zip(sums.tolist(), sizes, strict=True)]
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(mean, pa.float64())], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

        for batch in batches:
            for row in batch.to_pylist():
                raw = row["payload"]
                if row["kind"] == TO_SCORE:
                    if held:
                        yield out()
                    held = row["ids"], row["sizes"], np.array(row["sums"], np.int64), raw
                else:
                    n = len(raw) // 12
                    held[2][np.frombuffer(raw, np.int32, n, 8 * n)] += np.frombuffer(raw, np.int64, n)
        if held:
            yield out()

    return run


def score_coded(coded: DataFrame, known: Vocabulary, weights: np.ndarray, hidden: int = 32) -> DataFrame:
    """Scores of coded documents: rare words meet their counts by bucket, then their sums meet their chunk."""
    width = shuffle_width(coded)
    counts = known.counts.select(F.lit(TO_SCORE).alias("kind"), F.col("bucket").cast("long").alias("part"), F.lit(None).cast("long").alias("chunk"), "payload")
    rare = coded.filter(F.col("kind") == RARE).select("kind", "part", "chunk", "payload")
    met = counts.unionByName(rare).repartitionById(width, F.col("part").cast("int")).sortWithinPartitions("part", "kind")
    summed = met.mapInArrow(_log_counts, CODED)
    both = coded.filter(F.col("kind") == TO_SCORE).unionByName(summed).select("kind", "chunk", "ids", "sizes", "sums", "payload")
    chunks = both.repartition(width, "chunk").sortWithinPartitions("chunk", "kind")
    return chunks.mapInArrow(_score(known.classes, weights, hidden), "doc_id long, n_words long, log_prob double, mean_log_prob double")


def encode(docs: DataFrame, known: Vocabulary, shard_words: int) -> DataFrame:
    """Written rows of documents as classes (``CODED``)."""
    shards = max(1, -(-known.total // shard_words))
    return materialize(docs.mapInArrow(_encode(known.plain(), shards, shuffle_width(docs)), CODED), "coded")


def score_documents(docs: DataFrame, words: int = 16_384, classes: int = 96, hidden: int = 32, rounds: int = 2, shard_words: int = 1 << 21) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of whole texts under the network that the texts have trained."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = vocabulary(mine, words, classes)
    coded = encode(mine, known, shard_words)
    return score_coded(coded, known, train(coded, known.classes, hidden, rounds), hidden)
