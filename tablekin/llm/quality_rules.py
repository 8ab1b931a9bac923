"""Quality rules as weak supervision: rules vote good, bad or abstain; EM learns how accurate each rule is.

Every document is reduced to counts in one pass. The rules turn them into a vote code, of which there are at most
3 ** len(RULES); documents are counted per code, EM runs on these counts, and the posterior of a code is the quality
probability of its documents. No single rule rejects a document.

Defined results: a null or empty text has no words, fails the base test and is rejected; every row comes out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import ASCII_SPACE, cover, lean, slices, texts
from tablekin.session import materialize

# fixed values: characters that count as symbols
SYMBOLS = "#*$%&|<>"
# fixed values: frequent short words of English, German, French and Spanish
STOPWORDS = frozenset(
    "the of and to in a is that it for on was with as by are this be at or an from "
    "der die und das den von zu mit ist ein eine des im nicht auf als auch "
    "le la les de des et un une est en que qui dans pour pas sur "
    "el los las y del se por con no su al lo".encode().split()
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_upper", "n_letters", "n_distinct", "n_lines", "n_exclaim"]
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
_OTHER = re.compile(r"[^\W\d_]+")

#: Each rule reads the counts (as shares) and gives -1 (bad), 0 (abstain) or 1 (good).
RULES = {
    "word length": lambda c: _vote(c["word_chars"] / c["w"], (3.0, 10.0), (2.0, 14.0)),
    "symbols": lambda c: _vote(c["n_symbols"] / c["w"], (0, 0.05), (0, 0.25)),
    "repeated lines": lambda c: _vote(c["n_dup_lines"] / np.maximum(c["n_lines"], 1), (0, 0.1), (0, 0.35)),
    "repeated words": lambda c: _vote(c["n_repeat_words"] / c["w"], (0, 0.1), (0, 0.4)),
    "upper case": lambda c: _vote(c["n_upper"] / np.maximum(c["n_letters"], 1), (0, 0.15), (0, 0.5)),
    "letters": lambda c: _vote(c["n_letters"] / np.maximum(c["word_chars"], 1), (0.85, 1.01), (0.65, 1.01)),
    "stop words": lambda c: _vote(c["n_stop"] / c["w"], (0.06, 1.01), (0.01, 1.01)),
    "exclamations": lambda c: _vote(c["n_exclaim"] / c["w"], (0, 0.1), (0, 0.5)),
}


def _vote(value: np.ndarray, good: tuple[float, float], fair: tuple[float, float]) -> np.ndarray:
    """Good inside ``good``, bad outside ``fair``, abstain between."""
    return np.where((value >= good[0]) & (value <= good[1]), 1, np.where((value < fair[0]) | (value > fair[1]), -1, 0))


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words inside windows that occur at least twice; ``ids`` numbers equal words alike."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, base = ids[:n], int(ids.max()) + 1
    for k in range(1, window):
        if base * (int(key.max()) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[1:] = same
    again[:-1] |= same
    return int(cover(len(ids), order[again], window).sum())


def count(text: str) -> list[int]:
    """The counts of one text, in the order of COUNTS."""
    raw = text.encode()
    words = raw.split()
    number = {w: k for k, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    seen: set[str] = set()
    dup_lines = n_lines = 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            n_lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    symbols = [raw.count(s.encode()) for s in SYMBOLS]
    return [
        len(words),
        len(text) - sum(raw.count(s.encode()) for s in ASCII_SPACE),
        sum(symbols),
        dup_lines,
        repeated_words(ids),
        sum(map(STOPWORDS.__contains__, raw.lower().split())),
        len(text) - len(_UPPER.sub("", text)),
        len(text) - len(_OTHER.sub("", text)),
        len(number),
        n_lines,
        raw.count(b"!"),
    ]


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def vote_codes(counts: dict[str, np.ndarray]) -> np.ndarray:
    """All votes of a document as one number in base 3."""
    c = counts | {"w": np.maximum(counts["n_words"], 1)}
    code = np.zeros(len(c["w"]), np.int64)
    for rule in RULES.values():
        code = code * 3 + rule(c) + 1
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """A row of votes for each code."""
    power = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return (np.asarray(codes, np.int64)[:, None] // power) % 3 - 1


def fit_accuracies(codes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """EM for how often each rule votes bad, abstains or votes good on bad and on good documents, and the share of good ones.

    Votes are assumed to be independent given the class. A passed rule says little, as most bad documents pass most
    rules; a failed one says much if good documents seldom fail it: both follow from the counts. EM starts from documents
    with a bad vote as probably bad; a rule whose bad votes would come more often from good documents is held at equal.
    Returns the probabilities [class, rule, vote + 1] and the share of good documents.
    """
    votes, weights = votes_of(codes), np.asarray(weights, float)
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    p = np.where((votes < 0).any(1), 0.1, 0.95)
    chance, good = np.full((2, len(RULES), 3), 1 / 3), 0.8
    for _ in range(rounds):
        good = float(np.clip(((weights * p).sum() + 4) / (weights.sum() + 5), 0.05, 0.99))
        each = np.stack([np.tensordot(weights * q, cast, 1) + [0.05, 0.1, 0.5] for q in (1 - p, p)])
        new = each / each.sum(2, keepdims=True)
        wrong = new[0, :, 0] < new[1, :, 0]
        new[:, wrong] = new[:, wrong].mean(0)
        moved = np.abs(new - chance).max()
        chance = new
        p = posterior(votes, chance, good)
        if moved < 1e-9:
            break
    return chance, good


def posterior(votes: np.ndarray, chance: np.ndarray, good: float) -> np.ndarray:
    """Probability that a document with these votes is good."""
    each = np.log(chance[1]) - np.log(chance[0])
    odds = np.log(good / (1 - good)) + each[np.arange(len(RULES)), votes + 1].sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    found = np.array([count(t) for t in texts(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
    return {n: found[:, k] for k, n in enumerate(COUNTS)}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts = _rows(batch)
        columns = {"doc_id": batch.column("doc_id")} | {n: pa.array(v) for n, v in counts.items()}
        yield pa.record_batch(columns | {"base_failed": pa.array(base_failed(counts)), "code": pa.array(vote_codes(counts))})


def rate_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, code), written once."""
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, code long"
    return materialize(docs.select("doc_id", "text").mapInArrow(lean(_features), schema), "ratings")


def quality_model(rated: DataFrame) -> dict[int, float]:
    """Posterior of each vote code that occurs; at most 3 ** len(RULES) codes reach the driver."""
    rows = sorted((r["code"], r["n"]) for r in rated.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())
    codes, weights = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 2
    chance, good = fit_accuracies(codes, weights)
    return dict(zip(codes.tolist(), posterior(votes_of(codes), chance, good).tolist(), strict=True))


def score_documents(docs: DataFrame) -> DataFrame:
    """The ratings with quality (posterior probability) and kept."""
    rated = rate_documents(docs)
    model = quality_model(rated)
    spark = docs.sparkSession
    table = spark.createDataFrame([*model.items()], "code long, quality double")
    scored = rated.join(F.broadcast(table), "code", "left")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text passes, columns unchanged."""
    good = [c for c, p in quality_model(rate_documents(docs)).items() if p >= 0.5]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = _rows(batch)
            yield batch.filter(pa.array(~base_failed(counts) & np.isin(vote_codes(counts), good)))

    return docs.mapInArrow(lean(judge), docs.schema)
