"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

A unit starts as one symbol per character. The agenda holds every pair of adjacent symbols whose join is a piece, best
score first and leftmost among equals; the top pair is joined, its neighbours' pairs are scored anew, until none is left.
Characters without a piece become byte pieces. No piece holds a space mark behind another character, a line end, or a
sign such as a full stop behind a letter, so texts fall into units that never join; a bounded cache keeps the units
already seen. In each Arrow batch,
the units met for the first time are encoded by the sentencepiece library too, and a difference raises an error.

Defined results: a null or empty text has no tokens and decodes to the empty text. Spaces, control characters and text
that looks like a piece name are ordinary characters. Every row gives one row.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tablekin.llm.common import lean, slices, texts

MARK = "▁"
NONE = 2**31 - 1
#: Units up to so many characters are joined many at once, longer ones one by one.
SHORT, WIDTHS = 40, (6, 9, 12, 16, 24, 40)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; ``cache`` units are remembered."""

    def __init__(self, path: str, cache: int = 250_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        kinds = {i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(size)}
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {pieces[i]: i for i, kind in kinds.items() if kind == "piece"}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i, kind in kinds.items() if kind == "byte"}
        self.raw = [bytes([int(p[3:5], 16)]) if kinds[i] == "byte" else p.encode() if kinds[i] == "piece" else b"" for i, p in enumerate(pieces)]
        self.id_text = list(map(str, range(size)))
        self.id_plain = ["\0" if kinds[i] == "byte" else p.replace(MARK, " ") if kinds[i] == "piece" else "" for i, p in enumerate(pieces)]
        inside = [p for p in self.ids if MARK in p.lstrip(MARK) or "\n" in p]
        if inside or len(self.byte_ids) != 256:
            raise ValueError(f"not a merge vocabulary with byte fallback whose pieces start words: {inside[:5]}")
        signs = re.escape("".join(self._signs()))
        word = f"[^{MARK}\n{signs}]"
        self.units = re.compile(f"{MARK}+[{signs}]*{word}*|[{signs}]+{word}*|{word}+|\n" if signs else f"{MARK}+{word}*|{word}+|\n").findall
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.cache = cache
        self._number_symbols()

    def _signs(self) -> list[str]:
        """Characters that in every piece stand first or behind other signs or space marks: texts may be cut before them."""
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
        signs = {c for p in self.ids for c in p if not c.isalnum() and c != MARK}
        while gone := {c for c in signs if before.get(c, set()) - signs - {MARK}}:
            signs -= gone
        return sorted(signs)

    def _number_symbols(self) -> None:
        """Numbers of all symbols that can occur in a piece, and every pair of them that makes a piece."""
        self.symbols = [*self.ids, *sorted({c for p in self.ids for c in p} - self.ids.keys())]
        number = {s: k for k, s in enumerate(self.symbols)}
        size = self.unknown = len(number)
        self.char_symbol = np.full(0x110000, size, np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = k
        place = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        pairs = sorted(
            (number[p[:k]] * (size + 1) + number[p[k:]], place[self.cost[p]], number[p])
            for p in self.ids
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        )
        self.pair_key, rank, self.pair_made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pair_rank = rank.astype(np.int32)
        self.symbol_id = np.array([self.ids.get(s, -1) for s in self.symbols] + [-1], np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank on the agenda of each pair, and the symbol that it makes."""
        key = a.astype(np.int64) * (self.unknown + 1) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        none = self.pair_key[at] != key
        return np.where(none, NONE, self.pair_rank[at]), self.pair_made[at]

    def merge_many(self, units: list[str]) -> list[list[int] | None]:
        """Ids of many short units at once: each round joins the top pair of every unit's agenda. None: a character has no piece."""
        n, width = len(units), max(map(len, units)) + 1
        length = np.fromiter(map(len, units), np.int64, n)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = np.full((n, width), self.unknown, np.int32)
        symbols[np.arange(width) < length[:, None]] = self.char_symbol[codes]
        rank = np.full((n, width), NONE, np.int32)
        made = np.zeros((n, width), np.int64)
        rank[:, :-1], made[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])
        out, rows = symbols.copy(), np.arange(n)
        columns = np.arange(width)
        while len(rows):
            k = rank.argmin(1)
            each = np.arange(len(rows))
            go = rank[each, k] < NONE
            out[rows[~go]] = symbols[~go]
            rows, symbols, rank, made, k = rows[go], symbols[go], rank[go], made[go], k[go]
            each = np.arange(len(rows))
            joined = made[each, k]
            after = np.minimum(columns + (columns >= k[:, None]), width - 1)
            rank, made = np.take_along_axis(rank, after, 1), np.take_along_axis(made, after, 1)
            after = np.minimum(columns + (columns > k[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, after, 1)
            symbols[each, k] = joined
            length[rows] -= 1
            rank[each, k], made[each, k] = self._pairs(joined, symbols[each, k + 1])
            inner = each[k > 0]
            before = k[inner] - 1
            rank[inner, before], made[inner, before] = self._pairs(symbols[inner, before], joined[inner])
        ids = self.symbol_id[out]
        whole = ((ids >= 0) | (columns >= length[:, None])).all(1)
        return [x[:k] if ok else None for x, k, ok in zip(ids.tolist(), length.tolist(), whole.tolist(), strict=True)]

    def merge(self, unit: str) -> list[str]:
        """Symbols of one unit of any length after all joins; the agenda is a heap."""
        cost, symbols, n = self.cost.get, list(unit), len(unit)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (c := cost(pair := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (c, a, b, pair))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, pair = heapq.heappop(agenda)
            if right[a] != b or not symbols[a] or symbols[a] + symbols[b] != pair:
                continue  # one side was joined meanwhile
            symbols[a], symbols[b] = pair, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(unit):
            if (i := self.ids.get(symbol)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[x] for x in symbol.encode())
        return out

    def prepared(self, text: str) -> list[str]:
        """Units of a text, with the mark that stands before every text."""
        return self.units(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.prepared(text) for i in self.unit_ids(unit)]

    def decode(self, ids: list[int]) -> str:
        """The text; the mark that stands before every text goes."""
        out = b"".join(self.raw[i] for i in ids).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if out[:1] == " " else out

    def learn(self, units: set[str]) -> None:
        """Put the ids of units, as text, into ``known``; the library has to agree.

        ``odd`` has the decoded text of those that do not decode to themselves. Units that were not met for a while go.
        """
        if len(self.known) + len(units) > self.cache:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for u in units:
            if u not in known:
                if (ids := older.get(u)) is not None:
                    known[u] = ids
                else:
                    new.append(u)
        encoded: dict[str, list[int]] = {}
        groups: dict[int, list[str]] = {}
        for u in new:
            groups.setdefault(bisect_left(WIDTHS, len(u)), []).append(u)
        for width, own in groups.items():
            many = self.merge_many(own) if width < len(WIDTHS) else [None] * len(own)
            encoded.update((u, self.unit_ids(u) if ids is None else ids) for u, ids in zip(own, many, strict=True))
        self._compare([u for u in new if u[0] == MARK], encoded)
        number, text = self.id_text, self.id_plain
        for u, ids in encoded.items():
            decoded = "".join([text[i] for i in ids])
            if "\0" in decoded:  # a byte piece
                decoded = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
            known[u] = ",".join([number[i] for i in ids])
            if decoded != u.replace(MARK, " "):
                self.odd[u] = decoded

    def forget(self) -> None:
        """Drop the units that were met: the task's memory belongs to the next one."""
        self.known, self.older, self.odd = {}, {}, {}

    def _compare(self, units: list[str], encoded: dict[str, list[int]]) -> None:
        """The library's ids of the units must be the same."""
        for u, ids in zip(units, self.library.encode([u[1:] for u in units], num_threads=1), strict=True):
            if encoded[u] != ids and len(u) > 1:
                raise AssertionError(f"the library encodes {u!r} as {ids}, not {encoded[u]}")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(path: str, with_ids: bool, per_check: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, 2000):
            size, ids_sha, decoded_sha, all_ids = [], [], [], []
            docs, at, of = texts(batch.column("text")), 0, batch.column("doc_id")
            while at < len(docs):
                units, n = [], 0
                while at + len(units) < len(docs) and n < per_check:
                    units.append(v.prepared(docs[at + len(units)]))
                    n += len(units[-1])
                at += len(units)
                v.learn(set().union(*units))
                known = v.known
                for own in units:
                    ids = ",".join([known[u] for u in own])
                    text = "".join([v.odd.get(u, u) for u in own] if v.odd else own).replace(MARK, " ")
                    size.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256((text[1:] if text[:1] == " " else text).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids.split(",") if ids else [], np.int32))
            columns = [of, pa.array(size, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(columns, names)
        v.forget()

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, per_check: int = 200_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of whole texts; ``path`` is the model file on every worker.

    About ``per_check`` units are looked up, and new ones checked, at a time.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lean(_encode(path, with_ids, per_check)), schema)
