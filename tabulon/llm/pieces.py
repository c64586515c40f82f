"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols of one character each.  Every adjacent pair whose
concatenation is a piece goes on an agenda ordered by the piece's score (equal
scores: the leftmost pair); the best pair is merged and forms new pairs with
its neighbours, until the agenda is empty.  An entry whose symbols have been
merged since is passed over.  Symbols that are no piece become bytes.

When no piece holds a word start after another character, no merge crosses a
word start, so the agenda runs once for each distinct word of a group of
texts.  Every group is also encoded by the sentencepiece library, and
``agrees`` says for each text whether both gave the same ids.

Defined results: a null text is empty and has no ids; every row is encoded by
itself, so repeated rows give repeated rows and a null ``doc_id`` stays; long
texts and long words are encoded whole (a word of n characters takes about
n log n steps); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tabulon.llm.buffers import Rolling, mix
from tabulon.llm.common import text_or_empty

SPACE_MARK = "▁"
_BASE, _SLOT_BITS = 0x9E3779B97F4A7C15, 20
# Words longer than this have an agenda of their own (a heap); shorter ones advance together.
LONG_WORD = 64
# Texts are taken together up to this many characters (one text at least).
GROUP_CHARS = 1 << 21


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


class PieceModel:
    """A vocabulary of scored pieces; refuses models that are not of merge type.

    A symbol is the id of its piece; a character that is no piece is the
    vocabulary's size plus its code point."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the model is not of merge type")
        kinds = proto.SentencePiece
        if any(p.type == kinds.UNUSED for p in proto.pieces):
            raise ValueError("models with unused pieces are not supported")
        self.size, self.unknown = len(proto.pieces), self.library.unk_id()
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.fixed = {p.piece for p in proto.pieces if p.type == kinds.USER_DEFINED}

        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        scores = np.array([p.score for p in proto.pieces])
        pairs = [(self._pair(left, right), i) for piece, i in self.ids.items() for cut in range(1, len(piece))
                 for left, right in [(self._symbol(piece[:cut]), self._symbol(piece[cut:]))]
                 if left is not None and right is not None]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.merged = np.array([i for _, i in pairs] or [0], dtype=np.int64)
        self.scores = scores[self.merged]
        # Pairs by slot of their key: the first one, and from each the next of its slot.
        slots = _slot(self.keys)
        order = np.argsort(slots, kind="stable")
        same = slots[order[1:]] == slots[order[:-1]]
        self.slot, self.chain = np.full(1 << _SLOT_BITS, -1), np.full(len(self.keys), -1)
        self.slot[slots[order[::-1]]] = order[::-1]
        self.chain[order[:-1][same]] = order[1:][same]
        self.pair = dict(zip(self.keys.tolist(), zip(self.merged.tolist(), (-self.scores).tolist())))

        # No merge crosses a word start if no piece holds one after another character.
        self.parted = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        longest_first = sorted(self.fixed, key=len, reverse=True)
        self.cuts = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    @staticmethod
    def _pair(left, right):
        return (left << 21) | right

    def _symbol(self, part: str) -> int | None:
        return self.ids.get(part, self.size + ord(part) if len(part) == 1 else None)

    def merge_word(self, symbols: list[int]) -> list[int]:
        """The symbols that are left of one word: an agenda of pairs as a heap.  Used for long words."""
        last = len(symbols)
        symbols = list(symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        agenda: list[tuple] = []

        def offer(a: int, b: int) -> None:
            found = self.pair.get(self._pair(symbols[a], symbols[b]))
            if found:
                heapq.heappush(agenda, (found[1], a, b, symbols[a], symbols[b], found[0]))

        for i in range(last - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, x, y, piece = heapq.heappop(agenda)
            if symbols[left] != x or symbols[right] != y or after[left] != right:
                continue  # merged since
            symbols[left], symbols[right] = piece, -1
            end = after[left] = after[right]
            if end < last:
                before[end] = left
                offer(left, end)
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s >= 0]

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and piece of every pair (no piece: minus infinity)."""
        key = self._pair(left, right)
        at = self.slot[_slot(key)]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != key))
        while len(wrong):
            at[wrong] = self.chain[at[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != key[wrong])]
        return np.where(at >= 0, self.scores[at], -np.inf), self.merged[at]

    def merge_words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of many words (one after the other) and their numbers.

        The agendas of all words advance together: each round merges the best
        pair of every word, the leftmost of equal ones."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(symbols))  # where a symbol began, for the order at the end
        score, piece = np.full(len(symbols), -np.inf), np.zeros(len(symbols), dtype=np.int64)
        score[:-1], piece[:-1] = self._offers(symbols[:-1], symbols[1:])
        score[:-1][word[1:] != word[:-1]] = -np.inf
        done: list[tuple] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(word))))
            open_ = best > -np.inf
            if not open_.any():
                break
            top = np.flatnonzero((score == best) & open_)
            top = top[np.concatenate(([True], word[top[1:]] != word[top[:-1]]))]
            symbols[top] = piece[top]
            keep = np.ones(len(symbols), dtype=bool)
            keep[top + 1] = False
            if open_.sum() < len(open_) * 3 // 4:  # words whose agenda is empty are laid aside
                done.append((symbols[~open_], word[~open_], place[~open_]))
                keep &= open_
            at = (np.cumsum(keep) - 1)[top]
            symbols, word, place, score, piece = (x[keep] for x in (symbols, word, place, score, piece))
            left = np.concatenate((at - 1, at))
            left = left[(left >= 0) & (left < len(symbols) - 1)]
            s, p = self._offers(symbols[left], symbols[left + 1])
            s[word[left] != word[left + 1]] = -np.inf
            score[left], piece[left] = s, p
            if len(at) and at[-1] == len(symbols) - 1:
                score[-1] = -np.inf
        done.append((symbols, word, place))
        symbols, word, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return symbols[order], np.bincount(word, minlength=len(lengths))

    def _bytes(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters that are no piece become bytes (or the unknown id)."""
        odd = symbols >= self.size
        if not odd.any():
            return symbols, lengths
        chars, which = np.unique(symbols[odd], return_inverse=True)
        spelled = [[self.bytes[b] for b in chr(c - self.size).encode()] if self.bytes else [self.unknown] for c in chars]
        width = np.ones(len(symbols), dtype=np.int64)
        width[odd] = np.array([len(x) for x in spelled])[which]
        out = np.repeat(symbols, width)
        starts = (np.cumsum(width) - width)[odd]
        for k in range(4):
            has = np.array([len(x) > k for x in spelled])[which]
            out[starts[has] + k] = np.array([x[k] if len(x) > k else 0 for x in spelled])[which[has]]
        ends = np.cumsum(lengths)
        total = np.concatenate(([0], np.cumsum(width)))
        return out, total[ends] - total[ends - lengths]

    def _word_starts(self, texts: list[str], points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and which of them are fixed symbols."""
        start, fixed = np.zeros(len(points) + 1, dtype=bool), np.zeros(len(points) + 1, dtype=bool)
        if self.parted:
            mark = points == ord(SPACE_MARK)
            start[:-1] = mark
            start[1:-1] &= ~mark[:-1]
        start[at] = True
        if self.cuts is not None:
            for text, begin in zip(texts, at.tolist()):
                for m in self.cuts.finditer(text):
                    start[begin + m.start():begin + m.end()] = False
                    start[[begin + m.start(), begin + m.end()]] = fixed[begin + m.start()] = True
        begin = np.flatnonzero(start[:-1])
        return begin, fixed[begin]

    def encode(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts (one after the other) and the offsets of the texts."""
        points = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.concatenate(([0], np.cumsum([len(t) for t in normal]))).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(normal) + 1, np.int64)
        begin, fixed = self._word_starts(normal, points, at)
        size = np.diff(np.append(begin, len(points)))
        own, codes = self._distinct(points, begin, size)
        lengths = size[own]
        symbols = self.symbol_of[points[_runs(begin[own], lengths)]]
        fixed = fixed[own]
        alone = (lengths > LONG_WORD) | fixed
        parts = np.repeat(alone, lengths)
        joined, counts = self.merge_words(symbols[~parts], lengths[~alone])
        if alone.any():
            ends = np.cumsum(lengths)
            merged = [[self.ids["".join(map(chr, points[begin[own[i]]:begin[own[i]] + lengths[i]]))]] if fixed[i] else
                      self.merge_word(symbols[ends[i] - lengths[i]:ends[i]].tolist()) for i in np.flatnonzero(alone)]
            lengths[~alone], lengths[alone] = counts, [len(x) for x in merged]
            parts = np.repeat(alone, lengths)
            symbols = np.empty(len(parts), dtype=np.int64)
            symbols[~parts], symbols[parts] = joined, list(chain.from_iterable(merged))
        else:
            symbols, lengths = joined, counts
        ids, lengths = self._bytes(symbols, lengths)
        starts = np.cumsum(lengths) - lengths
        width = lengths[codes]
        before = np.concatenate(([0], np.cumsum(width)))
        return ids[_runs(starts[codes], width)].astype(np.int32), before[np.searchsorted(begin, at)]

    @staticmethod
    def _distinct(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and the kind of every word (by hash, then compared)."""
        hashes = mix(Rolling(points.astype(np.uint64) + np.uint64(1), _BASE).ranges(begin, begin + size) ^ size.astype(np.uint64))
        _, own, codes = np.unique(hashes, return_index=True, return_inverse=True)
        first = own[codes]
        if (size[first] == size).all() and (points == points[_runs(begin[first], size)]).all():
            return own, codes
        return np.arange(len(begin)), np.arange(len(begin))  # two words of one hash: every word by itself


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``GROUP_CHARS`` together (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > GROUP_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _encoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            for a, b in _groups(pc.utf8_length(batch.column("text")).to_pylist()):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                ids, at = model.encode(model.library.normalize(texts))
                agrees = [np.array_equal(ids[at[i]:at[i + 1]], y) for i, y in enumerate(model.library.encode(texts, num_threads=1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                     pa.array(agrees, pa.bool_())], ["doc_id", "ids", "agrees"])
    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int>, agrees boolean (the library gives the same ids): one row for each row of ``docs``."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(_encoder(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, agrees boolean")


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
            for a, b in _groups(sizes):
                flat = batch.column("ids").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                ids = np.split(flat, np.cumsum(sizes[a:b])[:-1])
                decoded = pa.array(library.decode(ids, num_threads=1), pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])
    return run


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of their ``ids`` (no ids or null: empty)."""
    if "decoded" in rows.columns:
        rows = rows.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_decoder(model), f"{fields}, decoded string")


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, agrees."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(docs, model), model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
