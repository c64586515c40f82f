"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens.  The output is a run of windows; in each
window every source is served its quantum (its target share of the window)
and the fraction that whole tokens cannot express is carried on as a deficit
to the next window.  Carried exactly, the tokens served up to window ``i``
are ``floor(i * quantum)``: a function of ``i`` alone, so every partition
knows the deficits it starts from and works without the others.  The windows
are laid end to end and cut into sequences; nothing is padded but a last
remainder, which is itself cut into lengths that are powers of two.

One pass tokenizes and keeps the ids of each row, compressed, with the place
of the row in its task's part of the source queue; token totals by (task,
source) are the only thing that is gathered; a second pass cuts the pieces.
No ids are shuffled while those totals are small enough to be broadcast
(a checked size); beyond it the totals are joined by shuffle, with the same
result.  One number for each source travels to every task.

Defined results: a null text is an empty text (its end token alone); a null
source is a source of its own, after the others; repeated rows and ids are
packed row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import durable, text_or_empty

SEQUENCE = 1024
END_ID = 0
# Tokens of a window: this many sequences, or one sequence for each source if there are more sources.
WINDOW_SEQUENCES = 64
# Rows of (task, source) totals that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# Fixed value: how byte-level tokenizers of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that every Unicode version classes alike.
_COMMON = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u024f\u2018-\u201e\u2026\u20ac]")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 16-bit bytes.

    The ids are those of the given ``tokenizers`` file.  Where the file is a
    plain byte-level BPE, texts of common characters go through a faster
    engine that is given the file's own vocabulary; all others, texts that
    hold one of the file's added tokens, and every text of another kind of
    file, go through ``tokenizers``.
    """

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a worker for each core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.fast = self._engine(file)
        self.added = [t["content"] for t in file.get("added_tokens", ())]

    @staticmethod
    def _engine(file: dict):
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        if not plain or file.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            return None
        byte, special = _byte_of(), {t["id"] for t in file.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if i not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if [model["vocab"][m.replace(" ", "")] for m in merged] != list(range(256, 256 + len(merged))):
            return None  # the engine takes ids for the order of merges
        import tiktoken
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str) -> "Encoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or _COMMON.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u2").tobytes()


_TOKENS = "doc_id long, source string, task int, at long, n long, ids binary"


def _tokenize(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder, task = Encoder.load(path), TaskContext.get().partitionId()
    press = zstandard.ZstdCompressor(level=1)
    end = END_ID.to_bytes(2, "little")
    used: dict[str | None, int] = {}
    for batch in batches:
        at, sizes, packed = [], [], []
        for text, source in zip(batch.column("text"), batch.column("source").to_pylist(), strict=True):
            ids = encoder.encode(text.as_py()) + end
            at.append(used.get(source, 0))
            used[source] = at[-1] + len(ids) // 2
            sizes.append(len(ids) // 2)
            packed.append(press.compress(ids))
        rows = len(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array([task] * rows, pa.int32()), pa.array(at, pa.int64()),
             pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "source", "task", "at", "n", "ids"])


class Schedule:
    """Where the tokens of every source queue stand in the output.

    ``totals``: tokens by source, in order; ``weights``: target shares (the
    totals by default, so that all queues last to the end).
    """

    def __init__(self, totals: list[int], weights: list[int] | None = None, sequence: int = SEQUENCE):
        self.totals, self.sequence = totals, sequence
        self.total = sum(totals)
        self.weights = [w if t else 0 for w, t in zip(weights or totals, totals, strict=True)]
        if any(w <= 0 for w, t in zip(self.weights, totals, strict=True) if t):
            raise ValueError("every source with tokens needs a positive weight")
        window = sequence * max(WINDOW_SEQUENCES, len(totals))
        # In each window a source gets window * weight / sum(weights) tokens.
        self.quantum, self.parts = window, max(1, sum(self.weights))
        self.tail = self.total - self.total % sequence
        self._layout: dict[int, list[int]] = {}

    def served(self, source: int, window: int) -> int:
        """Tokens of a source served before a window: the carried deficit is what the floor leaves."""
        return min(self.totals[source], window * self.quantum * self.weights[source] // self.parts)

    def layout(self, window: int) -> list[int]:
        """Output position at which each source begins in a window, then the window's end."""
        if window not in self._layout:
            if len(self._layout) > 256:
                self._layout.clear()
            before = [self.served(s, window) for s in range(len(self.totals))]
            self._layout[window] = list(accumulate(
                (self.served(s, window + 1) - b for s, b in enumerate(before)), initial=sum(before)))
        return self._layout[window]

    def place(self, position: int) -> tuple[int, int, int]:
        """Sequence, offset in it, and tokens to its end, of an output position."""
        if position < self.tail:
            s, offset = divmod(position, self.sequence)
            return s, offset, self.sequence - offset
        s, start, left = self.tail // self.sequence, self.tail, self.total - self.tail
        while left:  # the remainder, in powers of two
            size = 1 << (left.bit_length() - 1)
            if position < start + size:
                return s, position - start, start + size - position
            s, start, left = s + 1, start + size, left - size
        raise ValueError("behind the last token")

    def pieces(self, source: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before, length, sequence, offset) of the pieces of queue tokens start .. start + n."""
        window = start * self.parts // (self.quantum * self.weights[source])
        while self.served(source, window + 1) <= start:
            window += 1
        done = 0
        while done < n:
            at = start + done
            while self.served(source, window + 1) <= at:
                window += 1
            position = self.layout(window)[source] + at - self.served(source, window)
            sequence, offset, room = self.place(position)
            length = min(n - done, room, self.served(source, window + 1) - at)
            yield done, length, sequence, offset
            done += length


_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "source string")


def _widen(ids: bytes) -> bytes:
    wide = bytearray(2 * len(ids))
    wide[0::4], wide[1::4] = ids[0::2], ids[1::2]
    return bytes(wide)


def _cut(batches: Iterator[pa.RecordBatch], schedule: Schedule, order: dict[str | None, int]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    names = ("doc_id", "source", "base", "at", "n", "ids")
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, source, base, at, n, ids in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            wide = _widen(unpress.decompress(ids))
            for start, length, sequence, offset in schedule.pieces(order[source], base + at, n):
                rows.append((doc_id, start, length, zlib.crc32(memoryview(wide)[4 * start:4 * (start + length)]), n,
                             sequence, offset, source))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.string())],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])


def pack_documents(docs: DataFrame, weights: dict[str | None, int] | None = None, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    tokens = durable(rows.mapInArrow(lambda it: _tokenize(it, path), _TOKENS))
    parts = durable(tokens.groupBy("task", "source").agg(F.sum("n").alias("n")))
    by_source = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sources = sorted((s for s in by_source if s is not None)) + [s for s in by_source if s is None]
    order = {s: i for i, s in enumerate(sources)}
    totals = [by_source[s] for s in sources]
    schedule = Schedule(totals, None if weights is None else [weights.get(s, 0) for s in sources])
    # Queue position of every task's first token of a source.
    base = parts.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("task")) - F.col("n"))
    small = base.select(F.col("task").alias("_t"), F.col("source").alias("_s"), "base")
    if parts.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    placed = tokens.join(small, (F.col("task") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))) \
        .select("doc_id", "source", "base", "at", "n", "ids")
    shared = spark.sparkContext.broadcast((schedule, order))
    return placed.mapInArrow(lambda it: _cut(it, *shared.value), _PIECES)
