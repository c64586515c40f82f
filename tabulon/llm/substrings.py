"""Substring dedup by level-wise doubling.

A passage is a window of ``length`` words.  The first level looks at windows
of half that length, at positions chosen by their content so that every
passage holds one and equal passages hold the same ones (local minima of the
window hash).  Only half windows that occur in two documents survive, and
only passages whose least half window survived are extended to the full
length.  There, the smallest document of every passage is its owner; a word
of any other document that such a passage covers is removed.  Further
doublings cannot change which words go (a longer repeat is covered by its
passages); :func:`longest_levels` carries them on to report lengths.

Exact copies of a smaller document are settled first, by text hash, so a
group of copies enters the levels once.  Only hashes move; texts move for
documents that hold a surviving window.  Grouping keeps a minimum and a
maximum for each hash and is combined before every shuffle.

Defined results: a null text has no words; a row with a null ``doc_id`` has
no smaller document and is none, so it stays whole; rows that repeat a
``doc_id`` do not remove each other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.buffers import chunks, text_buffer, window_hashes, word_hashes, word_spans
from tabulon.llm.common import durable, text_or_empty

LENGTH = 50
# Documents whose keys may be broadcast to pick the texts that go on (about 40 bytes each).
BROADCAST_DOCS = 500_000

_SECOND = 0xC2B2AE3D27D4EB4F  # base of the second hash of a passage


def _running(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    rest = width - done
    if rest:
        out = pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def chosen(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Marks the minima of every run of ``width`` window hashes inside a document.

    ``first``: index of each document's first hash (one more at the end).
    """
    n = len(hashes)
    low = _running(hashes, width, np.minimum)
    valid = np.zeros(n, dtype=bool)
    sizes = np.diff(first)
    runs = np.maximum(sizes - width + 1, 0)
    total = int(runs.sum())
    valid[np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(total)] = True
    least = np.zeros(n + width - 1, dtype=np.uint64)  # padded in front, so that position p sees runs p-width+1 .. p
    least[width - 1:width - 1 + len(low)] = np.where(valid[:len(low)], low, 0)
    return (_running(least, width, np.maximum) == hashes) & (hashes > 0)


def _levels(length: int) -> tuple[int, int]:
    half = max(1, length // 2)
    return half, length - half + 1


def _hash_documents(raw: np.ndarray, offsets: np.ndarray, length: int):
    """First word of each document; the half windows by document, with the chosen ones marked."""
    half, width = _levels(length)
    starts, ends, first = word_spans(raw, offsets)
    hashes, _ = window_hashes(word_hashes(raw, starts, ends), first, half)
    at = np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - half + 1, 0))))
    return first, hashes, at, chosen(hashes, at, width)


_SCANNED = "doc_id long, h1 long, h2 long, n_words long, sha string, anchors array<long>"


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in chunks(offsets):
            part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            first, hashes, windows, marked = _hash_documents(part, at, length)
            where = np.flatnonzero(marked)
            doc = np.searchsorted(windows, where, side="right") - 1
            order = np.lexsort((hashes[where], doc))
            doc, value = doc[order], hashes[where][order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            doc, value = doc[new], value[new]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)),
                                             pa.array(value.view(np.int64)))
            sha = [hashlib.sha256(b" ".join(part[at[d]:at[d + 1]].tobytes().split())).hexdigest() for d in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(a, b - a) for c in ("doc_id", "h1", "h2")]
                + [pa.array(np.diff(first)), pa.array(sha), lists], ["doc_id", "h1", "h2", "n_words", "sha", "anchors"])


_WINDOWS = "doc_id long, h1 long, pos int, w1 long, w2 long"


def _passages(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Full windows whose least half window is among the document's surviving ones."""
    half, width = _levels(length)
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        survivors = batch.column("anchors")
        for d in range(batch.num_rows):
            part = raw[offsets[d]:offsets[d + 1]]
            starts, ends, first = word_spans(part, np.array([0, len(part)]))
            words = word_hashes(part, starts, ends)
            if len(words) < length:
                continue
            hashes, _ = window_hashes(words, first, half)
            least = _running(hashes, width, np.minimum)
            pos = np.flatnonzero(np.isin(least, np.asarray(survivors[d].values, dtype=np.int64).view(np.uint64)))
            if not len(pos):
                continue
            w1, _ = window_hashes(words, first, length)
            w2, _ = window_hashes(words, first, length, _SECOND)
            for s in range(0, len(pos), 1 << 16):
                p = pos[s:s + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("doc_id")[d].as_py()] * len(p), pa.int64()),
                     pa.array([batch.column("h1")[d].as_py()] * len(p), pa.int64()), pa.array(p.astype(np.int32)),
                     pa.array(w1[p].view(np.int64)), pa.array(w2[p].view(np.int64))], ["doc_id", "h1", "pos", "w1", "w2"])


_CUT = "doc_id long, h1 long, n_removed long, kept_sha256 string, kept_text string"


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        removed, sha, kept = [], [], []
        for d in range(batch.num_rows):
            words = raw[offsets[d]:offsets[d + 1]].tobytes().split()
            pos = np.asarray(batch.column("positions")[d].values, dtype=np.int64)
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(cover, pos, 1)
            np.add.at(cover, pos + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            left = b" ".join([words[i] for i in np.flatnonzero(~gone)])
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode() if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h1"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
             pa.array(kept, pa.string())], ["doc_id", "h1", "n_removed", "kept_sha256", "kept_text"])


def _owned(rows: DataFrame, key: list[str], own: str = "lo") -> DataFrame:
    """Keys that occur in two documents, with the smallest of them."""
    return rows.groupBy(*key).agg(F.min("doc_id").alias(own), F.max("doc_id").alias("hi")) \
        .where(F.col(own) < F.col("hi")).drop("hi")


class _Found:
    """The tables of one run: per-document rows, documents that go on, repeated passages."""

    def __init__(self, docs: DataFrame, length: int):
        text = text_or_empty()
        rows = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))
        self.scanned = durable(rows.mapInArrow(lambda it: _scan(it, length), _SCANNED))
        known = self.scanned.where(F.col("doc_id").isNotNull())
        first = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        self.owned = self.scanned.join(first, ["h1", "h2"], "left")
        lead = self.owned.where(F.col("doc_id") == F.col("owner")).select("doc_id", "h1", "anchors")

        half = lead.select("doc_id", "h1", F.explode("anchors").alias("anchor"))
        alive = _owned(half, ["anchor"]).drop("lo")
        marks = durable(half.join(alive, "anchor").groupBy(F.col("doc_id").alias("_id"), F.col("h1").alias("_h"))
                        .agg(F.collect_set("anchor").alias("anchors")))
        keys = marks.select("_id", "_h")
        if marks.count() <= BROADCAST_DOCS:
            keys = F.broadcast(keys)
        same = (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h"))
        texts = rows.select("doc_id", "h1", "text").join(keys, same, "left_semi").dropDuplicates(["doc_id", "h1"])
        self.texts = durable(texts)
        self.windows = self.texts.join(marks, same).select("doc_id", "h1", "text", "anchors") \
            .mapInArrow(lambda it: _passages(it, length), _WINDOWS)
        self.repeated = self.windows.join(_owned(self.windows, ["w1", "w2"]), ["w1", "w2"])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, null where nothing went), a row for each row of ``docs``."""
    found = _Found(docs, length)
    flagged = found.repeated.where(F.col("doc_id") > F.col("lo")).groupBy(
        F.col("doc_id").alias("_id"), F.col("h1").alias("_h")).agg(F.collect_list("pos").alias("positions"))
    cut = found.texts.join(flagged, (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h"))) \
        .select("doc_id", "h1", "text", "positions").mapInArrow(lambda it: _cut(it, length, with_text), _CUT) \
        .select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h"), F.col("n_removed").alias("_n"),
                F.col("kept_sha256").alias("_sha"), "kept_text")
    out = found.owned.join(cut, (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h")), "left")
    copy = F.coalesce((F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= length), F.lit(False))
    cols = ["doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256")]
    if with_text:
        cols.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*cols)


def longest_levels(docs: DataFrame, length: int = LENGTH, max_level: int = 1 << 20) -> DataFrame:
    """doc_id, level: the longest doubled length at which a document still
    repeats a window of another one.  Levels go on until nothing survives;
    a window of twice the length survives where both its halves did."""
    found = _Found(docs, length)
    level, rows = length, durable(found.repeated.select("doc_id", "h1", "pos", "w1", "w2"))
    out = rows.select("doc_id", F.lit(level).alias("level")).distinct()
    while level < max_level:
        ahead = rows.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h"), (F.col("pos") - level).alias("_p"),
                            F.col("w1").alias("v1"), F.col("w2").alias("v2"))
        double = rows.join(ahead, (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h")) & (F.col("pos") == F.col("_p"))) \
            .select("doc_id", "h1", "pos", F.xxhash64("w1", "v1").alias("w1"), F.xxhash64("w2", "v2", F.lit(1)).alias("w2"))
        level *= 2
        rows = durable(double.join(_owned(double, ["w1", "w2"]), ["w1", "w2"]).select("doc_id", "h1", "pos", "w1", "w2"))
        if rows.isEmpty():
            break
        out = out.unionByName(rows.select("doc_id", F.lit(level).alias("level")).distinct())
    return out.groupBy("doc_id").agg(F.max("level").alias("level"))
