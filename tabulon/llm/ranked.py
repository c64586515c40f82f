"""Ranked lexical search, reversed: the queries are indexed, the documents stream by.

An inverted index over the items' terms (term to items, with repeats) goes to
every task.  A document becomes its term counts, which run through the index;
the scores it reaches update one bounded heap for each item, and the heaps of
all tasks are merged.  No document is indexed, joined or shuffled: a task
hands on at most ``k`` rows for each item.

Two passes over the documents: the first sums what the weights need (documents
with terms, their terms, documents holding each term of the index), the second
scores.  Items are taken in blocks of bounded text (``BLOCK_CHARS``, one item at
least), so the index in a task is bounded; more items mean more blocks.

Defined results: a null or empty text has no terms, a document without terms
counts nowhere, an item without terms has no rows; every document row is ranked,
repeated rows too, equal scores by ``doc_id`` (null last); an item row repeated
with its text is one item, another text under its id an item of its own; long
texts are counted whole, in slices; with an empty table on either side there
are no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabulon.llm.common import text_or_empty

TOP = 10
# Text of the items in one block, in characters; the index of a block holds as many terms at most.
BLOCK_CHARS = 4_000_000
# Bytes of one text that are cut into terms at once, and cells of the score table of a task.
SLICE_BYTES, CELLS = 1 << 22, 1 << 21
# Groups of tasks whose heaps are merged first.
MERGE_GROUPS = 64

# Terms are runs of 0-9, A-Z, a-z and all bytes of other than ASCII characters; only A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size (one term at least)."""
    text = text.translate(_FOLD)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class ItemIndex:
    """Term numbers, and for every term the items that hold it (with the number of times)."""

    def __init__(self, items: list[tuple]):
        self.item_ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        rows = []
        longest = 0
        for at, (_, text) in enumerate(items):
            counts = Counter(t for part in term_slices(text.encode()) for t in part)
            longest = max(longest, sum(counts.values()))
            rows += [(self.number.setdefault(t, len(self.number)), at, n) for t, n in counts.items()]
        rows.sort()
        columns = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.first = np.searchsorted(columns[:, 0], np.arange(len(self.number) + 1))
        self.items, self.repeats = columns[:, 1].copy(), columns[:, 2].copy()
        self.longest = longest
        self.weight = np.zeros(len(self.number), dtype=np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, holding: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        for t in range(len(self.weight)):
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(t, 0) + 1)))

    def counts(self, text: bytes) -> tuple[int, dict[int, int]]:
        """Number of terms of a document, and its counts of the terms that are indexed."""
        n, found = 0, Counter()
        for terms in term_slices(text):
            n += len(terms)
            found.update(map(self.number.get, terms))
        found.pop(None, None)
        return n, found

    def scores(self, docs: list[tuple[int, dict[int, int]]]) -> np.ndarray:
        """Score of every document (rows) for every item."""
        sizes = [len(found) for _, found in docs]
        doc = np.repeat(np.arange(len(docs)), sizes)
        term = np.fromiter((t for _, found in docs for t in found), np.int64, len(doc))
        tf = np.fromiter((c for _, found in docs for c in found.values()), np.int64, len(doc))
        m = np.array([25 + 75 * n * self.n_docs // self.n_terms for n, _ in docs], dtype=np.int64)
        part = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        width = self.first[term + 1] - self.first[term]
        ends = np.cumsum(width)
        at = np.repeat(self.first[term] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(doc, width) * len(self.item_ids) + self.items[at]
        add = np.repeat(part, width) * self.repeats[at]
        total = len(docs) * len(self.item_ids)
        # Doubles add whole numbers exactly below 2^53; beyond it, slower, as integers.
        if self.longest * 1_000_000 * int(self.weight.max(initial=0)) < 1 << 53:
            out = np.bincount(cell, weights=add, minlength=total).astype(np.int64)
        else:
            out = np.zeros(total, dtype=np.int64)
            np.add.at(out, cell, add)
        return out.reshape(len(docs), len(self.item_ids))


class Heaps:
    """The ``k`` best documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.heaps: list[list] = [[] for _ in range(n_items)]
        # What a document has to reach: the least score in a full heap, with at most its document's id.
        self.score, self.doc = np.zeros(n_items, dtype=np.int64), np.full(n_items, -1, dtype=np.int64)

    def offer(self, doc_ids: list, scores: np.ndarray) -> None:
        keys = np.array([np.iinfo(np.int64).max if d is None else d for d in doc_ids], dtype=np.int64)
        good = (scores > self.score) | ((scores == self.score) & (scores > 0) & (keys[:, None] <= self.doc))
        for row, item in zip(*(x.tolist() for x in np.nonzero(good))):
            d = doc_ids[row]
            # The heap's least entry goes first: lowest score, then the largest id, null before all.
            entry = (int(scores[row, item]), d is not None, 0 if d is None else -d)
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.score[item] = heap[0][0]
                self.doc[item] = -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max

    def rows(self) -> Iterator[tuple]:
        for item, heap in enumerate(self.heaps):
            for score, known, least in heap:
                yield item, -least if known else None, score


def _statistics(shipped):
    """value of every statistic of a task: -1 documents, -2 terms, else documents that hold the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = shipped.value, Counter()
        for batch in batches:
            for text in batch.column("text"):
                n, found = index.counts(text.as_buffer().to_pybytes())
                if n:
                    sums[-1] += 1
                    sums[-2] += n
                    sums.update(found.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())],
                                         ["what", "value"])
    return run


def _scorer(shipped, k: int, item_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        heaps = Heaps(len(index.item_ids), k)
        # Groups grow, since empty heaps take whatever comes.
        most, wanted = max(1, CELLS // max(1, len(index.item_ids))), 8
        ids, docs, postings = [], [], 0
        width = np.diff(index.first)

        def flush() -> None:
            nonlocal wanted, postings
            heaps.offer(ids, index.scores(docs))
            ids.clear()
            docs.clear()
            wanted, postings = min(most, wanted * 2), 0

        for batch in batches:
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, found = index.counts(text.as_buffer().to_pybytes())
                if not found:
                    continue
                ids.append(d)
                docs.append((n, found))
                postings += int(width[list(found)].sum())
                if len(ids) >= wanted or postings >= CELLS:
                    flush()
        if ids:
            flush()
        item, doc, score = (list(x) for x in zip(*heaps.rows())) if any(heaps.heaps) else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([index.item_ids[i] for i in item], item_type),
             pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])
    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, chars = [], 0
    for item_id, text in items.select("item_id", text_or_empty().alias("text")).distinct().toLocalIterator():
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest scores above 0 for every row of ``items``."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = []
    for block in _blocks(items):
        index = ItemIndex(block)
        sums = rows.select("text").mapInArrow(_statistics(spark.sparkContext.broadcast(index)), "what long, value long") \
            .groupBy("what").agg(F.sum("value").alias("value"))
        holding = dict(sums.toLocalIterator())  # a row for each term of the block at most
        if not holding.get(-2):
            break
        index.weigh(holding.pop(-1), holding.pop(-2), holding)
        best = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(index), k, to_arrow_type(id_type)),
                               f"item int, item_id {id_type.simpleString()}, doc_id long, score long")
        best = best.withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", "part"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        found.append(best.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
