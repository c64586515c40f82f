"""Near-duplicate documents by ProbMinHash.

A text is a distribution over its shingles of five words (weight: number of
occurrences).  Every shingle is a Poisson process whose rate is its weight;
an arrival falls into a random register, and a register keeps the shingle
that arrives first.  A shingle's process ends once its next arrival is later
than the latest register (early termination).  Two registers agree with the
probability Jaccard similarity of the texts.  Registers are banded into
bucket keys; texts that share a bucket are candidates and are verified by
the exact probability Jaccard similarity of their shingles.

No bucket is expanded into pairs.  Verification takes two waves.  In the first
every text goes, with its shingles, to the largest of its buckets; in the
second only the buckets that still hold texts of several classes are looked
at.  A task gets the texts of one bucket, indexes their shingles, and compares
a text with all others at once; it hands on the links that join two classes,
and ends when every class but one has been compared, so a bucket of copies
costs one comparison.  A large bucket is cut into blocks of bounded size: in
the first wave its first text goes to all its blocks, in the second all pairs
of blocks meet.  Links form classes by alternating star contractions.

Exact copies are one text from the start.  What is joined by shuffle stays
splittable (joins on keys, sums combined before the shuffle); working tables
are checkpointed.

Defined results: texts without a word (or null) are classes of their own;
texts of fewer than five words have one shingle, their words; the class id
is the smallest ``doc_id`` of the class (null if it has none); repeated rows
share a class; an empty table gives no rows; extra columns are ignored by
:func:`near_duplicates` and carried by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.buffers import chunks, mix, text_buffer, window_hashes, word_hashes, word_spans
from tabulon.llm.common import clear_prefix, durable, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
# Similarities are sums of doubles: texts exactly at the threshold are linked.
TIE = 1e-9
# Texts of similarity 0.8 share one of the 20 buckets with probability 0.998, of 0.5 with 0.27.
BANDS, ROWS = 20, 6
REGISTERS = BANDS * ROWS
# Texts, and distinct shingles, of a block of a bucket (on average; one text at least).
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 18
# Entries of a block's index that are looked at together.
STEP = 1 << 18
# Keys that may be broadcast to pick the texts that go on (about 50 bytes each).
BROADCAST_DOCS = 500_000

_STEP, _PICK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document, their counts, and each document's first one (one more at the end)."""
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    hashes, _ = window_hashes(words, first, size)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), np.maximum(n_words - size + 1, 0))
    for length in range(1, size):  # short texts: all their words
        short = np.flatnonzero(n_words == length)
        if len(short):
            value = np.full(len(short), np.uint64(length))
            for k in range(length):
                value = mix(value * _STEP + words[first[short] + k])
            hashes, doc = np.concatenate([hashes, value]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(doc)))
    return hashes[at], counts, np.searchsorted(doc[at], np.arange(len(n_words) + 1))


def registers(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in every register of every document (0 where there is none)."""
    n = len(first) - 1
    time, owner = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    el, rate, t = hashes, counts.astype(np.float64), np.zeros(len(hashes))
    k = 0
    while len(el):
        k += 1
        draw = mix(el + np.uint64(k * int(_STEP) % (1 << 64)))
        # Uniform on (0, 1]; the gap to the next arrival is exponential.
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / rate
        slot = doc * m + (mix(draw ^ _PICK) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(t < time[slot])
        np.minimum.at(time, slot[early], t[early])
        won = early[t[early] == time[slot[early]]]
        owner[slot[won]] = el[won]
        latest = time.reshape(n, m).max(1)
        go = t < latest[doc]
        el, rate, t, doc = el[go], rate[go], t[go], doc[go]
    return owner.reshape(n, m)


def band_keys(owner: np.ndarray) -> np.ndarray:
    """A key for every band of every document."""
    n = len(owner)
    parts = owner.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _PICK, (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * _STEP + parts[:, :, r])
    return key


_SIGNED = "doc_id long, node binary, n_words int, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in chunks(offsets, 1 << 20):
            hashes, counts, first = shingles(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            full = np.diff(first) > 0
            keys = band_keys(registers(hashes, counts, first))[full].view(np.int64).reshape(-1)
            ends = np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("node").slice(a, b - a),
                 pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                ["doc_id", "node", "n_words", "bands"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in chunks(offsets):
            hashes, counts, first = shingles(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            ends = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(a, b - a), pa.array(np.diff(first).astype(np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))),
                 pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], ["node", "size", "grams", "counts"])


def probability_jaccard(ga: np.ndarray, ca: np.ndarray, gb: np.ndarray, cb: np.ndarray) -> float:
    """Exact similarity of two distributions given by distinct shingles and counts."""
    _, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = ca[ia].astype(np.float64), cb[ib].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)  # sum of x from here on
    below = np.insert(np.cumsum(y), 0, 0.0)           # sum of y before here
    at = np.searchsorted(ratio, ratio, side="left")   # equal ratios count with x
    from_a = float(ca.sum()) - float(x.sum()) + above[at]
    from_b = float(cb.sum()) - float(y.sum()) + below[at]
    return float((1.0 / (from_a / x + from_b / y)).sum())


class _Block:
    """Texts of one bucket with an index of their shingles."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, first: np.ndarray):
        self.grams, self.counts, self.first = grams, counts, first
        self.n, self.sizes = len(first) - 1, np.diff(first)
        text = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)
        self.share = counts / np.add.reduceat(counts, first[:-1])[text] if len(counts) else np.zeros(0)
        self.flat = np.ones(self.n, dtype=bool)  # every shingle once
        self.flat[text[counts > 1]] = False
        order = np.argsort(grams, kind="stable")
        held = grams[order]
        new = np.concatenate(([True], held[1:] != held[:-1]))
        number = np.cumsum(new) - 1
        self.number = np.empty(len(grams), dtype=np.int32)
        self.number[order] = number
        self.begin = np.append(np.flatnonzero(new), len(held)).astype(np.int64)
        self.holders, self.holder_share = text[order], self.share[order]

    def linked(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """The texts of ``others`` whose similarity to text ``i`` reaches the threshold."""
        a, b = self.first[i], self.first[i + 1]
        number, share = self.number[a:b], self.share[a:b]
        width = self.begin[number + 1] - self.begin[number]
        mine, theirs, common = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n, dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(width), np.arange(STEP, width.sum() + STEP, STEP))
        for part in np.split(np.arange(b - a), np.unique(cuts[cuts < b - a])):
            w = width[part]
            at = np.repeat(self.begin[number[part]] - np.cumsum(w) + w, w) + np.arange(w.sum())
            met = self.holders[at]
            mine += np.bincount(met, np.repeat(share[part], w), self.n)
            theirs += np.bincount(met, self.holder_share[at], self.n)
            common += np.bincount(met, minlength=self.n)
        # Similarity is at most the share of either text's weight that the common shingles have.
        others = others[(mine[others] >= threshold - TIE) & (theirs[others] >= threshold - TIE)]
        sim = common[others] / (self.sizes[i] + self.sizes[others] - common[others])
        for k in np.flatnonzero(~(self.flat[others] & self.flat[i])):
            c, d = self.first[others[k]], self.first[others[k] + 1]
            sim[k] = probability_jaccard(self.grams[a:b], self.counts[a:b], self.grams[c:d], self.counts[c:d])
        return others[sim >= threshold - TIE]

    def links(self, labels: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Links that join the classes ``labels``: no text of one class at the end is linked to one of another."""
        label, out, done = labels.copy(), [], np.zeros(self.n, dtype=bool)
        while True:
            classes, of = np.unique(label, return_inverse=True)
            waiting = np.bincount(of[~done], minlength=len(classes))
            if len(classes) == 1 or (waiting > 0).sum() <= 1:
                return out
            # A class that is not the largest of those that wait, the one with the least left to compare.
            waits = np.flatnonzero(waiting)
            waits = np.delete(waits, np.argmax(waiting[waits]))
            pick = waits[np.argmin(waiting[waits])]
            i = int(np.flatnonzero((of == pick) & ~done)[0])
            done[i] = True
            for j in self.linked(i, np.flatnonzero(of != pick), threshold).tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]


def _linker(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grams, counts = (table.column(c).combine_chunks() for c in ("grams", "counts"))
        grams, counts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (grams, counts))
        first = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        nodes, labels = (table.column(c).to_pylist() for c in ("node", "root"))
        number = {r: i for i, r in enumerate(dict.fromkeys(labels))}
        block = _Block(grams.flatten().to_numpy(), counts.flatten().to_numpy(), first)
        links = block.links(np.array([number[r] for r in labels]), threshold)
        return pa.table({"node": pa.array([nodes[i] for i, _ in links], pa.binary()),
                         "center": pa.array([nodes[j] for _, j in links], pa.binary())})
    return run


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_DOCS else keys


def _links(rows: DataFrame, keys: list[str], grams: DataFrame, threshold: float) -> DataFrame:
    """node, center of links between texts of the same ``keys`` and different ``root``."""
    full = rows.join(grams.drop("size"), "node").select(*keys, "node", "root", "grams", "counts")
    return full.groupBy(*keys).applyInArrow(_linker(threshold), "node binary, center binary")


def _classes(buckets: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """node, root of all classes that the ``buckets`` (key, node) hold."""
    sized = buckets.join(grams.select("node", "size"), "node")
    sizes = sized.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("lead"),
        F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = buckets.join(sizes, "key")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    # First wave: the largest bucket of every text, and in a bucket of several blocks its first text with each.
    home = placed.groupBy("node").agg(F.max(F.struct("n", "key", "blocks", "lead")).alias("h")).select("node", "h.key", "h.blocks", "h.lead")
    at_home = durable(home.withColumn("block", block))
    leads = at_home.where(F.col("blocks") > 1).select(F.col("lead").alias("node"), "key", "block").distinct()
    first = at_home.select("key", "block", "node").unionByName(leads.select("key", "block", "node")).distinct()
    links = durable(_links(first.withColumn("root", F.col("node")), ["key", "block"], grams, threshold))
    roots = components(links)

    # Second wave: buckets with several classes left, all pairs of their blocks.
    rooted = placed.join(roots, "node", "left").select("key", "blocks", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where(F.col("a") != F.col("b")).select("key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    second = rooted.join(open_, "key", "left_semi").withColumn("block", block).withColumn("other", other) \
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root")
    more = durable(_links(second, ["key", "low", "high"], grams, threshold))
    return components(more.unionByName(roots.withColumnRenamed("root", "center")))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (node, center)."""
    edges = durable(links.select(F.greatest("node", "center").alias("u"), F.least("node", "center").alias("v"))
                    .where(F.col("u") != F.col("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where(F.col("u") != F.col("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(small_min, "u")
        edges = durable(kept.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(small_min.select("u", F.col("m").alias("v"))).distinct())
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _node() -> Column:
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size (documents), node (text digest), root (of the class): one row for each row
    of ``docs``.  Classes of the same ``class_id`` (null, or an id with several texts) are told apart by ``root``."""
    rows = docs.select("doc_id", _node().alias("node"), text_or_empty().alias("text"))
    signed = durable(rows.mapInArrow(_sign, _SIGNED))
    texts = signed.where(F.col("n_words") > 0)
    bands = texts.select("node", "bands").distinct().select(F.explode("bands").alias("key"), "node")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    buckets = durable(bands.join(shared, "key").select("key", "node"))

    wanted = buckets.select("node").distinct()
    one = texts.groupBy("node").agg(F.min("doc_id").alias("lead")).join(wanted, "node", "left_semi") \
        .select(F.col("node").alias("_n"), F.col("lead").alias("_d"))
    leads = rows.join(_small(durable(one)), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    grams = durable(leads.select("node", "text").mapInArrow(_shingle_rows, "node binary, size int, grams array<long>, counts array<int>")
                    .dropDuplicates(["node"]))

    roots = _classes(buckets, grams, threshold)
    placed = signed.select("doc_id", "node", "n_words").join(roots, "node", "left").select(
        "doc_id", "node", "n_words", F.coalesce("root", "node").alias("root"))
    word = placed.where(F.col("n_words") > 0)
    classes = word.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return word.join(classes, "root").select("doc_id", "class_id", "class_size", "node", "root").unionByName(
        placed.where(F.col("n_words") == 0).select("doc_id", F.col("doc_id").alias("class_id"),
                                                   F.lit(1).cast("long").alias("class_size"), "node", "root"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of every class, the one with the smallest id."""
    p = clear_prefix(docs, "_tn")
    found = durable(near_duplicates(docs, threshold).where(F.col("class_size") > 1))
    # A class keeps one row: the smallest text of its smallest id.
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("_k"))
    gone = found.join(first, "root").where(~F.col("doc_id").eqNullSafe(F.col("_k.doc_id")) | (F.col("node") != F.col("_k.node")))
    names = [F.col("doc_id").alias(f"{p}_d"), F.col("node").alias(f"{p}_n")]
    gone = durable(gone.select(*names).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}_d")) & (F.col(f"{p}_node") == F.col(f"{p}_n"))
    kept = docs.withColumn(f"{p}_node", _node()).join(_small(gone), same, "left_anti")
    twice = durable(found.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*names))
    if twice.isEmpty():
        return kept.drop(f"{p}_node")
    # Rows repeated with their id and text: one of them.
    once = kept.join(_small(twice), same, "left_semi").dropDuplicates(["doc_id", f"{p}_node"])
    return kept.join(_small(twice), same, "left_anti").unionByName(once).drop(f"{p}_node")
