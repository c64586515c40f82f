"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its character n-grams (hashed into buckets); the mean of
their embeddings goes through a linear softmax; embeddings and softmax are
trained jointly, in numpy, by gradient descent.  Misspelt words share most
n-grams with the words they distort, so they land near them.

The softmax of a mean is linear in the bag, so for scoring the model is one
weight for each bucket (its embedding times the difference of the two output
rows): scoring is a lookup and a mean, in one pass over the texts.

Fitting uses a bounded sample of labelled rows (``max_rows`` for each label,
those with the smallest id hashes); scoring covers every whole text.

Defined results: a null or empty text scores the bias alone; labels of a
repeated ``doc_id`` count as toxic if one of them is; null labels and ids are
not learned from; rows with a null id are scored and are not held out;
without labels of both kinds every score is the share of toxic labels (0.5
without labels); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.buffers import chunks, mix, text_buffer

BUCKETS = 1 << 19
GRAMS = (3, 4, 5, 6)
DIM = 4
MAX_ROWS = 1500
# Training ends at this loss, or after so many rounds over the sample.
STOP_LOSS = 0.03
EPOCHS = 240
SEED = 7
MOMENTUM = 0.9
# Learning rates of the embeddings, the output rows and the biases; weight decay.
RATES = (1.0, 0.05, 0.5)
DECAY = 3e-4
# The mean of many small vectors is small; a fixed factor keeps gradients in range.
SCALE = 100.0
# An n-gram of fewer training texts than this keeps the weight 0.
MIN_DOCS = 3
FOLDS = 5

# Bytes that separate words; capitals are folded.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in b"\x00\t\n\x0b\x0c\r .,;:\"'()[]{}<>/\\?!|&#%-_=+~":
    _FOLD[_c] = 32


def gram_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram inside a word (its borders included), and the document it is in.

    Every document is put between separators, so no n-gram spans two documents.
    """
    sizes = np.diff(offsets)
    n = len(sizes)
    text = np.full(len(raw) + n + 1, 32, dtype=np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    text[np.arange(len(raw)) + doc + 1] = _FOLD[raw]
    starts = offsets[:-1] + np.arange(n)  # of each document's leading separator
    wide, gap = text.astype(np.uint64) + np.uint64(1), text == 32
    h = wide.copy()
    inside = np.ones(len(text), dtype=bool)  # no separator strictly inside so far
    out_b, out_d = [], []
    for size in range(2, max(GRAMS) + 1):
        m = len(text) - size + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + wide[size - 1:]
        if size > 2:
            inside = inside[:m] & ~gap[size - 2:size - 2 + m]
        else:
            inside = inside[:m]
        if size in GRAMS:
            at = np.flatnonzero(inside)
            out_b.append((mix(h[at] + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int32))
            out_d.append((np.searchsorted(starts, at, side="right") - 1).astype(np.int32))
    if not out_b:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(out_b), np.concatenate(out_d)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, class_rows: tuple[int, int] | None = None
        ) -> tuple[np.ndarray, float]:
    """Joint training over the (buckets, shares) of each text: one weight per bucket, and the bias.

    ``class_rows``: labelled rows of either kind that the sample stands for.
    """
    seen = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=float)
    stands = np.array(class_rows if class_rows is not None else seen, dtype=float)
    share = stands[1] / stands.sum() if stands.sum() else 0.5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not seen.all():
        return np.zeros(BUCKETS, np.float32), prior
    known = np.bincount(np.concatenate([b for b, _ in docs]), minlength=BUCKETS) >= MIN_DOCS
    n = len(docs)
    doc = np.repeat(np.arange(n), [int(known[b].sum()) for b, _ in docs])
    used, flat = np.unique(np.concatenate([b[known[b]] for b, _ in docs]), return_inverse=True)
    x = np.concatenate([v[known[b]] for b, v in docs]).astype(np.float32)
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-0.01, 0.01, (len(used), DIM))
    out = rng.uniform(-1, 1, (DIM, 2))
    bias = np.array([0.0, prior])
    target = np.stack([1 - labels, labels], axis=1)
    weight = (stands / stands.sum() / seen)[labels.astype(int)]
    speed = [np.zeros_like(p) for p in (emb, out, bias)]
    best, pace, kept = np.inf, 1.0, [param.copy() for param in (emb, out, bias)]
    for _ in range(EPOCHS):
        mean = SCALE * np.stack([np.bincount(doc, weights=x * emb[flat, k], minlength=n) for k in range(DIM)], 1)
        z = mean @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(weight * np.log(np.maximum((p * target).sum(1), 1e-12))).sum())
        if not loss <= 1.5 * best:  # overshot: back to the best point, go on slower
            for param, good, v in zip((emb, out, bias), kept, speed, strict=True):
                param[...] = good
                v[...] = 0
            pace /= 2
            continue
        if loss < best:
            best, kept = loss, [param.copy() for param in (emb, out, bias)]
        if loss <= STOP_LOSS:
            break
        g = (p - target) * weight[:, None]
        back = SCALE * (g @ out.T)
        grads = (np.stack([np.bincount(flat, weights=x * back[doc, k], minlength=len(used)) for k in range(DIM)], 1),
                 mean.T @ g, g.sum(0))
        for param, grad, v, rate in zip((emb, out, bias), grads, speed, RATES, strict=True):
            v *= MOMENTUM
            v -= pace * rate * (grad + DECAY * param)
            param += v
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = SCALE * (emb @ (out[:, 1] - out[:, 0]))
    return weights, float(bias[1] - bias[0])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in chunks(offsets):
            grams, doc = gram_buckets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            rows = []
            for d in range(b - a):
                ids, counts = np.unique(grams[doc == d], return_counts=True)
                rows.append((ids, counts / max(1, counts.sum())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(a, b - a), batch.column("toxic").slice(a, b - a),
                 pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                ["key", "toxic", "ids", "shares"])


def _train(batches: Iterator[pa.RecordBatch], class_rows: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for key, toxic, ids, shares in zip(*(batch.column(c) for c in ("key", "toxic", "ids", "shares")), strict=True):
            rows.append((key.as_py(), toxic.as_py(), ids.values.to_numpy(), shares.values.to_numpy()))
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1], len(r[2]), float(r[3].sum()), r[2].tobytes()))
    weights, bias = fit([(r[2], r[3]) for r in rows], np.array([r[1] for r in rows], dtype=float), class_rows)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Fits the model in one task over a bounded sample of the labelled rows
    outside the held-out fold; the model (one weight per bucket) comes back."""
    known = labels.where((F.col("doc_id").isNotNull()) & F.col("toxic").isNotNull()) \
        .where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0) \
        .groupBy(F.col("doc_id").alias("key")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    class_rows = (counts.get(0, 0), counts.get(1, 0))
    order = F.xxhash64("key")
    parts = [known.where(F.col("toxic") == v).orderBy(order, "key").limit(max_rows) for v in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * max_rows rows of 12 bytes
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text")).join(sample, "key")
    bags = rows.select("key", "toxic", "text").mapInArrow(
        _bags, "key long, toxic int, ids array<int>, shares array<float>")
    model = bags.repartition(1).mapInArrow(lambda it: _train(it, class_rows), "weights binary, bias double").collect()
    if not model:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model[0]["weights"], dtype=np.float32), float(model[0]["bias"])


def score_batch(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for a, b in chunks(offsets, 1 << 20):
        grams, doc = gram_buckets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        total = np.bincount(doc, weights=weights[grams], minlength=b - a)
        out[a:b] = total / np.maximum(np.bincount(doc, minlength=b - a), 1)
    return 1 / (1 + np.exp(-np.clip(out + bias, -500, 500)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights, bias = learn(docs, labels, max_rows)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = model.value
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_batch(raw, offsets, w, c))],
                                             ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
