"""Spelling variants by a variable-length gram index.

Words (of at least five letters, three occurrences) are near when one inserted,
deleted or replaced letter makes one the other.

* Dictionary: letter grams of a word (with a mark before and behind it) that
  occur often over all words.  A gram that starts at a letter is extended
  while it is in this dictionary, up to ``LONGEST`` letters, so common
  beginnings give long grams and rare ones stay short.  The dictionary holds
  at most ``FREQUENT`` grams of each length, whatever the number of words: the
  least frequency grows with them.
* Bound: a gram changes only if the changed letter lies in it.  The most grams
  of a word over one letter are the most that one change can affect; all
  others stay, at their place or one letter on.
* Lists: two near words share all grams but the affected ones, so they share
  one of the first ``affected + 1`` grams of either word in any fixed order;
  the rarest come first.  Only these enter the lists, which hold words by
  gram, place and length, and a word is merged with the lists of its own and
  the next shorter length.  The words that meet are verified by their edit
  distance inside the join: it hands on near words only.

A word's form is its near word of the most occurrences (the smallest in
code-point order of equal ones), if they are twice its own; its root is the
last word that forms lead to, found by doubling.  Forms at least double the
occurrences, so no chain is a ring or long.

Defined results: null and empty texts have no words; a null ``doc_id`` is
written as nothing in the deletion rule; repeated rows count each; long texts
are counted whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import durable, text_or_empty

MIN_LENGTH, MIN_COUNT, DROP_EVERY, DOMINANCE = 5, 3, 97, 2
# Grams have 2 letters at least.  A word of n letters begins n + 1 grams and a change affects ``LONGEST``
# at most, so words of five letters or more always keep one.
SHORTEST, LONGEST = 2, 5
# Grams of one length in the dictionary at most, and the least frequency of one.
FREQUENT, LEAST = 50_000, 32
# Different words a task holds before it hands on what it has counted.
HELD_WORDS = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BEFORE, _BEHIND = "^", "$"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          ["word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            begin = zlib.crc32((f"{doc_id}:" if doc_id.is_valid else ":").encode())
            folded: Counter = Counter()
            for run, n in Counter(m.group() for m in _RUN.finditer(text.as_py())).items():
                folded[run if run.islower() else run.translate(_LOWER)] += n
            for run, n in folded.items():
                h = zlib.crc32(run.encode(), begin)
                if h % DROP_EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= MIN_LENGTH:
                    total[run] += n
            if len(total) > HELD_WORDS:
                yield out(total)
                total = Counter()
    if total:
        yield out(total)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: words of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences in all texts."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Frequent grams and their frequencies over ``words``: at most ``FREQUENT`` of each length."""
    marked = F.concat(F.lit(_BEFORE), F.col("word"), F.lit(_BEHIND))
    starts = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(LEAST, -(-starts // FREQUENT))
    grams = F.flatten(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: F.transform(
        F.sequence(F.lit(1), F.length("m") - k + 1), lambda i: F.substring(F.col("m"), i, k))))
    counts = words.select(marked.alias("m")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") >= least).toLocalIterator()}


def decompose(word: str, frequent: dict[str, int]) -> list[str]:
    """The gram that begins at every letter of the marked word: extended while it is frequent."""
    marked = _BEFORE + word + _BEHIND
    grams = []
    for i in range(len(marked) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and i + size < len(marked) and marked[i:i + size] in frequent:
            size += 1
        grams.append(marked[i:i + size])
    return grams


def affected(grams: list[str], length: int) -> int:
    """The most grams (one begins at each letter) over one letter of a word."""
    cover = [0] * (length + 3)
    for i, g in enumerate(grams):
        cover[i] += 1
        cover[i + len(g)] -= 1
    most = depth = 0
    for i, step in enumerate(cover):
        depth += step
        if 1 <= i <= length:
            most = max(most, depth)
    return most


def list_places(grams: list[str], bound: int, frequent: dict[str, int]) -> list[int]:
    """Places of the first ``bound + 1`` grams, rarest first, with all places of the same grams."""
    order = sorted(range(len(grams)), key=lambda i: (frequent.get(grams[i], 0), grams[i]))
    chosen = {grams[i] for i in order[:bound + 1]}
    return [i for i, g in enumerate(grams) if g in chosen]


def _lists(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shipped.value
        for batch in batches:
            columns: tuple = tuple([] for _ in range(4))
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                grams = decompose(word, frequent)
                for i in list_places(grams, affected(grams, len(word)), frequent):
                    for c, v in zip(columns, (grams[i], i, word, n)):
                        c.append(v)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["gram", "place", "word", "n"])
    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of near words of ``words`` (word, n), both ways round."""
    shipped = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))
    lists = words.mapInArrow(_lists(shipped), "gram string, place int, word string, n long")

    # A list's words, and the lists a word looks into: its own, and those of the words one letter shorter,
    # where a gram stands at the same place or one before.  A hash names the list; what it mixes up fails the checks.
    def name(length: Column, place: Column) -> Column:
        return F.xxhash64("gram", length, place)

    size, place = F.length("word"), F.col("place")
    held = lists.select(name(size, place).alias("list"), F.col("word").alias("word_"), F.col("n").alias("n_"))
    looks = lists.select(F.explode(F.array(name(size, place), name(size - 1, place), name(size - 1, place - 1))).alias("list"), "word", "n")
    ahead = (F.length("word") > F.length("word_")) | (F.col("word") < F.col("word_"))
    met = looks.join(held, "list").where(ahead & (F.levenshtein("word", "word_", 1) == 1))
    pairs = met.groupBy("word", "word_").agg(F.first("n").alias("n"), F.first("n_").alias("n_"))
    both = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("n"), F.col(c).alias("near"), F.col(d).alias("near_n"))
                               for a, b, c, d in (("word", "n", "word_", "n_"), ("word_", "n_", "word", "n"))]))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row of ``forms`` (word, form): the word that following forms ends at."""
    state = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state_next = durable(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                     F.col("next").isNotNull().alias("moved")))
        state = state_next.select("word", "root")
        if state_next.where("moved").isEmpty():
            return state


def spelling_report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word."""
    words = durable(word_counts(docs))
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("n"), F.max("near_n").alias("form_n"),
        F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    follows = F.col("form_n") >= DOMINANCE * F.col("n")
    near = durable(near.select("word", "n_near", F.when(follows, F.col("best.near")).alias("form"),
                               F.when(follows, F.col("form_n")).alias("form_n")))
    last = roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    return words.join(near, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
