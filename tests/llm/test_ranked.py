"""Ranked search against a plain ranking of all documents (its SQL twin is in test_oracle_llm)."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tabulon.llm import ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for (d, c), n in zip(counts, sizes):
            score = 0
            for t, reps in collections.Counter(terms(text)).items():
                if c[t]:
                    df = sum(t in x for _, x in counts)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += reps * w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, "The cat sat."), (4, "the CAT, the dog; the cat"), (None, "cat"), (6, "Été à Köln"), (7, "köln 42 ÉTÉ été"),
        (8, "cat"), (9, "cat"), (9, "cat"), (-5, "cat"), (None, "cat"), (10, "x" * 300_000 + " cat"), (11, "cat dog " * 60_000), (12, "!?")]
ITEMS = [(1, "cat"), (2, "The the dog"), (3, None), (4, "été köln"), (5, "nothing here"), (1, "cat"), (1, "dog"), (None, "42"), (6, "cat " * 500)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("item", "item_id", "rank", "score", "part", "what", "value")})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


@pytest.mark.parametrize("k", [1, 3, 10, 100])
def test_all_cases(docs, items, k):
    assert rows_of(ranked.search(docs, items, k)) == plain_ranking(DOCS, ITEMS, k)


def test_blocks_slices_groups_and_whole_numbers_change_nothing(docs, items, monkeypatch):
    expected = plain_ranking(DOCS, ITEMS, 4)
    monkeypatch.setattr(ranked, "BLOCK_CHARS", 5)
    assert rows_of(ranked.search(docs, items, 4)) == expected
    monkeypatch.setattr(ranked, "BLOCK_CHARS", 1 << 20)
    index = ranked.ItemIndex([(i, t or "") for i, t in ITEMS])
    index.weigh(9, 100, {})
    some = [index.counts((t or "").encode()) for _, t in DOCS]
    plain = index.scores(some)
    index.longest = 1 << 40  # as if the sums could leave the exact range of doubles
    assert (index.scores(some) == plain).all()
    monkeypatch.setattr(ranked, "SLICE_BYTES", 7)
    assert [index.counts((t or "").encode()) for _, t in DOCS] == some


def test_empty_tables(docs, items):
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 12"), items)):
        out = ranked.search(d, i)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        ranked.search(docs, items, 0)


def test_text_ids(spark, docs):
    named = spark.createDataFrame([("a", "cat"), ("b", "dog")], "item_id string, text string")
    assert rows_of(ranked.search(docs, named, 2)) == plain_ranking(DOCS, [("a", "cat"), ("b", "dog")], 2)
