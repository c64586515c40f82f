"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabulon.llm import spelling
from tabulon.llm.queries import QUERIES
from tabulon.sources.testdata import table
from tests.conftest import SF_CHECK, SF_SMALL


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_near(words):
    """Words that differ by one letter: equal after one letter is starred, or one letter of the longer is cut."""
    starred, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            starred[w[:i] + "*" + w[i + 1:]].add(w)
            cut = w[:i] + w[i + 1:]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in starred.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_report(rows):
    words = brute_words(rows)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def report(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    expected = brute_report(rows)
    assert report(QUERIES["op11_spelling_variants"](spark, sf)) == expected
    assert any(r[1] for r in expected)


def _words(spark, words):
    return spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_near_words_of_a_dense_vocabulary(spark, monkeypatch, least):
    """Few letters, so many words are near and many grams repeat inside a word; any dictionary gives the same words."""
    monkeypatch.setattr(spelling, "LEAST", least)
    rng = random.Random(least)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.randint(3, 90) for _ in range(700)}
    words |= {"aaaaa": 9, "aaaaaa": 3, "abababab": 4, "bababab": 5, "ÿÿÿÿÿ": 3, "ÿÿÿÿ×": 6}
    got = {(r.word, r.near, r.n, r.near_n) for r in spelling.near_words(_words(spark, words)).collect()}
    assert got == {(a, b, words[a], words[b]) for a, bs in brute_near(words).items() for b in bs}


def test_the_bound_holds_for_every_change(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(300)}
    frequent = {g: 5 for w in words for k in (2, 3, 4) for i in range(len(w) + 3 - k) for g in [f"^{w}$"[i:i + k]] if hash(g) % 2}
    frequent = {g: n for g, n in frequent.items() if all(g[:k] in frequent for k in range(2, len(g)))}
    for w in words:
        grams = spelling.decompose(w, frequent)
        bound = spelling.affected(grams, len(w))
        assert len(grams) == len(w) + 1 > bound
        for i in range(len(w)):
            for other in (w[:i] + "x" + w[i + 1:], w[:i] + w[i + 1:], w[:i] + "x" + w[i:]):
                theirs = spelling.decompose(other, frequent)
                shift = len(other) - len(w)
                kept = sum(1 for p, g in enumerate(grams) if (p < len(theirs) and theirs[p] == g)
                           or (0 <= p + shift < len(theirs) and theirs[p + shift] == g))
                assert kept >= len(grams) - bound


def test_the_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 20)
    monkeypatch.setattr(spelling, "LEAST", 1)
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdefgh") for _ in range(8)): 3 for _ in range(2000)}
    sizes = collections.Counter(len(g) for g in spelling.gram_dictionary(_words(spark, words)))
    assert all(n <= 20 for n in sizes.values())
    got = {(r.word, r.near) for r in spelling.near_words(_words(spark, words)).collect()}
    assert got == {(a, b) for a, bs in brute_near(words).items() for b in bs}


def test_long_chains_of_forms(spark):
    chain = [f"w{i:04d}" for i in range(70)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Hello hello HELLO hellp"), (3, "hello×÷ hello×÷ hello×÷ hellp hellp"), (4, "hellp " * 3),
            (5, "naïve naive Naïve naïve naive naive"), (6, "abcd " * 9), (7, "hellos " * 50_000), (7, "hellos " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "near", "gram")})
    assert report(spelling.spelling_report(df)) == brute_report(rows)
    assert spelling.spelling_report(df.limit(0)).collect() == []
