"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names: every operator and every stage gives its defined result."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import chat, licenses, mixing, neardup, packing, pii, quality, substrings, toxicity, vectors

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
CLASHES = ["size", "hash", "node", "kept", "score", "base", "spans", "copies", "n_words", "key", "center", "at", "n",
           "rate", "words", "taken", "owner", "_tm_times", "salt", "start"]

LONG = " ".join(f"word{i % 977} text{i % 53}," for i in range(30_000))
GOOD = "This plain sentence has enough different words to be kept by all rules, mail bob@example.com today.\nIt ends here."
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, LONG, "en", "b"), (5, GOOD, "en", None),
    (5, GOOD, "en", None), (6, GOOD, None, "b"), (None, GOOD + " More words follow in this one.", "de", "c"), (None, None, None, None),
    (7, "one two", "en", "a"), (8, "dup line here\n" * 40, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def messy(plain):
    return plain.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 0), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


REPORTS = {
    "neardup": lambda d, lab: neardup.near_duplicates(d),
    "licenses": lambda d, lab: licenses.license_report(d),
    "pii": lambda d, lab: pii.pii_report(d),
    "mixing": lambda d, lab: mixing.mix_report(d),
    "substrings": lambda d, lab: substrings.dedup_substrings(d),
    "toxicity": lambda d, lab: toxicity.toxicity_scores(d, lab),
    "quality": lambda d, lab: quality.quality_report(d),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_a_row_for_every_row(messy, labels, name):
    out = REPORTS[name](messy, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_empty_table(messy, labels, name):
    assert REPORTS[name](messy.limit(0), labels.limit(0)).collect() == []


def test_clashing_columns_change_nothing(plain, messy, labels):
    for name in ("licenses", "quality", "mixing", "pii"):
        a, b = (sorted(map(str, REPORTS[name](d, labels).collect())) for d in (plain, messy))
        assert a == b, name


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, messy, name, stage):
    out = stage(spark, messy, "")
    if name != "packing":
        assert out.columns == messy.columns
    assert out.count() > 0
    assert stage(spark, messy.limit(0), "").count() == 0


def test_quality_of_edges(plain):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_report(plain).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept and got[3, 0].word_chars == 0
    assert got[5, 19].kept and got[8, 120].n_dup_lines == 39 and got[8, 120].base_failed


def test_stage_drops_rejected_and_keeps_good(spark, plain):
    ids = [r.doc_id for r in corpus_pipeline.quality_stage(spark, plain, "").collect()]
    assert ids.count(5) == 2 and 6 in ids and 1 not in ids and 8 not in ids


def test_cleaning_removes_failing_lines(spark):
    text = "A first good sentence with several ordinary words in it.\nHome | News | About | Contact | Help\nA last good sentence that closes the text."
    row = quality.clean_documents(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")).first()
    assert "|" not in row.text and row.text.count("\n") == 1 and row.n_chars == len(row.text)


def test_neardup_classes_of_edges(plain):
    got = neardup.near_duplicates(plain).collect()
    assert {(r.class_id, r.class_size) for r in got if r.doc_id in (5, 6)} == {(5, 3)} or \
        {(r.class_id, r.class_size) for r in got if r.doc_id in (5, 6)} == {(5, 4)}
    assert all(r.class_id == r.doc_id and r.class_size == 1 for r in got if r.doc_id in (1, 2, 3, 4, 7))


def test_neardup_keeps_one_row_of_repeated_rows(plain):
    ids = [r.doc_id for r in neardup.keep_one(plain).collect()]
    assert ids.count(5) == 1 and 6 not in ids and {1, 2, 3, 4, 7, 8} <= set(ids)


def test_neardup_keeps_one_row_of_every_class(spark):
    """Classes without ids, and classes that share their smallest id."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    kept = lambda rows: sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(None, a), (None, a), (None, b), (None, b)]) == [(0, a), (0, b)]
    assert kept([(5, a), (7, a), (5, b), (8, b)]) == [(5, a), (5, b)]
    assert kept([(None, a), (3, a), (None, b), (None, b)]) == [(0, b), (3, a)]


def test_substrings_of_edges(spark, plain):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"x {passage} y z"), (2, f"x {passage} y z"), (None, passage),
                                  (3, " ".join(f"p{i}" for i in range(49)))], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in substrings.dedup_substrings(rows).collect())
    assert got == [(0, 60, 0), (1, 63, 0), (2, 63, 60), (2, 63, 60), (3, 49, 0)]
    empty = [r for r in substrings.dedup_substrings(plain).collect() if r.doc_id in (1, 2, 3)]
    assert all(r.n_words == 0 and r.kept_sha256 == EMPTY_SHA for r in empty)


def test_mixing_of_edges(plain):
    got = mixing.mix_report(plain).collect()
    total = sum(r.size for r in got)
    by_source = {}
    for r, row in zip(got, got):
        by_source[r.source_size] = r.target
    assert sum(r.size for r in got) == total and all(0 <= r.taken <= 3 * r.size for r in got)


def test_packing_keeps_every_token_of_edges(plain):
    out = packing.pack_documents(plain).collect()
    assert {r.doc_tokens for r in out if r.doc_id in (1, 2)} == {1}
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert all(v == 1024 or v & (v - 1) == 0 for v in ends.values())


def test_toxicity_without_labels_and_with_one_kind(plain, labels):
    none = toxicity.toxicity_scores(plain, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    one = toxicity.toxicity_scores(plain, labels.where("toxic = 0")).collect()
    assert all(r.score < 0.01 and r.predicted == 0 for r in one)
    assert all(not r.held_out for r in none if r.doc_id is None)


def test_vectors_of_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, None), (7, []), (8, [1.0]), (None, [1.0, 2.0]), (100, [-1.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    out = vectors.exact_topk(vectors.integer_vectors(frame), F.col("id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [
        (0, 1, 1), (0, 2, 2), (0, 3, None), (0, 4, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, None)]
    assert out[0].score == 1024 * 1024 * 5
    assert vectors.exact_topk(vectors.integer_vectors(frame.limit(0)), F.col("id") % 100 == 0, 10).collect() == []


def test_large_vectors_take_part(spark):
    rows = [(0, [20000.0, 1.0]), (1, [3.0, 2.0]), (2, [1e6, -2.5]), (100, [-16385.0, 7.0]), (3, [1e8, 0.0]), (4, [-1e15, -1e15])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = {i: [int(x * 1024 // 1) for x in v] for i, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(cells[a], cells[b]))
    want = [(q, n + 1, i, dot(q, i)) for q in (0, 100) for n, i in enumerate(
        sorted((i for i in cells if i != q and dot(q, i) < 2**63), key=lambda i: -dot(q, i))[:3])]
    beyond = [(q, i) for q in (0, 100) for i in cells if i != q and dot(q, i) >= 2**63]
    assert beyond == [(100, 4)]
    only = [r for r in frame.collect() if r.vec_id != 4]
    fits = spark.createDataFrame(only, frame.schema)
    assert [tuple(r) for r in vectors.exact_topk(vectors.integer_vectors(fits), F.col("id") % 100 == 0, 3).orderBy("query_id", "rank").collect()] == want
    # A result beyond a BIGINT is refused, one that is beyond it but not among the best is not needed.
    with pytest.raises(Exception, match="BIGINT"):
        vectors.exact_topk(vectors.integer_vectors(frame), F.col("id") % 100 == 0, 3).collect()
    zero = vectors.exact_topk(vectors.integer_vectors(frame), F.col("id") == 0, 3).orderBy("rank").collect()
    assert [tuple(r) for r in zero] == want[:3]


PART = "array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"


def test_chat_parts_and_edges(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [
        (1, 0, "user", [text("see <|turn|>"), ("image", None, "a.png", 1024, 600, None, None), text("and </s>")]),
        (1, 1, "assistant", [text("[INST] \\<|end|> <\\|x"), ("audio", None, "b.wav", None, None, 2.5, None),
                             ("document", None, "c.pdf", None, None, None, 3)]),
        (2, None, None, None), (2, 5, "as\nsis\\ntant", [text(None)]), (None, 0, "user", [text("hi")]), (None, 0, "user", [text("hi")]),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}").withColumn("n_turns", F.lit("x"))
    out = {r.conv_id: r for r in chat.format_conversations(frame)
           .withColumn("back", chat.read_turns(F.col("formatted")))
           .withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = out[1]
    assert [list(t.parts) for t in one.back] == [["see <|turn|>", "<|image:0.1|>", "and </s>"],
                                                 ["[INST] \\<|end|> <\\|x", "<|audio:1.1|>", "<|document:1.2|>"]]
    assert one.loss == ["[INST] \\<|end|> <\\|x"]
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in one.attachments] == [
        (0, 1, "image", "a.png", 85 + 170 * 4), (1, 1, "audio", "b.wav", 63), (1, 2, "document", "c.pdf", 2400)]
    assert one.attachment_tokens == 765 + 63 + 2400
    assert [t.role for t in out[2].back] == ["", "as\nsis\\ntant"] and out[None].n_turns == 2
    assert chat.format_conversations(frame.limit(0)).collect() == []


def test_chat_escape_round_trip(spark):
    import random
    rng = random.Random(3)
    bits = ["<", "[", "\\", "|", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "x", "<|end|>\n", "<|turn|>", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")) \
        .withColumn("b", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.b for r in out)
    assert not [r for r in out for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>") if c in r.e]


def test_license_notices_and_edges(spark):
    notice = licenses.TEMPLATES[9][1]
    rows = [(1, "intro\n" + notice.upper()), (2, " ".join(notice.split()[:12])), (3, "MIT License mit license, and CC-BY x"),
            (4, None), (4, "ÉMIT license"), (5, "cc by cc by")]
    got = {(r.doc_id, r.n_words): r for r in licenses.license_report(
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    by = {k[0]: v for k, v in got.items() if k[1]}
    assert by[1].labels == "mit" and by[1].base_labels == "" and by[1].score == 1.0 and by[1].first_word is None
    assert by[2].labels == ""
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].labels) == (3, 0, 5, "cc-by,mit")
    assert got[4, 0].score == 0.0 and got[4, 2].n_base == 0 and (by[5].n_base, by[5].last_word) == (2, 2)


APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
BSD_HEADER = """ * Redistribution and use in source and binary
 * forms, with or without modification, are
 *
 * permitted provided that the following conditions
 * are met:
"""


def test_license_notices_over_several_lines(spark):
    import textwrap
    filler = "\n".join(f"plain words of line {i} that say nothing" for i in range(200))
    scattered = "\n".join(w + " " + " ".join(f"x{i}-{k}" for k in range(60)) for i, w in enumerate(licenses.TEMPLATES[2][1].split()))
    rows = [(1, f"{filler}\n{APACHE_HEADER}{filler}"), (2, f"int x;\n/*\n{BSD_HEADER} */\n{filler}"), (3, scattered),
            (4, "\n\n \n" + "\n" * 50), (None, BSD_HEADER)]
    rows += [(10 + i, f"{filler}\nsome words\n" + "\n".join("// " + x for x in textwrap.wrap(text, 40)) + "\nmore words")
             for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The long template is held whole; its short form is within it.
    assert got[1].labels == "apache" and got[1].score == 1.0
    assert got[2].labels == "bsd" and got[2].base_labels == "" and got[2].score == 1.0 and got[None].labels == "bsd"
    assert got[3].labels == "" and got[3].score == 0.0 and got[4].labels == ""
    assert all(label in got[10 + i].labels.split(",") and got[10 + i].score == 1.0 for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_words_of_a_notice_spread_over_a_long_line_are_no_notice(spark):
    """Lines that hold a template's words anywhere, in a paragraph and far from each other, and runs that hold them together."""
    rng = __import__("random").Random(3)
    paragraph = ("This report is about the release of new data. It was put into public hands by the council, and it is free to read. "
                 "Some of the domain names were unencumbered, others not; the software that was used has been described before.")
    spread = " ".join(x for w in "licensed under cc by nc 4 0".split() for x in [w] + [f"f{rng.randrange(99)}" for _ in range(6)])
    held = "words " * 500 + "this software is Licensed, under CC BY-NC 4.0 as said " + "words " * 500
    inserted = "some text This is now free and fully unencumbered software released into the public domain by us " + "more text " * 300
    rows = [(1, paragraph), (2, spread), (3, held), (4, inserted), (5, "This program is free"), (6, held.replace(" ", "\n"))]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("", 0.0) and got[2] == ("", 0.0) and got[5] == ("", 0.0)
    assert got[3][0] == got[6][0] == "cc-by,cc-by-nc" and got[4] == ("unlicense", 1.0)


def test_runs_on_either_side_of_every_block_border(spark):
    step = max(licenses.run_words(t, licenses.CONTAINMENT) for _, t in licenses.TEMPLATES)
    long = licenses.TEMPLATES[6][1]
    rows = [(n, "x " * n + long + " y" * 50) for n in range(0, 2 * step + 2, 3)]
    got = licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all("gpl" in r.labels.split(",") and r.score == 1.0 for r in got)
