"""SentencePiece encoding against the library and against a plain merge loop."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabulon.llm import pieces
from tabulon.llm.queries import QUERIES
from tabulon.sources.testdata import table
from tests.conftest import SF_SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abcdefgehtionsrla   \t\n▁éüß梦中é\x00\U0001F600.,<s></s>0123456789"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


def ids_of(model, texts):
    ids, at = model.encode(model.library.normalize(texts))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def plain_merge(library, text):
    """Merge the best adjacent pair (leftmost of equal ones) of the whole text until none is a piece."""
    symbols = list(library.normalize(text)) if text else []
    while True:
        best = None
        for i in range(len(symbols) - 1):
            piece = library.piece_to_id(symbols[i] + symbols[i + 1])
            if piece != library.unk_id() and not library.is_control(piece) and not library.is_byte(piece):
                if best is None or library.get_score(piece) > best[0]:
                    best = library.get_score(piece), i
        if best is None:
            break
        symbols[best[1]:best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
    out = []
    for s in symbols:
        i = library.piece_to_id(s)
        out += [i] if i != library.unk_id() else [library.piece_to_id(f"<0x{b:02X}>") for b in s.encode()]
    return out


def test_random_texts(model, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert ids_of(model, texts) == library.encode(texts)
    for t in texts[:60]:
        assert plain_merge(library, t) == library.encode(t)


@pytest.mark.parametrize("text", ["", " ", "a" * 50_000, " " * 30_000, "ab" * 20_000, "<unk>", "<0x00>", "▁▁x", "\r\n", "﻿x",
                                  "x" * 64, "x" * 65, "梦" * 70, "\U0001F600" * 70])
def test_odd_texts(model, library, text):
    assert ids_of(model, [text, text]) == [library.encode(text)] * 2


def test_the_heap_and_the_common_rounds_agree(model, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(200)) for _ in range(50)]
    expected = ids_of(model, texts)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    assert ids_of(model, texts) == expected


def test_query_matches_the_library(spark, library):
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, SF_SMALL).collect()}
    rows = table(spark, SF_SMALL, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "")
        g = got[r.doc_id]
        assert g.agrees and g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "agrees", "decoded")})
    out = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    got = sorted((str(r.doc_id), r.ids, r.decoded, r.agrees) for r in out)
    assert got == sorted((str(d), library.encode(t or ""), library.decode(library.encode(t or "")), True) for d, t in rows)
    assert pieces.piece_report(df.limit(0), MODEL).collect() == []
    again = pieces.decode(pieces.encode(df, MODEL).withColumn("decoded", F.lit(1)).withColumn("ids", F.lit(None).cast("array<int>")), MODEL)
    assert {r.decoded for r in again.collect()} == {""}
