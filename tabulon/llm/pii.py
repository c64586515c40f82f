"""Personal data: exact kinds, and bootstrapped contextual extraction.

Four kinds are found by their formats in every whole text.  Those finds are
the seeds of a pattern-instance graph: an occurrence of an identifier (a
seed, or any other word with digits) is tied to the lexical patterns it
stands in (words around it, its shape).  Spark scores the graph in rounds: a
pattern that mostly holds known identifiers of one kind is trusted, and
unknown identifiers that trusted patterns point at become known, until a
round adds none.

The scan is one pass of linear-time matching; only occurrences leave it.  The
graph is joined and aggregated on pattern and instance, each edge once, and
the table of occurrences is checkpointed between rounds.

Defined results: a null text is an empty text; rows are told apart by
(doc_id, text), so equal rows get equal results and null ids are allowed; an
empty table gives no rows; extra columns are ignored by :func:`pii_report`
and carried by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import clear_prefix, durable, text_or_empty

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|=`“”«»"

# An unknown identifier: a word with this many characters and digits at least.
MIN_CHARS, MIN_DIGITS = 5, 3
# Longer words, shapes and identifiers are named by their beginning and a digest of the whole.
MAX_WORD, MAX_SHAPE, MAX_INSTANCE = 32, 64, 128
# A pattern is trusted with so many distinct known identifiers of one kind, in this share of all it holds.
MIN_SUPPORT, MIN_PRECISION = 3, 0.8
# Trusted patterns point at an identifier with this joint confidence.
MIN_CONFIDENCE = 0.75


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            floor = m.end()
    return out


def find_base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds, by kind, then start."""
    out = [("email", a, b) for a, b in find_emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _named(value: str, chars: int) -> str:
    return value if len(value) <= chars else f"{value[:chars]}#{hashlib.md5(value.encode('utf-8', 'surrogatepass')).hexdigest()}"


def shape(word: str) -> str:
    """Letters as a, digits as 9, runs kept up to their length class (1, 2-4, 5 and more)."""
    out, last, run = [], "", 0
    for c in word + "\0":
        s = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if s != last:
            if last:
                out.append(last if last not in "9a" else last * (1 if run == 1 else 2 if run <= 4 else 3))
            last, run = s, 0
        run += 1
    return _named("".join(out), MAX_SHAPE)


def _plain(word: str) -> str:
    return _named(re.sub("[0-9]+", "0", word.strip(_EDGE).lower()), MAX_WORD) or "_"


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Every seed and every other identifier with the patterns it stands in."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    found = [(a, b, kind) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    lows, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else b))
    for a, b in words:
        word = text[a:b]
        left, right = len(word) - len(word.lstrip(_EDGE)), len(word.rstrip(_EDGE))
        core = word[left:right]
        if len(core) >= MIN_CHARS and sum("0" <= c <= "9" for c in core) >= MIN_DIGITS:
            k = bisect_right(lows, a + right - 1)
            if not k or reach[k - 1] <= a + left:
                found.append((a + left, a + right, None))
    out = []
    for a, b, kind in found:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        near = [_plain(text[slice(*words[i])]) if 0 <= i < len(words) else "^" for i in (first - 2, first - 1, last + 1)]
        form = shape(text[a:b])
        out.append({"start": a, "end": b, "kind": kind, "instance": _named(text[a:b].lower(), MAX_INSTANCE), "patterns": [
            f"{near[0]} {near[1]} _ : {form}", f"{near[1]} _ {near[2]} : {form}", f"{near[0]} {near[1]} _ {near[2]}"]})
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()),
                   ("patterns", pa.list_(pa.string()))])
_SCHEMA = ("doc_id long, hash long, base array<struct<kind:string,start:long,end:long>>, "
           "seen array<struct<start:long,end:long,kind:string,instance:string,patterns:array<string>>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, seen = [], []
        for text in batch.column("text"):
            text = text.as_py()
            spans = find_base(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            seen.append(occurrences(text, spans) if spans or any(d in text for d in "0123456789") else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("hash"), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))],
            ["doc_id", "hash", "base", "seen"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, base spans and occurrences of every row; small, kept in the shared folder."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    return durable(rows.mapInArrow(_scan, _SCHEMA))


def bootstrap(scanned: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores the pattern-instance graph until a round adds no instance (or for
    so many ``rounds``); returns (instances, patterns): what
    is known by kind with its confidence, and the trusted patterns."""
    seen = scanned.select(F.explode("seen").alias("s")).select("s.*")
    edges = durable(seen.select("instance", F.explode("patterns").alias("pattern")).distinct())
    known = durable(seen.where(F.col("kind").isNotNull()).groupBy("instance").agg(
        F.min("kind").alias("kind"), F.lit(1.0).alias("confidence")))
    trusted = None
    for _ in count() if rounds is None else range(rounds):
        held = edges.join(known, "instance", "left")
        tally = held.groupBy("pattern").agg(F.count("*").alias("total"), *[
            F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
        best = F.greatest(*KINDS)
        trusted = tally.where((best >= MIN_SUPPORT) & (best >= MIN_PRECISION * F.col("total"))).select(
            "pattern", reduce(lambda c, k: c.when(F.col(k) == best, k), KINDS[1:], F.when(F.col(KINDS[0]) == best, KINDS[0]))
            .alias("says"), (best / F.col("total") * (1 - F.pow(F.lit(0.5), best))).alias("trust"))
        votes = held.where(F.col("kind").isNull()).join(trusted, "pattern")
        by_kind = votes.groupBy("instance", F.col("says").alias("kind")).agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("confidence"))
        fresh = durable(by_kind.where(F.col("confidence") >= MIN_CONFIDENCE).groupBy("instance").agg(
            F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence")))
        if fresh.isEmpty():
            break
        known = durable(known.unionByName(fresh))
    return known, trusted


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start, then end."""
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    keyed = F.transform(spans, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"], s["end"]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def document_spans(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, hash, base spans and all spans (base and discovered), a row for each row of ``docs``."""
    scanned = scan(docs)
    known, _ = bootstrap(scanned, rounds)
    unknown = scanned.select("doc_id", "hash", F.explode("seen").alias("s")).where(F.col("s.kind").isNull()) \
        .select("doc_id", "hash", "s.start", "s.end", "s.instance")
    more = unknown.join(known, "instance").groupBy("doc_id", "hash").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    s, m = scanned.alias("s"), more.alias("m")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return s.join(m, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.hash") == F.col("m.hash")), "left").select(
        "s.doc_id", "s.hash", _ordered(F.col("s.base")).alias("base"),
        _ordered(F.concat("s.base", F.coalesce("m.more", none))).alias("spans"))


def pii_report(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Counts of the base kinds, their digest and the list of all spans."""
    found = document_spans(docs, rounds)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def mask(text: str, spans: list[dict]) -> str:
    """Every stretch covered by spans becomes the tag of the span that begins it."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _mask_batches(batches: Iterator[pa.RecordBatch], spans: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t is None or not s else mask(t, s) for t, s in zip(
            batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n != spans]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, batch.schema.field(n).type) if n == "text" else batch.column(n) for n in names], names)


def redact(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind; ``n_chars``, where present, follows."""
    p = clear_prefix(docs, "_tp")
    found = document_spans(docs, rounds).where(F.size("spans") > 0).dropDuplicates(["doc_id", "hash"]).select(
        F.col("doc_id").alias(f"{p}_id"), F.col("hash").alias(f"{p}_hash"), F.col("spans").alias(f"{p}_spans"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}_id")) & (F.xxhash64(text_or_empty()) == F.col(f"{p}_hash"))
    joined = docs.join(found, same, "left").drop(f"{p}_id", f"{p}_hash")
    out = joined.mapInArrow(lambda it: _mask_batches(it, f"{p}_spans"), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
