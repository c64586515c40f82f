"""Line-first cleaning: rules per line, then a verdict on what is left.

Every line with a word is judged by itself (punctuation, shouting,
navigation, boilerplate, repetition of an earlier line).  Lines that fail are
removed; a document that loses too much of its text, or that fails the
document-level base rules, is rejected.  Only built-in column functions run:
one narrow projection over the scan, no shuffle.

Defined results: a null text is an empty text (no words, base rules fail);
rows with a null or repeated ``doc_id`` are judged row by row; extra columns
are ignored by :func:`quality_report` and carried by :func:`clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import SPACE_CLASS, clear_prefix, count_of, let, split_words, text_or_empty

SYMBOLS = r"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A document keeps at least this share (percent) of its word characters.
MIN_KEPT_PERCENT = 50
# One symbol (or doubled ! / ?) for every so many words fails a line.
WORDS_PER_SYMBOL = 4
# Share (percent) of capital letters that makes a line of four words or more shouting.
MAX_CAPITAL_PERCENT = 70
# One separator word for every so many words makes a line navigation.
WORDS_PER_SEPARATOR = 5
SEPARATOR_WORD = "^[|»›•·>/~]+$"
BOILERPLATE_MAX_WORDS = 25
BOILERPLATE = (
    "all rights reserved", "terms of (use|service)", "privacy policy", "cookie policy", "use of cookies",
    "enable javascript", "lorem ipsum", "click here to", "sign in to", "subscribe to our", "skip to (main )?content",
)


def repeated_window_words(words: Column) -> Column:
    """Number of words inside windows of five words found twice or more.

    Windows are compared by a 64-bit hash of their words.  The sort that
    finds the positions runs only for texts that do repeat a window.
    """
    def marked(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, starts), covered)

    def windows(h: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(spots, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(marked(h)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(found)


def line_failure(line: Column) -> Column:
    """The first rule a line fails, null for a good line."""
    def judge(words: Column) -> Column:
        n = F.size(words)
        symbols = count_of(line, SYMBOLS)
        doubled = F.regexp_count(line, F.lit("[!?]{2,}"))
        capitals, letters = count_of(line, r"\p{Lu}"), count_of(line, r"\p{L}")
        separators = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(SEPARATOR_WORD))))
        boiler = F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE)))
        return (F.when((separators >= 2) & (separators * WORDS_PER_SEPARATOR >= n), F.lit("navigation"))
                .when(symbols * WORDS_PER_SYMBOL > n, F.lit("punctuation"))
                .when(doubled * WORDS_PER_SYMBOL > n, F.lit("punctuation"))
                .when((n >= 4) & (capitals * 100 > letters * MAX_CAPITAL_PERCENT), F.lit("shouting"))
                .when((n <= BOILERPLATE_MAX_WORDS) & boiler, F.lit("boilerplate")))
    return let(split_words(line), judge)


def _judged(docs: DataFrame, p: str) -> DataFrame:
    """``docs`` plus a struct column ``p`` of every measure and ``p_good``, the
    lines that stay.  Every step refers to the columns of earlier steps, so
    that each is computed once."""
    text, words, lines, distinct, good = (F.col(f"{p}_{c}") for c in ("text", "words", "lines", "distinct", "good"))
    n, chars, repeat, kept_chars = (F.col(f"{p}_{c}") for c in ("n", "chars", "repeat", "kept_chars"))
    out = docs.withColumn(f"{p}_text", text_or_empty()) \
        .withColumns({f"{p}_words": split_words(text),
                      f"{p}_lines": F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))}) \
        .withColumns({f"{p}_distinct": F.array_distinct(lines), f"{p}_n": F.size(words).cast("long"),
                      f"{p}_chars": F.length(F.array_join(words, "")).cast("long"), f"{p}_repeat": repeated_window_words(words)}) \
        .withColumn(f"{p}_good", F.filter(distinct, lambda x: line_failure(x).isNull())) \
        .withColumn(f"{p}_kept_chars", F.length(F.regexp_replace(F.array_join(good, ""), f"[{SPACE_CLASS}]+", "")).cast("long"))
    failed = (n < MIN_WORDS) | (repeat * 100 > n * MAX_REPEAT_PERCENT)
    return out.withColumn(p, F.struct(
        n.alias("n_words"), chars.alias("word_chars"), count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(distinct)).cast("long").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        (F.size(lines) - F.size(good)).cast("long").alias("n_removed_lines"), kept_chars.alias("kept_chars"),
        failed.alias("base_failed"), (~failed & (kept_chars * 100 >= chars * MIN_KEPT_PERCENT)).alias("kept")))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: base measures, what the line rules removed, the verdict."""
    return _judged(docs.select("doc_id", "text"), "_tq").select("doc_id", "_tq.*")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with failing lines removed.

    A text without failing lines stays as it is; otherwise its good lines are
    joined by newlines.  All columns of ``docs`` are kept; ``n_chars``, where
    present, follows the new text.
    """
    p = clear_prefix(docs, "_tq")
    judged = _judged(docs, p).where(F.col(f"{p}.kept"))
    new = F.col(f"{p}_new")
    out = judged.withColumn(f"{p}_new", F.when(F.col(f"{p}.n_removed_lines") == 0, F.col("text"))
                            .otherwise(F.array_join(F.col(f"{p}_good"), "\n")))
    changed = {"text": new, "n_chars": F.length(new).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
