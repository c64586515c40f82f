"""Catalog ingestion and maintenance.

The import takes raw CSV-shaped rows (all strings, reference column names)
with a file-order column ``_seq`` and yields the merged song table plus the
three reports (skipped rows, bad numbers, merged names) and a summary row.

Every merge is a keyed aggregation, never a per-id collected list: the
ordered case-insensitive list union explodes items, reduces per
(id, lower(item)) with partial aggregation, and only the *distinct* items of
an id are gathered, so a hot id holding a third of all rows costs no more
than its distinct genres.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import lenient_double
from tabulon.functions.text import blank_to_empty, py_strip, slug

# Raw column names of the song export and the feature keys.
COL_URI = "Track URI"
COL_TITLE = "Track Name"
COL_ARTIST = "Artist Name(s)"
COL_VIBE = "Vibe Description"
COL_GENRES = "Genres"
COL_TAGS = "Vibe Tags"
FLOAT_FIELDS = [
    ("Danceability", "danceability"),
    ("Energy", "energy"),
    ("Valence", "valence"),
    ("Tempo", "tempo"),
    ("Acousticness", "acousticness"),
    ("Speechiness", "speechiness"),
    ("Instrumentalness", "instrumentalness"),
    ("Loudness", "loudness"),
]
FEATURE_KEYS = [k for _, k in FLOAT_FIELDS]


def _raw(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def clean_rows(raw: DataFrame, seq: str = "_seq") -> DataFrame:
    """N11 + N13: trimmed text fields ('' for missing), display name,
    missing-field list, derived id, raw and parsed features.  Rows of several
    files carry ``_record``, their position in their file, for the reports."""
    title, artist, vibe = (blank_to_empty(_raw(raw, c)) for c in (COL_TITLE, COL_ARTIST, COL_VIBE))
    uri = blank_to_empty(_raw(raw, COL_URI))
    cols = [
        F.col(seq).cast("bigint").alias("seq"),
        F.col("_record" if "_record" in raw.columns else seq).cast("bigint").alias("record"),
        title.alias("title"), artist.alias("artist"), vibe.alias("vibe"), uri.alias("uri"),
        blank_to_empty(_raw(raw, COL_GENRES)).alias("genres"),
        blank_to_empty(_raw(raw, COL_TAGS)).alias("tags"),
    ]
    cols += [F.coalesce(_raw(raw, c), F.lit("")).alias(f"raw_{k}") for c, k in FLOAT_FIELDS]
    df = raw.select(*cols)
    t, a, v, u = F.col("title"), F.col("artist"), F.col("vibe"), F.col("uri")
    name = F.concat(F.when(t != "", t).otherwise(F.lit("(no title)")), F.lit(" - "),
                    F.when(a != "", a).otherwise(F.lit("(no artist)")))
    missing = F.concat_ws(", ", F.when(t == "", F.lit("title")), F.when(a == "", F.lit("artist")),
                          F.when(v == "", F.lit("vibe description")))
    song_id = F.when(u != "", F.element_at(F.split(u, ":"), -1)).otherwise(
        F.concat(F.lit("manual:"), slug(F.concat(a, F.lit("-"), t))))
    df = df.select("*", name.alias("name"), missing.alias("missing"), song_id.alias("id"))
    for k in FEATURE_KEYS:
        df = df.withColumn(k, lenient_double(F.col(f"raw_{k}")))
    return df


def skipped_rows(clean: DataFrame) -> DataFrame:
    """N12 report: ``line N: <name>`` (line 1 is the header) and the reason."""
    return (clean.where(F.col("missing") != "")
                 .select("seq",
                         F.concat(F.lit("line "), (F.col("record") + 2).cast("string"), F.lit(": "),
                                  F.col("name")).alias("label"),
                         F.concat(F.lit("missing "), F.col("missing")).alias("reason")))


def kept_rows(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("missing") == "")


def bad_numbers(kept: DataFrame) -> DataFrame:
    """(name, column) for every non-blank feature that is not a number,
    on every kept row (duplicates included)."""
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"raw_{k}").alias("raw"), F.col(k).alias("parsed"))
        for c, k in FLOAT_FIELDS
    ])).alias("f")
    return (kept.select("seq", "name", stack)
                .where((py_strip(F.col("f.raw")) != "") & F.col("f.parsed").isNull())
                .select("seq", "name", F.col("f.column").alias("column")))


def ordered_union_by_key(rows: DataFrame, key: str, col: str, sep: str, seq: str = "seq") -> DataFrame:
    """N16 over all rows of each key: split on ``sep``, strip, drop blanks,
    case-insensitive distinct, first spelling and first position win; joined
    back with the bare separator.  Returns (key, <col>_merged)."""
    items = (rows.select(key, seq, F.posexplode(F.split(F.col(col), _regex_escape(sep))).alias("pos", "item"))
                 .select(key, seq, "pos", py_strip(F.col("item")).alias("item"))
                 .where(F.col("item") != ""))
    first = (items.groupBy(key, F.lower("item").alias("_k"))
                  .agg(F.min(F.struct(seq, "pos")).alias("_first"),
                       F.min_by("item", F.struct(seq, "pos")).alias("item")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_first", "item"))), lambda x: x["item"])
    return first.groupBy(key).agg(F.array_join(ordered, sep).alias(f"{col}_merged"))


def _regex_escape(sep: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in sep)


def merge_duplicates(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per id.  First title/artist/vibe win; genres (',') and
    tags (';') become ordered unions when the id occurs more than once
    (single rows keep their raw text); each feature is its first non-null.

    Returns ``(songs, merged_names)``; merged_names holds the distinct names
    of 2nd+ occurrences with the position of their first such occurrence."""
    s = F.col("seq")
    aggs = [F.min(s).alias("first_seq"), F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.min_by(c, s).alias(c) for c in ("title", "artist", "vibe", "genres", "tags")]
    aggs += [F.min_by(k, F.when(F.col(k).isNotNull(), s)).alias(k) for k in FEATURE_KEYS]
    firsts = kept.groupBy("id").agg(*aggs)
    genres = ordered_union_by_key(kept, "id", "genres", ",")
    tags = ordered_union_by_key(kept, "id", "tags", ";")
    songs = (firsts.join(genres, "id", "left").join(tags, "id", "left")
             .withColumn("genres", F.when(F.col("n_rows") > 1, F.coalesce("genres_merged", F.lit("")))
                         .otherwise(F.col("genres")))
             .withColumn("tags", F.when(F.col("n_rows") > 1, F.coalesce("tags_merged", F.lit("")))
                         .otherwise(F.col("tags")))
             .drop("genres_merged", "tags_merged"))
    dups = (kept.join(firsts.select("id", "first_seq"), "id")
                .where(F.col("seq") > F.col("first_seq")))
    merged = dups.groupBy("name").agg(F.min("seq").alias("seq"))
    return songs, merged


def build_document(genres, vibe, tags) -> F.Column:
    """``Genres: g.`` (if any), the vibe, ``Vibe: t.`` (if any)."""
    g, v, t = (F.col(x) if isinstance(x, str) else x for x in (genres, vibe, tags))
    return F.concat_ws(" ", F.when(g != "", F.concat(F.lit("Genres: "), g, F.lit("."))),
                       py_strip(v), F.when(t != "", F.concat(F.lit("Vibe: "), t, F.lit("."))))


def build_document_full(genres, vibe, tags) -> F.Column:
    """N18 variant: both labels always printed, ``unknown genre`` when blank."""
    g, v, t = (F.col(x) if isinstance(x, str) else x for x in (genres, vibe, tags))
    return F.concat(F.lit("Genres: "), F.when(F.coalesce(g, F.lit("")) != "", g).otherwise(F.lit("unknown genre")),
                    F.lit(". "), F.coalesce(v, F.lit("")), F.lit(" Vibe: "), F.coalesce(t, F.lit("")), F.lit("."))


def import_catalog(raw: DataFrame, seq: str = "_seq") -> dict[str, DataFrame]:
    """Whole import: songs (with document and source), skipped, bad_numbers,
    merged and a one-row report."""
    clean = clean_rows(raw, seq)
    kept = kept_rows(clean)
    songs, merged = merge_duplicates(kept)
    songs = songs.withColumn("document", build_document("genres", "vibe", "tags")) \
                 .withColumn("source", F.lit("csv"))
    skipped = skipped_rows(clean)
    bad = bad_numbers(kept)
    report = import_report(songs, merged, skipped, bad)
    return {"songs": songs, "skipped": skipped, "bad_numbers": bad, "merged": merged, "report": report}


def import_report(songs, merged, skipped, bad) -> DataFrame:
    """Four counts in one row (the other three counts are scalar
    subqueries, so no join is planned)."""
    def n(df):
        return df.agg(F.count(F.lit(1)).cast("bigint"))
    return songs.agg(F.count(F.lit(1)).cast("bigint").alias("imported")).select(
        "imported", n(merged).scalar().alias("merged"), n(skipped).scalar().alias("skipped"),
        n(bad).scalar().alias("bad_numbers"))


def typed_metadata(raw: DataFrame) -> DataFrame:
    """Strict casts (a bad number fails the job under ANSI), booleans
    from ``upper(trim(x)) = 'TRUE'``."""
    out = raw.select(
        F.element_at(F.split(_raw(raw, COL_URI), ":"), -1).alias("id"),
        _raw(raw, COL_TITLE).alias("track_name"), _raw(raw, COL_ARTIST).alias("artist"),
        _raw(raw, "Album Name").alias("album"), F.coalesce(_raw(raw, COL_GENRES), F.lit("")).alias("genres"),
        _raw(raw, COL_URI).alias("track_uri"),
        F.trim(_raw(raw, "Popularity")).cast("int").alias("popularity"),
        (F.upper(F.trim(_raw(raw, "Explicit"))) == "TRUE").alias("explicit"),
        F.trim(_raw(raw, "Duration (ms)")).cast("int").alias("duration_ms"),
        *[strict_double(F.trim(_raw(raw, c))).alias(k) for c, k in FLOAT_FIELDS],
    )
    return out


def strict_double(text) -> F.Column:
    """A number as Python reads it; anything else, Java's ``1d`` too, fails the job."""
    value = lenient_double(text)
    plain = F.lower(py_strip(text)).isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
    return F.when(text.isNull() | value.isNotNull() | plain, F.coalesce(value, text.try_cast("double"))).otherwise(
        F.raise_error(F.concat(F.lit("could not convert string to float: "), text)).cast("double"))


# ------------------------------------------------------------ table upkeep

def upsert(table: DataFrame, batch: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """Batch rows replace table rows with the same key (whole-row
    replace); new keys are appended.  A key that the batch repeats keeps its
    last row by ``seq`` (the batch's order column; without one, the largest
    row), so a key is never twice in the result.  One aggregate over the
    batch, an anti join and a union."""
    row = F.struct(*[F.col(c) for c in table.columns])
    last = F.max_by(row, F.col(seq)) if seq else F.max(row)
    once = batch.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(once)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Remove rows whose key is in ``ids``."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_matched(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """S9 delete report: how many of the requested ids matched a row."""
    req = ids.select(key).distinct()
    hit = req.join(table.select(key), key, "left_semi")
    return hit.agg(F.count(F.lit(1)).cast("bigint").alias("matched")).withColumn(
        "deleted", F.col("matched") > 0)


# Length of a playlist's id; a longer one where that is taken.
ID_CHARS = 8


def save_playlists(existing: DataFrame, batch: DataFrame, now: str, save: str | None = None) -> DataFrame:
    """Playlists upsert.  Rows without an id get one and ``created_at =
    now``; every saved row gets ``updated_at = now``; empty track lists are
    rejected by a filter (reported by :func:`rejected_playlists`).

    A new id is the beginning of a digest over the row's fields as JSON, its
    number among equal rows and ``save``, which names this save (its version,
    or a random name), and the whole digest where the beginning is taken by
    another row, so no playlist replaces another."""
    ok = batch.where(F.size("tracks") > 0)
    save = uuid.uuid4().hex if save is None else save
    # Equal new playlists are told apart by their number among equals.
    twin = Window.partitionBy("name", "query", F.col("id").isNull()).orderBy(F.to_json(F.struct("tracks")))
    fields = F.struct("name", "query", F.lit(now).alias("now"), F.row_number().over(twin).alias("nth"), F.lit(save).alias("save"))
    ok = ok.withColumn("_digest", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))
    short = F.substring("_digest", 1, ID_CHARS)
    taken = existing.select("id").unionByName(batch.select("id")).where(F.col("id").isNotNull()).distinct().select(
        F.col("id").alias("_short"), F.lit(True).alias("_taken"))
    ok = ok.withColumn("_short", F.when(F.col("id").isNull(), short)).join(taken, "_short", "left")
    alone = F.count("*").over(Window.partitionBy("_short")) == 1
    new_id = F.when(alone & F.col("_taken").isNull(), F.col("_short")).otherwise(F.col("_digest"))
    saved = (ok.withColumn("_new", new_id)
               .withColumn("created_at", F.when(F.col("id").isNull(), F.lit(now)).otherwise(F.col("created_at")))
               .withColumn("id", F.coalesce("id", "_new"))
               .withColumn("updated_at", F.lit(now)))
    return upsert(existing, saved.select(*existing.columns), "id")


def rejected_playlists(batch: DataFrame) -> DataFrame:
    return batch.where(F.coalesce(F.size("tracks"), F.lit(0)) <= 0).select(
        "name", F.lit("Add at least one song before saving.").alias("error"))


def newest_first(df: DataFrame, col: str = "updated_at") -> DataFrame:
    """Newest first, missing timestamps last."""
    return df.orderBy(F.coalesce(F.col(col), F.lit("")).desc())


def library_listing(songs: DataFrame) -> DataFrame:
    """By lower(artist), lower(title), then id for a total order."""
    return songs.orderBy(F.lower("artist"), F.lower("title"), "id")


def find_songs(songs: DataFrame, text: str) -> DataFrame:
    """case-insensitive substring of title or artist (no wildcards);
    empty text matches everything."""
    t = F.lit((text or "").lower())
    return songs.where(F.contains(F.lower("title"), t) | F.contains(F.lower("artist"), t))


def track_snapshot(songs: DataFrame) -> DataFrame:
    """F8: id, title, artist and the energy/valence when known."""
    return songs.select("id", "title", "artist", "energy", "valence")


def seen_union(seen: DataFrame, shown: DataFrame, keys=("session", "id")) -> DataFrame:
    """Seen-set union across regenerations."""
    return seen.select(*keys).unionByName(shown.select(*keys)).distinct()
