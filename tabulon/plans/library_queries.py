"""Catalog import and upkeep queries over a song-shaped view of ``part``:
64 distinct part names over the whole table give heavy duplicate merging;
blank fields, bad numbers and URI-less rows are injected by expression."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulon.operators import library as L
from tabulon.plans.registry import register
from tabulon.session import checkpoint_dir
from tabulon.sources.csv_records import csv_files
from tabulon.sources.testdata import table
from tabulon.sources.versioned import VersionedTable
from tabulon.streaming.upsert_stream import upsert_stream


def part_song_rows(spark, sf):
    """Raw song rows (all strings, export column names) from part."""
    p = table(spark, sf, "part")
    size = F.col("p_size")
    name_us = F.regexp_replace("p_name", " ", "_")
    return p.select(
        F.when(size > 10, F.concat(F.lit("catalog:part:"), name_us)).otherwise(F.lit("")).alias(L.COL_URI),
        F.when(size == 1, F.lit("")).otherwise(F.col("p_name")).alias(L.COL_TITLE),
        F.when(size == 2, F.lit(" ")).otherwise(F.col("p_brand")).alias(L.COL_ARTIST),
        F.when(size == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("p_type"), F.lit(" parts, size "), size.cast("string"))).alias(L.COL_VIBE),
        F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type"))
         .otherwise(F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"))).alias(L.COL_GENRES),
        F.concat(F.lit("size"), size.cast("string"), F.lit("; "), F.col("p_brand")).alias(L.COL_TAGS),
        F.when(size == 50, F.lit("n/a"))
         .otherwise((F.col("p_retailprice") / 2000).cast("string")).alias("Energy"),
        F.when(size >= 45, F.lit(""))
         .otherwise((size / F.lit(50.0)).cast("string")).alias("Valence"),
        F.col("p_size").cast("string").alias("Popularity"),
        F.when(size % 2 == 0, F.lit(" true")).otherwise(F.lit("FALSE")).alias("Explicit"),
        (F.col("p_partkey") * 1000).cast("string").alias("Duration (ms)"),
        F.col("p_brand").alias("Album Name"),
        F.col("p_partkey").alias("_seq"),
    )


RAW_SQL = """
raw AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_size > 10 THEN 'catalog:part:' || replace(p_name, ' ', '_') ELSE '' END AS uri,
         CASE WHEN p_size = 1 THEN '' ELSE p_name END AS title,
         CASE WHEN p_size = 2 THEN '' ELSE p_brand END AS artist,
         CASE WHEN p_size = 3 THEN '' ELSE p_type || ' parts, size ' || CAST(p_size AS VARCHAR) END AS vibe,
         CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type || ', ' || p_brand END AS genres,
         'size' || CAST(p_size AS VARCHAR) || '; ' || p_brand AS tags,
         CASE WHEN p_size = 50 THEN NULL ELSE p_retailprice / 2000 END AS energy,
         CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS energy_bad,
         CASE WHEN p_size >= 45 THEN NULL ELSE p_size / 50.0 END AS valence,
         p_size, p_brand
  FROM part),
clean AS (
  SELECT *,
         CASE WHEN title <> '' THEN title ELSE '(no title)' END || ' - ' ||
         CASE WHEN artist <> '' THEN artist ELSE '(no artist)' END AS name,
         concat_ws(', ', CASE WHEN title = '' THEN 'title' END, CASE WHEN artist = '' THEN 'artist' END,
                   CASE WHEN vibe = '' THEN 'vibe description' END) AS missing,
         CASE WHEN uri <> '' THEN string_split(uri, ':')[-1]
              ELSE 'manual:' || trim(regexp_replace(lower(artist || '-' || title), '[^a-zA-Z0-9_]+', '-', 'g'), '-') END AS id
  FROM raw),
kept AS (SELECT * FROM clean WHERE missing = '')"""

SONGS_SQL = RAW_SQL + """,
firsts AS (
  SELECT id, min(seq) AS first_seq, count(*) AS n_rows,
         arg_min(title, seq) AS title, arg_min(artist, seq) AS artist, arg_min(vibe, seq) AS vibe,
         arg_min(genres, seq) AS genres_raw, arg_min(tags, seq) AS tags_raw,
         arg_min(energy, seq) FILTER (WHERE energy IS NOT NULL) AS energy,
         arg_min(valence, seq) FILTER (WHERE valence IS NOT NULL) AS valence
  FROM kept GROUP BY id),
g_items AS (
  SELECT id, seq, pos, trim(item) AS item FROM (
    SELECT id, seq, unnest(string_split(genres, ',')) AS item,
           unnest(generate_series(1, len(string_split(genres, ',')))) AS pos FROM kept)
  WHERE trim(item) <> ''),
g_first AS (
  SELECT id, item, seq, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY id, lower(item) ORDER BY seq, pos) AS rn FROM g_items) WHERE rn = 1),
g AS (SELECT id, string_agg(item, ',' ORDER BY seq, pos) AS genres_merged FROM g_first GROUP BY id),
t_items AS (
  SELECT id, seq, pos, trim(item) AS item FROM (
    SELECT id, seq, unnest(string_split(tags, ';')) AS item,
           unnest(generate_series(1, len(string_split(tags, ';')))) AS pos FROM kept)
  WHERE trim(item) <> ''),
t_first AS (
  SELECT id, item, seq, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY id, lower(item) ORDER BY seq, pos) AS rn FROM t_items) WHERE rn = 1),
t AS (SELECT id, string_agg(item, ';' ORDER BY seq, pos) AS tags_merged FROM t_first GROUP BY id),
songs AS (
  SELECT f.id, f.title, f.artist, f.vibe,
         CASE WHEN f.n_rows > 1 THEN coalesce(g.genres_merged, '') ELSE f.genres_raw END AS genres,
         CASE WHEN f.n_rows > 1 THEN coalesce(t.tags_merged, '') ELSE f.tags_raw END AS tags,
         f.energy, f.valence
  FROM firsts f LEFT JOIN g USING (id) LEFT JOIN t USING (id))"""


def _songs(spark, sf):
    return L.import_catalog(part_song_rows(spark, sf))


@register("library_import_songs", "WITH " + SONGS_SQL + """
SELECT id, title, artist, vibe, genres, tags, round(energy, 6) AS energy, round(valence, 6) AS valence,
       concat_ws(' ', CASE WHEN genres <> '' THEN 'Genres: ' || genres || '.' END, vibe,
                 CASE WHEN tags <> '' THEN 'Vibe: ' || tags || '.' END) AS document,
       'csv' AS source
FROM songs""")
def library_import_songs(spark, sf):
    """Cleaned, merged songs with their documents."""
    s = _songs(spark, sf)["songs"]
    return s.select("id", "title", "artist", "vibe", "genres", "tags",
                    F.round("energy", 6).alias("energy"), F.round("valence", 6).alias("valence"),
                    "document", "source")


@register("library_import_skipped", "WITH " + RAW_SQL + """
SELECT seq, 'line ' || CAST(seq + 2 AS VARCHAR) || ': ' || name AS label, 'missing ' || missing AS reason
FROM clean WHERE missing <> ''""")
def library_import_skipped(spark, sf):
    """N12 skip report."""
    return _songs(spark, sf)["skipped"]


@register("library_import_bad_numbers", "WITH " + RAW_SQL + """
SELECT seq, name, 'Energy' AS "column" FROM kept WHERE energy_bad = 1""")
def library_import_bad_numbers(spark, sf):
    """N14 bad-number report."""
    return _songs(spark, sf)["bad_numbers"]


@register("library_import_merged", "WITH " + RAW_SQL + """,
firsts AS (SELECT id, min(seq) AS first_seq FROM kept GROUP BY id)
SELECT name, min(seq) AS seq FROM kept JOIN firsts USING (id) WHERE seq > first_seq GROUP BY name""")
def library_import_merged(spark, sf):
    """N15 merged-names report (distinct names of 2nd+ occurrences)."""
    return _songs(spark, sf)["merged"]


@register("library_import_report", "WITH " + RAW_SQL + """,
firsts AS (SELECT id, min(seq) AS first_seq FROM kept GROUP BY id)
SELECT (SELECT CAST(count(DISTINCT id) AS BIGINT) FROM kept) AS imported,
       (SELECT CAST(count(DISTINCT name) AS BIGINT) FROM kept JOIN firsts USING (id) WHERE seq > first_seq) AS merged,
       (SELECT CAST(count(*) AS BIGINT) FROM clean WHERE missing <> '') AS skipped,
       (SELECT CAST(count(*) AS BIGINT) FROM kept WHERE energy_bad = 1) AS bad_numbers""")
def library_import_report(spark, sf):
    """N17 summary."""
    return _songs(spark, sf)["report"]


@register("library_documents_full", "WITH " + RAW_SQL + """
SELECT seq, 'Genres: ' || CASE WHEN genres <> '' THEN genres ELSE 'unknown genre' END || '. ' ||
       vibe || ' Vibe: ' || tags || '.' AS document FROM raw""")
def library_documents_full(spark, sf):
    """N18 variant with both labels always present."""
    raw = part_song_rows(spark, sf)
    return raw.select(F.col("_seq").alias("seq"),
                      L.build_document_full(F.col(L.COL_GENRES), F.coalesce(F.col(L.COL_VIBE), F.lit("")),
                                            F.col(L.COL_TAGS)).alias("document"))


@register("library_typed_metadata", """
SELECT CASE WHEN p_size > 10 THEN 'catalog:part:' || replace(p_name, ' ', '_') ELSE '' END AS track_uri,
       p_name AS track_name, CAST(p_size AS INTEGER) AS popularity, p_size % 2 = 0 AS explicit,
       CAST(p_partkey * 1000 AS INTEGER) AS duration_ms, round(p_retailprice / 2000, 6) AS energy
FROM part""")
def library_typed_metadata(spark, sf):
    """Strict typed metadata (int, bool from TRUE text, float)."""
    p = table(spark, sf, "part")
    rows = p.select(
        F.when(F.col("p_size") > 10, F.concat(F.lit("catalog:part:"), F.regexp_replace("p_name", " ", "_")))
         .otherwise(F.lit("")).alias(L.COL_URI),
        F.col("p_name").alias(L.COL_TITLE), F.col("p_brand").alias(L.COL_ARTIST),
        F.col("p_size").cast("string").alias("Popularity"),
        F.when(F.col("p_size") % 2 == 0, F.lit(" true")).otherwise(F.lit("FALSE")).alias("Explicit"),
        (F.col("p_partkey") * 1000).cast("string").alias("Duration (ms)"),
        (F.col("p_retailprice") / 2000).cast("string").alias("Energy"),
    )
    t = L.typed_metadata(rows)
    return t.select("track_uri", "track_name", "popularity", "explicit", "duration_ms",
                    F.round("energy", 6).alias("energy"))


@register("library_find", "WITH " + SONGS_SQL + """
SELECT id, title, artist FROM songs
WHERE contains(lower(title), 'ring') OR contains(lower(artist), 'ring')""")
def library_find(spark, sf):
    """case-insensitive substring over title or artist."""
    return L.find_songs(_songs(spark, sf)["songs"], "RING").select("id", "title", "artist")


@register("library_tracks", "WITH " + SONGS_SQL + """
SELECT id, title, artist, round(energy, 6) AS energy, round(valence, 6) AS valence FROM songs""")
def library_tracks(spark, sf):
    """F8 + T1: track snapshots in listing order."""
    t = L.track_snapshot(L.library_listing(_songs(spark, sf)["songs"]))
    return t.select("id", "title", "artist", F.round("energy", 6).alias("energy"),
                    F.round("valence", 6).alias("valence"))


UPSERT_SQL = """
WITH batch AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal + 100 AS acctbal, c_mktsegment AS segment
  FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL
  SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier),
base AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
                c_mktsegment AS segment FROM customer)
SELECT id, name, CAST(nationkey AS INTEGER) AS nationkey, round(acctbal, 2) AS acctbal, segment
FROM base WHERE id NOT IN (SELECT id FROM batch)
UNION ALL SELECT id, name, CAST(nationkey AS INTEGER), round(acctbal, 2), segment FROM batch"""


@register("library_upsert", UPSERT_SQL)
def library_upsert(spark, sf):
    """Keyed upsert of an update batch (one market segment re-priced)
    plus new keys (suppliers) into the customer table."""
    c = table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
                    F.col("c_mktsegment").alias("segment"))
    upd = (base.where(F.col("segment") == "AUTOMOBILE")
               .withColumn("acctbal", F.col("acctbal") + 100))
    s = table(spark, sf, "supplier")
    new = s.select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("name"),
                   F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"),
                   F.lit("SUPPLIER").alias("segment"))
    out = L.upsert(base, upd.unionByName(new), "id")
    return out.withColumn("acctbal", F.round("acctbal", 2))


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("library_import_files", "WITH " + SONGS_SQL.replace(
    "' parts, size ' || CAST(p_size AS VARCHAR) END AS vibe",
    "' parts,' || chr(10) || '\"size\" ' || CAST(p_size AS VARCHAR) END AS vibe") + """
SELECT id, title, artist, vibe, genres, tags, round(energy, 6) AS energy, round(valence, 6) AS valence FROM songs""")
def library_import_files(spark, sf):
    """S1 + N15: the same songs from several CSV files with line breaks and
    quotes inside fields, written to the shared folder in ranges of the song
    order; the first file wins."""
    path = _scratch(spark, "songs-csv")
    rows = part_song_rows(spark, sf).withColumn(
        L.COL_VIBE, F.regexp_replace(L.COL_VIBE, "parts, size ", 'parts,\n"size" '))
    (rows.repartitionByRange(5, "_seq").sortWithinPartitions("_seq").drop("_seq")
         .write.option("header", True).option("quote", '"').option("escape", '"').csv(path))
    s = L.import_catalog(csv_files(spark, path))["songs"]
    return s.select("id", "title", "artist", "vibe", "genres", "tags", F.round("energy", 6).alias("energy"),
                    F.round("valence", 6).alias("valence"))


@register("library_upsert_stream", """
SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS last_order, arg_max(o_totalprice, o_orderkey) AS last_price
FROM orders GROUP BY o_custkey""")
def library_upsert_stream(spark, sf):
    """S8 as a stream: orders in files of key ranges, one micro-batch each,
    upsert every customer's last order into a versioned table."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("last_order"),
                                             F.col("o_totalprice").alias("last_price"))
    root = _scratch(spark, "orders-upsert")
    for k, (low, high) in enumerate(((0.0, 0.4), (0.4, 0.7), (0.7, 1.1))):
        top = rows.agg(F.max("last_order")).scalar()
        part = rows.where((F.col("last_order") >= top * low) & (F.col("last_order") < top * high))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    target = VersionedTable(spark, f"{root}/table", rows.schema)
    query = upsert_stream(stream, target, f"{root}/checkpoint", "id", "last_order")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return target.read()


@register("library_playlist_store", """
WITH b AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS tracks, min(o_orderdate) AS d
           FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
f AS (SELECT substring(sha256('{"name":"orders of ' || o_custkey || '","query":"' || o_custkey
        || '","now":"2024-01-01","nth":1,"save":"v1"}'), 1, 8) AS i8, * FROM b),
n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY i8) = 1 THEN i8 ELSE
        sha256('{"name":"orders of ' || o_custkey || '","query":"' || o_custkey || '","now":"2024-01-01","nth":1,"save":"v1"}') END AS id FROM f)
SELECT id, 'orders of ' || o_custkey AS name, CAST(o_custkey AS VARCHAR) AS query,
  CASE WHEN o_custkey % 3 = 0 THEN 'none' ELSE tracks END AS track_ids, '2024-01-01' AS created_at,
  CASE WHEN o_custkey % 3 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM n WHERE o_custkey % 5 <> 0""")
def library_playlist_store(spark, sf):
    """Playlists (urgent orders of a customer) saved, some saved again
    under their ids, some deleted; each step swaps in a version; loaded
    newest first."""
    schema = "id string, name string, query string, tracks array<string>, created_at string, updated_at string"
    store = VersionedTable(spark, _scratch(spark, "playlists"), schema)
    orders = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    none = F.lit(None).cast("string")
    new = orders.groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("tracks")).select(
        none.alias("id"), F.concat(F.lit("orders of "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_custkey").cast("string").alias("query"), "tracks", none.alias("created_at"), none.alias("updated_at"))
    store.commit(L.save_playlists(store.read(), new, "2024-01-01", save="v1"))
    number = F.col("query").cast("bigint")
    again = store.read().where(number % 3 == 0).withColumn("tracks", F.array(F.lit("none")))
    store.commit(L.save_playlists(store.read(), again, "2024-02-01", save="v2"))
    store.commit(L.delete_ids(store.read(), store.read().where(number % 5 == 0).select("id"), "id"))
    return L.newest_first(store.read()).select("id", "name", "query", F.array_join("tracks", ",").alias("track_ids"),
                                               "created_at", "updated_at")


@register("library_delete", """
SELECT p_partkey AS id, p_name FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)""")
def library_delete(spark, sf):
    """Delete the parts that were ever returned in a large quantity."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    ids = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).select(F.col("l_partkey").alias("id"))
    return L.delete_ids(p, ids, "id")


@register("library_delete_matched", """
SELECT CAST(count(*) AS BIGINT) AS matched, count(*) > 0 AS deleted FROM (
  SELECT DISTINCT l_suppkey + 990 AS id FROM lineitem) r
WHERE id IN (SELECT s_suppkey FROM supplier)""")
def library_delete_matched(spark, sf):
    """S9 delete report: how many requested ids (shifted supplier keys seen in
    lineitem, many of them unknown) matched."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    req = table(spark, sf, "lineitem").select((F.col("l_suppkey") + 990).alias("id"))
    return L.delete_matched(s, req, "id")
