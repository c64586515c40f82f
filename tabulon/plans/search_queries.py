"""Search queries: vector top-k against per-label centroids of ``embeddings``;
token-overlap top-k of ``benchmark`` texts against a cost table derived from
lineitem x part x supplier (one row per supplier and brand, shaped like the
hospital cost file); grounded contexts; catalog match of conversation turns;
level-range filters on the imported catalog; cost comparison (A9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulon.operators import search as S
from tabulon.operators import vector_cells as V
from tabulon.plans.library_queries import SONGS_SQL, _songs
from tabulon.plans.registry import register
from tabulon.session import checkpoint_dir, cut_lineage
from tabulon.sources.dims import DRINK_MENU, FILTER_LEVELS
from tabulon.sources.testdata import table

K = 10


def label_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    c = S.centroids(e, "label")
    return c.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("query_id"), "query_vec")


VEC_SQL = """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                  unnest(generate_series(1, len(embedding))) AS pos FROM embeddings {where}),
ce AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
              unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
c AS (SELECT 'label_' || CAST(label AS VARCHAR) AS query_id, pos, avg(x) AS cx FROM ce GROUP BY label, pos),
d AS (SELECT c.query_id, e.vec_id, sum((e.x - c.cx) * (e.x - c.cx)) AS distance
      FROM e JOIN c USING (pos) GROUP BY c.query_id, e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
"""


def _vec_out(df):
    return df.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@register("search_vector_topk", VEC_SQL.format(where="") + """
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def search_vector_topk(spark, sf):
    """T4: exact 10 nearest embeddings to each label centroid."""
    return _vec_out(S.vector_topk(table(spark, sf, "embeddings"), label_queries(spark, sf), K))


@register("search_vector_filtered", VEC_SQL.format(where="WHERE embedding[1] >= 0") + """
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def search_vector_filtered(spark, sf):
    """T4 with a range filter on the vectors (applied before the cut)."""
    return _vec_out(S.vector_topk(table(spark, sf, "embeddings"), label_queries(spark, sf), K,
                                  where=F.col("embedding")[0] >= 0))


@register("search_vector_exclude", VEC_SQL.format(where="") + """
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank - 10 AS BIGINT) AS rank
FROM r WHERE rank BETWEEN 11 AND 20""")
def search_vector_exclude(spark, sf):
    """T6/J5/T7 'regenerate': the next 10 after excluding everything shown
    on the first page (over-fetch + anti join before the cut)."""
    e = table(spark, sf, "embeddings")
    q = label_queries(spark, sf)
    first = S.vector_topk(e, q, K).select("query_id", "vec_id")
    return _vec_out(S.vector_topk(e, q, K, exclude=first))


@register("search_vector_page", VEC_SQL.format(where="") + """
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank
FROM r WHERE rank BETWEEN 21 AND 30""")
def search_vector_page(spark, sf):
    """T7 'more': page 3 of the ranked list with original rank numbers."""
    return _vec_out(S.vector_topk(table(spark, sf, "embeddings"), label_queries(spark, sf), K, rank_from=21))


@register("search_new_playlists", VEC_SQL.format(where="") + """
SELECT query_id, query_id AS name, CAST(count(*) AS BIGINT) AS size,
       string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS track_ids
FROM r WHERE rank <= 10 GROUP BY query_id""")
def search_new_playlists(spark, sf):
    """One playlist per request, tracks nested in rank order."""
    q = label_queries(spark, sf)
    res = S.vector_topk(table(spark, sf, "embeddings"), q, K)
    pl = S.playlists_from_results(res, q.select("query_id", F.col("query_id").alias("name")))
    return pl.select("query_id", "name", "size",
                     F.array_join(F.transform("tracks", lambda x: x.cast("string")), ",").alias("track_ids"))


@register("search_playlist_records", VEC_SQL.format(where="WHERE embedding[1] >= 0.5 AND embedding[2] >= 0.5") + """,
found AS (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS track_ids, count(*) AS n FROM r WHERE rank <= 10 GROUP BY query_id)
SELECT q.query_id, CAST(NULL AS VARCHAR) AS id, q.query_id AS name, q.query_id AS query, 'high,high' AS filters, CAST(10 AS BIGINT) AS size,
       CAST(coalesce(n, 0) AS BIGINT) AS n_tracks, coalesce(track_ids, '') AS track_ids, CAST(NULL AS VARCHAR) AS created_at,
       CAST(NULL AS VARCHAR) AS updated_at
FROM (SELECT DISTINCT query_id FROM c) q LEFT JOIN found USING (query_id)""")
def search_playlist_records(spark, sf):
    """Whole unsaved records; the filters leave few vectors, so fewer tracks are found than asked for."""
    high = (F.col("embedding")[0] >= 0.5) & (F.col("embedding")[1] >= 0.5)
    q = label_queries(spark, sf)
    res = S.vector_topk(table(spark, sf, "embeddings"), q, K, where=high)
    filters = F.create_map(F.lit("first"), F.lit("high"), F.lit("second"), F.lit("high"))
    asked = q.select("query_id", F.concat(F.lit("  "), F.col("query_id"), F.lit(" ")).alias("query"), filters.alias("filters"))
    out = S.new_playlist_records(res, asked, K)
    return out.select("query_id", "id", "name", "query", F.array_join(F.map_values("filters"), ",").alias("filters"), "size",
                      F.size("tracks").cast("bigint").alias("n_tracks"),
                      F.array_join(F.transform("tracks", lambda x: x.cast("string")), ",").alias("track_ids"), "created_at", "updated_at")


@register("search_vector_cells", VEC_SQL.format(where="") + """
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank BETWEEN 4 AND 23""")
def search_vector_cells(spark, sf):
    """T4 + T7 over stored cells: ranks 4 to 23 of the embeddings nearest to each label centroid."""
    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    index = V.build_cells(table(spark, sf, "embeddings"), path, 32)
    return _vec_out(V.cell_topk(index, label_queries(spark, sf), 20, rank_from=4))


@register("search_level_filter", "WITH " + SONGS_SQL + """
SELECT id, title, round(energy, 6) AS energy, round(valence, 6) AS valence FROM songs
WHERE energy >= 0.4 AND energy <= 0.7 AND valence >= 0.0 AND valence <= 0.3""")
def search_level_filter(spark, sf):
    """energy 'medium' and valence 'sad', both ends inclusive."""
    songs = _songs(spark, sf)["songs"]
    cond = S.level_filter(songs, {"energy": "medium", "valence": "sad"}, FILTER_LEVELS)
    return songs.where(cond).select("id", "title", F.round("energy", 6).alias("energy"),
                                    F.round("valence", 6).alias("valence"))


# ------------------------------------------------------------- cost table

def _cents(x):
    return F.round(x * 100).cast("bigint")


def _money(avg_cents):
    return F.concat((avg_cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((avg_cents % 100).cast("string"), 2, "0"))


def cost_table(spark, sf):
    """Hospital-shaped cost rows: provider = supplier, DRG = part brand.
    Averages are exact (integer cents, half up)."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    pay = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    agg = j.groupBy("l_suppkey", "p_brand").agg(
        F.count(F.lit(1)).alias("dis"),
        F.sum(_cents(F.col("l_extendedprice"))).alias("billed_c"),
        F.sum(_cents(pay)).alias("total_c"),
        F.sum(_cents(pay * (1 + F.col("l_tax")))).alias("mdcr_c"))
    agg = (agg.join(s, agg.l_suppkey == s.s_suppkey)
              .join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey)
              .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey))
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1)

    def avg_c(c):
        return F.floor((2 * F.col(c) + F.col("dis")) / (2 * F.col("dis"))).cast("bigint")
    return agg.select(
        (F.col("s_suppkey") * 1000 + brand_no.cast("bigint")).alias("seq"),
        F.col("s_suppkey").cast("string").alias("Rndrng_Prvdr_CCN"),
        F.col("s_name").alias("Rndrng_Prvdr_Org_Name"),
        F.col("n_name").alias("Rndrng_Prvdr_City"),
        F.col("r_name").alias("Rndrng_Prvdr_State_Abrvtn"),
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("Rndrng_Prvdr_Zip5"),
        F.when(F.col("s_acctbal") > 5000, F.lit("Metropolitan area core")).otherwise(F.lit("Rural area"))
         .alias("Rndrng_Prvdr_RUCA_Desc"),
        brand_no.alias("DRG_Cd"),
        F.concat(F.col("p_brand"), F.lit(" supply and handling")).alias("DRG_Desc"),
        F.col("dis").cast("string").alias("Tot_Dschrgs"),
        _money(avg_c("billed_c")).alias("Avg_Submtd_Cvrd_Chrg"),
        _money(avg_c("total_c")).alias("Avg_Tot_Pymt_Amt"),
        _money(avg_c("mdcr_c")).alias("Avg_Mdcr_Pymt_Amt"),
    )


def _money_sql(c):
    return (f"CAST(CAST(floor((2 * {c} + dis) / (2 * dis)) AS BIGINT) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(CAST(floor((2 * {c} + dis) / (2 * dis)) AS BIGINT) % 100 AS VARCHAR), 2, '0')")


COST_SQL = f"""
agg AS (
  SELECT l_suppkey, p_brand, count(*) AS dis,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS billed_c,
         sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS total_c,
         sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS mdcr_c
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand),
cost AS (
  SELECT s_suppkey * 1000 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS seq,
         CAST(s_suppkey AS VARCHAR) AS Rndrng_Prvdr_CCN, s_name AS Rndrng_Prvdr_Org_Name,
         n_name AS Rndrng_Prvdr_City, r_name AS Rndrng_Prvdr_State_Abrvtn,
         lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS Rndrng_Prvdr_Zip5,
         CASE WHEN s_acctbal > 5000 THEN 'Metropolitan area core' ELSE 'Rural area' END AS Rndrng_Prvdr_RUCA_Desc,
         regexp_extract(p_brand, '(\\d+)', 1) AS DRG_Cd, p_brand || ' supply and handling' AS DRG_Desc,
         CAST(dis AS VARCHAR) AS Tot_Dschrgs,
         {_money_sql('billed_c')} AS Avg_Submtd_Cvrd_Chrg,
         {_money_sql('total_c')} AS Avg_Tot_Pymt_Amt,
         {_money_sql('mdcr_c')} AS Avg_Mdcr_Pymt_Amt
  FROM agg JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey)"""

LINE_SQL = ("'- ' || Rndrng_Prvdr_Org_Name || ' | ' || Rndrng_Prvdr_City || ', ' || Rndrng_Prvdr_State_Abrvtn"
            " || ' ' || Rndrng_Prvdr_Zip5 || ' | DRG ' || DRG_Cd || ': ' || DRG_Desc || ' | Discharges: ' || "
            "Tot_Dschrgs || ' | Avg Billed: $' || Avg_Submtd_Cvrd_Chrg || ' | Avg Total Payment: $' || "
            "Avg_Tot_Pymt_Amt || ' | Avg Medicare Payment: $' || Avg_Mdcr_Pymt_Amt")

TOKENS_SQL = ("list_transform(list_filter(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), "
              "'\\s+'), lambda t: length(t) > 1), lambda t: lower(t))")

TOKEN_TOPK_SQL = "WITH " + COST_SQL + f""",
hay AS (SELECT seq, lower(concat_ws(' ', Rndrng_Prvdr_Org_Name, Rndrng_Prvdr_City, Rndrng_Prvdr_State_Abrvtn,
                                   Rndrng_Prvdr_Zip5, DRG_Desc, Rndrng_Prvdr_RUCA_Desc)) AS hay FROM cost),
q AS (SELECT item_id, {TOKENS_SQL} AS toks FROM benchmark),
s AS (SELECT q.item_id AS query_id, hay.seq,
             CAST(len(list_filter(q.toks, lambda t: contains(hay.hay, t))) AS BIGINT) AS score FROM q CROSS JOIN hay),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS BIGINT) AS rank
           FROM s)"""


def _token_ranked(spark, sf):
    cost = cut_lineage(cost_table(spark, sf))  # in place of the stored table; read several times
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return cost, S.token_topk(cost, q, 50, fact_id="seq", hay_cols=S.COST_SEARCH_FIELDS)


@register("search_token_topk", TOKEN_TOPK_SQL + """
SELECT query_id, seq, score, rank FROM ranked WHERE rank <= 50""")
def search_token_topk(spark, sf):
    """T5: the 50 most relevant cost rows per benchmark text (zero-score rows
    fill up in file order)."""
    return _token_ranked(spark, sf)[1]


@register("search_row_text", "WITH " + COST_SQL + f"\nSELECT seq, {LINE_SQL} AS line FROM cost")
def search_row_text(spark, sf):
    """One formatted text line per cost row."""
    cost = cost_table(spark, sf)
    return cost.select("seq", S.cost_row_text(cost).alias("line"))


@register("search_grounded_context", TOKEN_TOPK_SQL + f""",
lines AS (SELECT seq, {LINE_SQL} AS line FROM cost)
SELECT query_id, CAST(count(*) AS BIGINT) AS n_records,
       'Here is the relevant hospital data for this query (' || CAST(count(*) AS VARCHAR) || ' records):' ||
       chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS context
FROM ranked JOIN lines USING (seq) WHERE rank <= 50 GROUP BY query_id""")
def search_grounded_context(spark, sf):
    """Per request, the formatted top rows behind a count header."""
    cost, ranked = _token_ranked(spark, sf)
    return S.grounded_context(ranked, cost, "seq")


def _catalog_sql_values():
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {q(' '.join((n, p, b)).lower())})" for i, (_, n, p, b) in enumerate(DRINK_MENU))


@register("search_catalog_match", f"""
WITH cat AS (SELECT * FROM (VALUES {_catalog_sql_values()}) AS t(item_pos, hay)),
m AS (SELECT conv_id, turn, {TOKENS_SQL} AS toks FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, CAST(item_pos AS BIGINT) AS item_pos,
             CAST(len(list_filter(toks, lambda t: contains(hay, t))) AS BIGINT) AS score FROM m CROSS JOIN cat),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_pos) AS BIGINT) AS rank
      FROM s)
SELECT conv_id, turn, rank, item_pos, score FROM r WHERE rank <= 3""")
def search_catalog_match(spark, sf):
    """Three best catalog items per user turn by keyword overlap with
    name, profile and best-for text."""
    msgs = table(spark, sf, "conversations").where(F.col("role") == "user")
    return S.catalog_match(msgs, [(n, p, b) for _, n, p, b in DRINK_MENU], 3, id_cols=("conv_id", "turn"))


COST_CMP_SQL = "WITH " + COST_SQL + """,
c AS (SELECT *, CAST(Tot_Dschrgs AS BIGINT) AS d,
             CAST(round(CAST(Avg_Submtd_Cvrd_Chrg AS DECIMAL(18,2)) * 100) AS BIGINT) AS b_c,
             CAST(round(CAST(Avg_Tot_Pymt_Amt AS DECIMAL(18,2)) * 100) AS BIGINT) AS t_c,
             CAST(round(CAST(Avg_Mdcr_Pymt_Amt AS DECIMAL(18,2)) * 100) AS BIGINT) AS m_c FROM cost),
g AS (SELECT {keys}, CAST(sum(d) AS BIGINT) AS discharges, count(*) AS providers,
             sum(b_c * d) AS wb, sum(t_c * d) AS wt, sum(m_c * d) AS wm,
             min({{'p': t_c, 'n': Rndrng_Prvdr_Org_Name}}) AS lo, max({{'p': t_c, 'n': Rndrng_Prvdr_Org_Name}}) AS hi
      FROM c WHERE d > 0 GROUP BY {keys})
SELECT {keys}, discharges, providers,
       floor((2 * wb + discharges) / (2 * discharges)) / 100.0 AS w_Avg_Submtd_Cvrd_Chrg,
       floor((2 * wt + discharges) / (2 * discharges)) / 100.0 AS w_Avg_Tot_Pymt_Amt,
       floor((2 * wm + discharges) / (2 * discharges)) / 100.0 AS w_Avg_Mdcr_Pymt_Amt,
       lo.n AS cheapest, lo.p / 100.0 AS cheapest_payment, hi.n AS dearest, hi.p / 100.0 AS dearest_payment
FROM g"""


@register("search_cost_comparison", COST_CMP_SQL.format(keys="DRG_Cd, DRG_Desc"))
def search_cost_comparison(spark, sf):
    """Per DRG, discharge-weighted averages and the cheapest / dearest
    provider (the comparison the reference asks a model to make)."""
    return S.cost_comparison(cost_table(spark, sf))


@register("search_cost_comparison_state",
          COST_CMP_SQL.format(keys="DRG_Cd, DRG_Desc, Rndrng_Prvdr_State_Abrvtn"))
def search_cost_comparison_state(spark, sf):
    """A9 per DRG x state."""
    return S.cost_comparison(cost_table(spark, sf), by=("DRG_Cd", "DRG_Desc", "Rndrng_Prvdr_State_Abrvtn"))


# ------------------------------------------------- S9 playlist save / load

SAVED_AT = "2024-01-01T00:00:00"
NOW = "2024-02-01T00:00:00"


def _playlists_page(spark, sf, ranked, lo, hi, name_prefix, with_id):
    page = ranked.where(F.col("rank").between(lo, hi))
    tracks = page.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("tracks"))
    return tracks.select(
        (F.col("query_id") if with_id else F.lit(None).cast("string")).alias("id"),
        F.concat(F.lit(name_prefix), F.col("query_id")).alias("name"),
        F.col("query_id").alias("query"), "tracks",
        F.lit(SAVED_AT if with_id else None).cast("string").alias("created_at"),
        F.lit(SAVED_AT if with_id else None).cast("string").alias("updated_at"))


@register("library_save_playlists", VEC_SQL.format(where="") + f""",
pages AS (
  SELECT query_id AS id, query_id AS name, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS track_ids,
         '{SAVED_AT}' AS created_at, '{SAVED_AT}' AS updated_at, 0 AS src
  FROM r WHERE rank <= 10 GROUP BY query_id
  UNION ALL
  SELECT query_id, 'page 2 of ' || query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank),
         '{SAVED_AT}', '{NOW}', 1
  FROM r WHERE rank BETWEEN 11 AND 20 GROUP BY query_id
  UNION ALL
  SELECT substring(sha256('{{"name":"more ' || query_id || '","query":"' || query_id
    || '","now":"{NOW}","nth":1,"save":"first"}}'), 1, 8), 'more ' || query_id,
         string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank), '{NOW}', '{NOW}', 2
  FROM r WHERE rank BETWEEN 21 AND 30 GROUP BY query_id),
latest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC) AS rn FROM pages)
SELECT id, name, created_at, updated_at, track_ids FROM latest WHERE rn = 1""")
def library_save_playlists(spark, sf):
    """Saved playlists (first page of every label) updated with the
    second page under the same ids, plus new unsaved playlists (third page)
    that get a derived id and created_at; listed newest first (T3).  Empty
    track lists are rejected by the operator (covered by the fixtures)."""
    from tabulon.operators import library as L
    q = label_queries(spark, sf)
    ranked = S.vector_topk(table(spark, sf, "embeddings"), q, 30)
    existing = _playlists_page(spark, sf, ranked, 1, 10, "", True)
    existing = existing.withColumn("name", F.col("query"))
    updates = _playlists_page(spark, sf, ranked, 11, 20, "page 2 of ", True)
    fresh = _playlists_page(spark, sf, ranked, 21, 30, "more ", False)
    saved = L.save_playlists(existing, updates.unionByName(fresh), NOW, save="first")
    return L.newest_first(saved).select(
        "id", "name", "created_at", "updated_at",
        F.array_join(F.transform("tracks", lambda x: x.cast("string")), ",").alias("track_ids"))


@register("search_regenerate_twice", VEC_SQL.format(where="") + """
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank - 20 AS BIGINT) AS rank
FROM r WHERE rank BETWEEN 21 AND 30""")
def search_regenerate_twice(spark, sf):
    """U3 + T7: two regenerations; the seen set is the union of both shown
    pages (per session = query), and the third list excludes all of it."""
    from tabulon.operators import library as L
    e = table(spark, sf, "embeddings")
    q = label_queries(spark, sf)
    first = S.vector_topk(e, q, K).select(F.col("query_id").alias("session"), F.col("vec_id").alias("id"))
    second = S.vector_topk(e, q, K, exclude=first.select(F.col("session").alias("query_id"),
                                                            F.col("id").alias("vec_id")))
    seen = L.seen_union(first, second.select(F.col("query_id").alias("session"), F.col("vec_id").alias("id")))
    third = S.vector_topk(e, q, K, exclude=seen.select(F.col("session").alias("query_id"),
                                                        F.col("id").alias("vec_id")))
    return _vec_out(third)
