"""Exact top-k inner products by vector-approximation files.

Vectors become integers (the floor of a multiple).  Rows and queries are cut
into blocks; every pair of a row block and a query block is one group.  In a
group the approximation file of the block (one byte for each dimension: the
cell of a uniform grid as wide as the vector needs) is scanned for all
queries, which bounds every score
from both sides; exact vectors are then read, best upper bound first, until
no bound left can reach the k-th exact score.  Each group returns at most k
rows for each query and a final ranking keeps the best k.

Blocks hold a bounded number of vectors, so memory does not grow with the
table; the vectors move once for each block of queries, the queries once for
each block of vectors.

Defined results: a vector that is null, empty, or holds a null or non-finite
component takes no part; a cell of 2^63 and more or a result beyond a BIGINT
is an error, as in SQL; products in between are exact whatever their size;
vectors of different length do not meet; a repeated row (same id and vector) counts once; a null id is a
candidate (last among ties) and never a query; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import durable

SCALE = 1024
ROW_BLOCK = 16_384
QUERY_BLOCK = 2_048
# Exact vectors read at a time.
READ = 64

# A score is high * 2^62 + low, so that candidates beyond a BIGINT are still ordered.
LOW_BITS = 62
_RESULT = "query_id long, vec_id long, high long, low long"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v (array of integers) of the rows that take part, each once."""
    def cell(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < 2.0 ** 63, F.floor(scaled)).otherwise(F.raise_error(F.lit("a cell does not fit into BIGINT")).cast("long"))

    usable = F.coalesce(F.size(vector_col) > 0, F.lit(False)) & F.forall(
        F.col(vector_col), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf), F.lit(False)))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, cell).alias("v")).distinct()


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles while every partial sum fits into 53 bits, through Python's integers
    where one may not fit into 63."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0 ** 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def search_block(ids: np.ndarray, known: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
                 ) -> list[tuple[int, int | None, int]]:
    """(query id, id, score) of the best k rows of a block for every query; ``known``: whether the id is not null."""
    top = np.abs(rows).max(1, initial=0)
    width = np.maximum(1, top // 128 + 1)  # 256 cells hold every value of the row
    approx = (rows // width[:, None]).clip(-128, 127).astype(np.int8)
    half = (width.astype(np.float64) - 1) / 2
    middle = approx.astype(np.float64) * width.astype(np.float64)[:, None] + half[:, None]
    guess = queries.astype(np.float64) @ middle.T
    mass = np.abs(queries.astype(np.float64)).sum(1)
    reach = half + (top.astype(np.float64) + half) * ((rows.shape[1] + 8) * 2.0 ** -51)  # and for rounding
    out: list[tuple[int, int | None, int]] = []
    for q in range(len(queries)):
        open_ = ~(known & (ids == query_ids[q]))
        n = int(open_.sum())
        if not n:
            continue
        slack = mass[q] * reach + 1.0
        kk = min(k, n)
        # The k-th best lower bound: nothing whose upper bound is below it can be among the best.
        lower = np.where(open_, guess[q] - slack, -np.inf)
        upper = guess[q] + slack
        floor = np.partition(lower, len(lower) - kk)[len(lower) - kk]
        left = np.flatnonzero(open_ & (upper >= floor))
        left = left[np.argsort(-upper[left], kind="stable")]
        best_at: np.ndarray = np.zeros(0, np.int64)
        best: np.ndarray = np.zeros(0, np.int64)
        for at in range(0, len(left), READ):
            if len(best) >= kk and upper[left[at]] < _kth(best, kk):
                break  # no bound left reaches the k-th exact score
            take = left[at:at + READ]
            best_at = np.concatenate([best_at, take])
            best = np.concatenate([best, _dots(rows[take], queries[q:q + 1])[:, 0]])
        if best.dtype == object:
            order = np.array(sorted(range(len(best)), key=lambda i: (-best[i], not known[best_at[i]], ids[best_at[i]]))[:kk])
        else:
            order = np.lexsort((ids[best_at], ~known[best_at], -best))[:kk]
        out += [(int(query_ids[q]), int(ids[i]) if known[i] else None, int(s)) for i, s in zip(best_at[order], best[order])]
    return out


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score."""
    return sorted(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "high": [], "low": []}).astype("int64")
        known = left["id"].notna().to_numpy()
        ids = left["id"].fillna(0).astype("int64").to_numpy()
        found = search_block(ids, known, np.stack(left["v"].to_numpy()).astype(np.int64),
                             right["id"].astype("int64").to_numpy(), np.stack(right["v"].to_numpy()).astype(np.int64), k)
        return pd.DataFrame({"query_id": pd.array([f[0] for f in found], "Int64"),
                             "vec_id": pd.array([f[1] for f in found], "Int64"),
                             "high": pd.array([f[2] >> LOW_BITS for f in found], "Int64"),
                             "low": pd.array([f[2] & ((1 << LOW_BITS) - 1) for f in found], "Int64")})
    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``vectors``: id, v.  The best ``k`` other rows of every row that ``is_query`` marks:
    query_id, rank, vec_id, score; ties go to the smaller id."""
    sized = durable(vectors.withColumn("dim", F.size("v")))
    marked = F.coalesce(is_query, F.lit(False)) & F.col("id").isNotNull()
    n, n_queries = sized.agg(F.count("*"), F.count_if(marked)).first()
    row_blocks, query_blocks = -(-n // ROW_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    at = F.xxhash64("id", "v")
    rows = sized.withColumn("rb", F.pmod(at, F.lit(row_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    queries = sized.where(marked).withColumn("qb", F.pmod(at, F.lit(query_blocks))).withColumn(
        "rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    keys = ["dim", "rb", "qb"]
    found = rows.select(*keys, "id", "v").groupBy(*keys).cogroup(queries.select(*keys, "id", "v").groupBy(*keys)) \
        .applyInPandas(_search(k), _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), F.col("vec_id").asc_nulls_last())
    low = F.lit(1 << LOW_BITS).cast("long")
    fits = F.col("high").between(-2, 1)
    score = F.when(fits, F.col("high") * low + F.col("low")).otherwise(
        F.raise_error(F.lit("an inner product does not fit into BIGINT")).cast("long"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", score.alias("score"))
