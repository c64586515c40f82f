"""Nearest vectors over stored cells (T4, T6, T7): exact search that leaves
out what the triangle inequality excludes.

:func:`build_cells` stores every vector under its nearest pivot (a bounded
sample of the vectors) with its distance to it, as Parquet partitioned by
cell, and one row of statistics per cell.  A search knows a query's distance
to each pivot, hence between which bounds a cell's vectors lie from it: the
cells whose nearest possible vector is beyond the distance that certainly
holds k vectors are never read (partition pruning), and within a cell a
vector whose bound is beyond the k-th distance found so far is not compared.
A task keeps one heap of k vectors per query and gives it once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.search import MAX_QUERY_BLOCK

# Pivots that a search holds in every task, at most (64-d doubles: 2 MiB).
MAX_PIVOTS = 4096
# Rounding of computed distances, relative and absolute: bounds are widened by it.
SLACK = 1e-6
# Files a cell is written in, so that a cell holding a third of all vectors is not one task's output.
CELL_FILES = 8


@dataclass(frozen=True)
class CellIndex:
    """Where the cells are, and their columns."""
    path: str
    id_col: str
    vec_col: str
    schema: T.StructType

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


def build_cells(vectors: DataFrame, path: str, n_cells: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> CellIndex:
    """Stores ``vectors`` (further columns stay, for filters) in ``n_cells`` cells under ``path``.
    The pivots are the vectors whose ids have the smallest hashes; rows without a vector are left out."""
    if not 1 <= n_cells <= MAX_PIVOTS:
        raise ValueError(f"n_cells must be from 1 to {MAX_PIVOTS}")
    spark = vectors.sparkSession
    full = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
    sample = full.select(vec_col, id_col).orderBy(F.xxhash64(id_col), id_col).limit(n_cells).collect()
    pivots = np.array([r[0] for r in sample], dtype=np.float64)
    shipped = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _squared(np.stack(pdf[vec_col].to_numpy()).astype(np.float64), shipped.value)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), r=np.sqrt(d[np.arange(len(pdf)), cell]))

    schema = T.StructType(list(full.schema.fields) + [T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
    placed = full.mapInPandas(assign, schema).repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(CELL_FILES)))
    placed.write.partitionBy("cell").parquet(f"{path}/vectors")
    stats = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(
        F.count("*").alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))
    rows = [(i, p.tolist()) for i, p in enumerate(pivots)]
    stats.join(spark.createDataFrame(rows, "cell int, pivot array<double>"), "cell").write.parquet(f"{path}/cells")
    return CellIndex(path, id_col, vec_col, schema)


def needed_cells(to_pivot: np.ndarray, n: np.ndarray, r_min: np.ndarray, r_max: np.ndarray, k: int) -> np.ndarray:
    """Which cells (columns) a query (row) has to look at for its ``k`` nearest vectors."""
    most = to_pivot + r_max
    order = np.argsort(most, axis=1)
    held = np.cumsum(n[order], axis=1)
    # The distance within which the nearest cells hold k vectors for certain.
    reach = np.minimum((held < k).sum(axis=1), most.shape[1] - 1)
    limit = np.take_along_axis(most, order, axis=1)[np.arange(len(most)), reach]
    limit = np.where(held[:, -1] < k, np.inf, limit)
    least = np.maximum(np.maximum(to_pivot - r_max, r_min - to_pivot), 0.0)
    return least <= (limit * (1 + SLACK) + SLACK)[:, None]


def _scan(shipped, k: int, id_col: str, vec_col: str):
    def run(batches):
        ids_q, mat, to_pivot, need, number = shipped.value
        top: list = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in ids_q]
        for pdf in batches:
            for cell, part in pdf.groupby("cell", sort=False):
                c = number[cell]
                x, r, ids = np.stack(part[vec_col].to_numpy()).astype(np.float64), part["r"].to_numpy(), part[id_col].to_numpy()
                for q in np.flatnonzero(need[:, c]):
                    kept_ids, kept = top[q]
                    near = np.arange(len(ids))
                    if len(kept) == k:
                        near = np.flatnonzero(np.abs(to_pivot[q, c] - r) <= np.sqrt(kept[-1]) * (1 + SLACK) + SLACK)
                        if not len(near):
                            continue
                    # Row by row, so equal vectors have equal distances and their ids decide.
                    d = ((x[near] - mat[q]) ** 2).sum(axis=1)
                    d, i = np.concatenate([kept, d]), np.concatenate([kept_ids, ids[near]]) if len(kept) else ids[near]
                    order = np.lexsort((i, d))[:k]
                    top[q] = i[order], d[order]
        some = [(q, i, d) for q, (i, d) in zip(ids_q, top) if len(d)]
        if some:
            yield pd.DataFrame({"query_id": np.concatenate([np.full(len(i), q, dtype=object) for q, i, _ in some]),
                                id_col: np.concatenate([i for _, i, _ in some]), "distance": np.concatenate([d for _, _, d in some])})
    return run


def cell_topk(index: CellIndex, queries: DataFrame, k: int = 10, *, rank_from: int = 1, where: Column | None = None) -> DataFrame:
    """query_id, <id>, distance (squared L2), rank: ranks ``rank_from`` to ``rank_from + k - 1`` of the vectors
    nearest to every row of ``queries`` (query_id, query_vec), ties by id.

    Queries are taken ``MAX_QUERY_BLOCK`` at a time, each block one scan of the cells it needs.  A filter
    (``where``) leaves fewer vectors in a cell than its statistics say, so with one every cell may be needed."""
    if k < 1 or rank_from < 1:
        raise ValueError("k and rank_from must be positive")
    spark, last = queries.sparkSession, rank_from + k - 1
    cells = sorted(index.cells(spark).collect(), key=lambda r: r["cell"])
    id_type = index.vectors(spark).schema[index.id_col].dataType
    schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField(index.id_col, id_type),
                           T.StructField("distance", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    block: list = []

    def scan(rows: list) -> DataFrame:
        mat = np.array([r["query_vec"] for r in rows], dtype=np.float64)
        to_pivot = np.sqrt(_squared(mat, np.array([c["pivot"] for c in cells], dtype=np.float64)))
        n, r_min, r_max = (np.array([c[f] for c in cells], dtype=np.float64) for f in ("n", "r_min", "r_max"))
        need = needed_cells(to_pivot, n, r_min, r_max, last) if where is None else np.ones(to_pivot.shape, dtype=bool)
        number = {c["cell"]: i for i, c in enumerate(cells)}
        wanted = [c["cell"] for i, c in enumerate(cells) if need[:, i].any()]
        shipped = spark.sparkContext.broadcast(([r["query_id"] for r in rows], mat, to_pivot, need, number))
        rows_in = index.vectors(spark).where(F.col("cell").isin(wanted))
        rows_in = rows_in if where is None else rows_in.where(where)
        return rows_in.select("cell", "r", index.id_col, index.vec_col).mapInPandas(
            _scan(shipped, last, index.id_col, index.vec_col), schema)

    if cells:
        for row in queries.select(F.col("query_id").cast("string").alias("query_id"), "query_vec").toLocalIterator():
            block.append(row)
            if len(block) == MAX_QUERY_BLOCK:
                out, block = out.unionByName(scan(block)), []
        if block:
            out = out.unionByName(scan(block))
    order = Window.partitionBy("query_id").orderBy("distance", index.id_col)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= last) \
        .where(F.col("rank") >= rank_from).withColumn("rank", F.col("rank").cast("bigint"))
