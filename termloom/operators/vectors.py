"""Vector search over an index with filters, and nearest rows for many queries at once.

The index is a coarse quantizer: k-means over all vectors, scaled to length one, and the rows
stored in one folder for each cell, so that a search reads the folders it probes. Filters are
applied before the scores, and scores are exact cosines of the vectors as they came.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_folder
from .search import cosine

#: Cells of an index: the root of its rows, within these bounds, so that centroids always fit a driver.
LEAST_CELLS, MOST_CELLS = 4, 4096
#: A search looks at so many rows for each that it returns, and at this many at least.
ROWS_PER_RESULT, LEAST_ROWS = 25, 200


@dataclass(frozen=True)
class VectorIndex:
    """rows: the table with its cell, a folder for each cell. centroids: a unit vector for each cell.
    sizes: rows of each cell. Both are at most MOST_CELLS long."""

    rows: DataFrame
    key: str
    vector: str
    centroids: np.ndarray
    sizes: np.ndarray


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def vector_index(rows: DataFrame, key: str, vector: str, cells: int | None = None, iterations: int = 8) -> VectorIndex:
    """rows without a vector are left out of the index."""
    spark = rows.sparkSession
    own = rows.where(F.col(vector).isNotNull())
    n = own.count()
    cells = cells or min(max(int(n**0.5), LEAST_CELLS), MOST_CELLS)
    unit = own.withColumn("_unit", array_to_vector(_unit(F.col(vector))))
    model = KMeans(k=max(2, cells), featuresCol="_unit", predictionCol="cell", seed=1, maxIter=iterations, initMode="random").fit(unit)
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    # a cell's rows meet in one partition, or in several where AQE finds it large
    model.transform(unit).drop("_unit").repartition("cell").write.partitionBy("cell").parquet(path)
    stored = spark.read.parquet(path)
    centroids = np.array(model.clusterCenters())
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    sizes = np.zeros(len(centroids), np.int64)
    for r in stored.groupBy("cell").count().collect():  # a row for each cell
        sizes[r.cell] = r["count"]
    return VectorIndex(stored, key, vector, centroids / np.where(norms > 0, norms, 1), sizes)


def probed(index: VectorIndex, query: list[float], least_rows: int) -> list[int]:
    """The cells nearest to a query that hold so many rows together."""
    order = np.argsort(-(index.centroids @ np.asarray(query, np.float64)), kind="stable")
    held = np.cumsum(index.sizes[order])
    return sorted(order[: int(np.searchsorted(held, least_rows)) + 1].tolist())


def index_top(index: VectorIndex, query: list[float], limit: int, allowed: Column | None = None, least_rows: int | None = None, exact: bool = False) -> DataFrame:
    """The index's rows with the greatest cosine, 6 decimals, then by key. allowed: a condition on the
    rows, asked before any score. exact: all cells; else those nearest to the query that hold
    least_rows rows (25 for each result, 200 at least). Too few rows allowed there: all cells."""
    least_rows = least_rows or max(ROWS_PER_RESULT * limit, LEAST_ROWS)
    rows = index.rows if allowed is None else index.rows.where(allowed)
    vector = F.array(*(F.lit(float(x)) for x in query))
    top = lambda df: df.withColumn("score", F.round(cosine(F.col(index.vector), vector), 6)).orderBy(F.col("score").desc(), index.key).limit(limit)
    cells = probed(index, query, least_rows)
    if exact or len(cells) == len(index.sizes):
        return top(rows)
    near = rows.where(F.col("cell").isin(*cells))
    return top(near) if allowed is None or near.limit(limit).count() == limit else top(rows)


# ---- many queries


#: Rows and queries that one matrix product takes at a time.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Bins of a join over all rows, for each core.
BINS_PER_CORE = 2


def _packed(batches, size: int):
    """(bin, ids, vectors) of at most size rows from sorted (bin, id, vector) batches: ids as strings joined by line feeds."""
    bin_, ids, rows = None, [], []

    def made():
        blob = np.asarray(rows, np.float64)
        return pa.RecordBatch.from_arrays([pa.array([bin_], pa.int32()), pa.array([ids], pa.list_(pa.string())), pa.array([blob.shape[1] if blob.ndim == 2 else 0], pa.int32()), pa.array([blob.tobytes()], pa.binary())], names=["bin", "ids", "width", "vectors"])

    for batch in batches:
        for b, i, v in zip(*(batch.column(c).to_pylist() for c in ("bin", "id", "vector")), strict=True):
            if ids and (b != bin_ or len(ids) == size):
                yield made()
                ids, rows = [], []
            bin_ = b
            ids.append(i)
            rows.append(v)
    if ids:
        yield made()


PACKED = "bin int, ids array<string>, width int, vectors binary"


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """df (bin, id, vector) as blocks of one bin each."""
    return df.repartition("bin").sortWithinPartitions("bin").mapInArrow(lambda batches: _packed(batches, size), PACKED)


def _products(k: int):
    """(query, id, score) of each query's first k rows of each pair of blocks."""

    def run(batches):
        for batch in batches:
            for ids, width, vectors, queries, asked in zip(*(batch.column(c).to_pylist() for c in ("ids", "width", "vectors", "q_ids", "q_vectors")), strict=True):
                rows, own = np.frombuffer(vectors).reshape(len(ids), width), np.frombuffer(asked).reshape(len(queries), width)
                lengths = np.sqrt((own**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = np.round(np.where(lengths > 0, own @ rows.T / lengths, 0.0), 6)
                rank = np.argsort(np.argsort(np.array(ids, dtype=object)))  # ties go by id
                least = np.partition(np.fmax(scores, -np.inf), -k, axis=1)[:, -k] if k < len(ids) else np.full(len(queries), -np.inf)
                for q, line, low in zip(queries, scores, least, strict=True):
                    able = np.flatnonzero(~(line < low))  # only these are sorted
                    first = able[np.lexsort((rank[able], -line[able]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(first), pa.string()), pa.array([ids[j] for j in first], pa.string()), pa.array(line[first])], names=["query", "id", "score"])

    return run


def nearest_join(index: VectorIndex, queries: DataFrame, k: int, least_rows: int | None = None, exact: bool = False) -> DataFrame:
    """query, id, score, rank: each query's k nearest rows by cosine, 6 decimals, then by id.

    queries: query (string), vector (of the index's length). Queries go to the cells they probe,
    cells and queries are packed into blocks, and each pair of blocks of a cell is one matrix
    product; nothing but each query's best rows of a block leaves it.
    """
    if exact:
        return exact_join(index.rows, index.key, index.vector, queries, k)
    least_rows = least_rows or max(ROWS_PER_RESULT * k, LEAST_ROWS)
    centroids, sizes = index.centroids, index.sizes

    def cells_of(batches):
        for batch in batches:
            asked = np.array(batch.column("vector").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            last = (held < least_rows).sum(axis=1) + 1
            chosen = [o[:n] for o, n in zip(order, last, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vector"), pa.array([c.tolist() for c in chosen], pa.list_(pa.int32()))], names=["query", "vector", "cells"])

    placed = queries.select(F.col("query").cast("string").alias("query"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(cells_of, "query string, vector array<double>, cells array<int>")
    asked = placed.select(F.explode("cells").alias("bin"), F.col("query").alias("id"), "vector")
    return _nearest(_row(index.rows, F.col("cell").cast("int"), index.key, index.vector), asked, k)


def exact_join(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """nearest_join() over all rows, which need no index: rows are dealt to bins, every query goes to
    all bins, and full blocks are multiplied. The products grow with rows times queries; what leaves
    them is k rows for each query and block."""
    n = rows.sparkSession.sparkContext.defaultParallelism * BINS_PER_CORE
    own = _row(rows.where(F.col(vector).isNotNull()), F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), key, vector)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")
    asked = queries.select(every, F.col("query").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return _nearest(own, asked, k)


def _row(rows: DataFrame, bin_: Column, key: str, vector: str) -> DataFrame:
    return rows.select(bin_.alias("bin"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def _nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank of rows and queries (bin, id, vector) that share a bin."""
    asked, rows = _blocks(asked, BLOCK_QUERIES), _blocks(rows, BLOCK_ROWS)
    pairs = rows.join(asked.select("bin", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "bin")
    best = pairs.select("ids", "width", "vectors", "q_ids", "q_vectors").mapInArrow(_products(k), "query string, id string, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
