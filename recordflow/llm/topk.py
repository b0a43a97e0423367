"""Exact top-k search: a vector-approximation file bounds every score, exact vectors settle what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordflow.llm.common import ship
from recordflow.runtime import cut_lineage, distributed_rank

ship(__name__)

CELLS = 256          # of each dimension; a cell takes one byte
QUERY_BLOCK = 8_192  # queries that are broadcast at a time
SCALE = 256          # a component x becomes floor(SCALE * x)
_ROWS = 1_024        # approximations compared with a block of queries at once


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, v): vectors of whole numbers floor(256 * x), each row under a number of its own.

    Rows with a null id, and vectors that are null, empty or hold null or non-finite components, take no
    part. Rows may share an id. The numbers hold once the rows are stored.
    """
    x = F.col(embedding).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & (F.size(embedding) > 0) & sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def _edges(base: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the bounds of the cells: ``CELLS`` + 1 whole numbers a dimension."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len))["v"]:
                x = np.stack(rows.to_numpy())
                low[size] = np.minimum(low.get(size, x[0]), x.min(0))
                high[size] = np.maximum(high.get(size, x[0]), x.max(0))
        for size in low:
            yield pd.DataFrame({"size": size, "at": np.arange(size), "low": low[size], "high": high[size]})

    found = base.select("v").mapInPandas(ranges, "size int, at int, low long, high long").groupBy("size", "at").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["size", "at"])
    edges = {}
    for size, rows in found.groupby("size"):
        low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
        step = np.arange(CELLS + 1)[None, :] * (high - low + 1)[:, None].astype(object)
        edges[int(size)] = (low[:, None] + -(-step // CELLS)).astype(np.int64)
    return edges


def approximations(base: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """The vector-approximation file (vec_id, cells): a byte for each component, in the shared folder."""

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = []
            for v in batch["v"]:
                e = edges[len(v)]
                span = e[:, -1] - e[:, 0]
                at = np.clip((v - e[:, 0]) * float(CELLS) // np.maximum(span, 1), 0, CELLS - 1).astype(np.int64)
                row = np.arange(len(v))
                at -= v < e[row, at]
                at += v >= e[row, at + 1]
                cells.append(at.astype(np.uint8).tobytes())
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cells": cells})

    return cut_lineage(base.mapInPandas(quantise, "vec_id long, cells binary"), "va-file")


def _bounds(cells: list[bytes], edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, a row for each query."""
    at = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
    row = np.arange(at.shape[1])[None, :]
    low = edges[row, at].astype(float)
    high = np.maximum(low, edges[row, at.astype(int) + 1] - 1.0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    lower, upper = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)  # for sums beyond 2 ** 53
    return lower - slack, upper + slack


def _by_size(block: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return {int(size): (rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float), rows["least"].to_numpy())
            for size, rows in block.groupby(block["v"].map(len))}


def _scan(batches: Iterator[pd.DataFrame], edges, queries) -> Iterator[tuple]:
    for batch in batches:
        for size, rows in batch.groupby(batch["cells"].map(len)):
            if size in queries:
                for start in range(0, len(rows), _ROWS):
                    part = rows.iloc[start:start + _ROWS]
                    ids, values, least = queries[size]
                    yield part["vec_id"].to_numpy(), ids, least, size, *_bounds(part["cells"].tolist(), edges[size], values)


def _block_candidates(file: DataFrame, edges, block: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, upper) of every vector that may be among a query's ``k`` best."""
    first = _by_size(block.assign(least=-np.inf))

    def lower_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {size: np.full((len(q[0]), k), -np.inf) for size, q in first.items()}
        for ids, query_ids, _, size, lower, _ in _scan(batches, edges, first):
            lower[query_ids[:, None] == ids[None, :]] = -np.inf
            best[size] = -np.partition(-np.hstack([best[size], lower]), k - 1, axis=1)[:, :k]
        for size, found in best.items():
            row, column = np.nonzero(found > -np.inf)
            yield pd.DataFrame({"query_id": first[size][0][row], "lower": found[row, column]})

    order = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    bounds = file.mapInPandas(lower_bounds, "query_id long, lower double")
    kth = bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("query_id").agg(
        F.min("lower").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).toPandas()
    known = dict(zip(kth["query_id"], kth["least"]))
    second = _by_size(block.assign(least=[known.get(i, -np.inf) for i in block["vec_id"]]))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, query_ids, least, _, _, upper in _scan(batches, edges, second):
            row, column = np.nonzero((upper >= least[:, None]) & (query_ids[:, None] != ids[None, :]))
            yield pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[column], "upper": upper[row, column]})

    return file.mapInPandas(candidates, "query_id long, vec_id long, upper double")


def search(vectors: DataFrame, is_query=None, k: int = 5, id_col: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, exact.

    Queries are the rows that ``is_query`` holds for (by default ids divisible by 50), candidates are
    all rows of the same length but the query's own row, so other rows of its id too; ties go to the smaller
    id, and a query with fewer candidates has them all. One block of at most ``query_block`` queries is broadcast at a time; each
    task scans its part of the approximation file. The first scan finds the k-th best lower bound, the
    second keeps only vectors whose upper bound reaches it, and exact vectors are read for those alone.
    What takes no part is said at ``whole_vectors``. An empty table gives no rows.
    """
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    named = cut_lineage(whole_vectors(vectors, id_col, embedding), "vectors")
    # inside, a row's number stands for its id
    base = named.select(F.col("row").alias("vec_id"), "v")
    edges = _edges(base)
    file = approximations(base, edges)
    asked = cut_lineage(distributed_rank(named.where(is_query).select(F.col("row").alias("vec_id"), "v"), ["vec_id"], "n").withColumn(
        "block", F.floor((F.col("n") - 1) / query_block)), "queries")
    blocks = (asked.agg(F.max("block")).first()[0] if edges else None)
    found = None
    for number in range(0 if blocks is None else blocks + 1):
        block = asked.where(F.col("block") == number).select("vec_id", "v").toPandas()
        part = cut_lineage(_block_candidates(file, edges, block, k), "candidates")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return named.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    exact = (
        found.select(F.col("query_id").alias("asker"), F.col("vec_id").alias("row")).join(named, "row")
        .join(named.where(is_query).select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "asker")
        .select("asker", "query_id", "row", "vec_id", F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score")))
    order = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id", "row")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
