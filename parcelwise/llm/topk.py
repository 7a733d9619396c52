"""Exact k best inner products by vector-approximation files.

1. The approximation file: every component becomes the number of its cell, one byte, in a grid that spans all vectors.
   The file holds those bytes and a row number; the exact vectors lie in columns of their own beside it.
2. A scan of the cells alone gives each pair of a query and a candidate the score of the cell's middle. Since all cells
   of a dimension are equally wide, the true score is off by no more than a margin that the query alone decides. Blocks
   of cells meet blocks of queries; of each block only candidates stay that can still be among the k best.
3. Exact vectors are read by falling bound: first those of the k best bounds of each query, whose k-th exact score then
   rules out all candidates of a lower bound, and then the ones left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells and queries that meet in one task, at most, and candidates below which more tasks aren't worth it.
CANDIDATES, QUERIES, LEAST = 65_536, 4096, 4096
#: Pairs whose bounds a task holds at a time.
PAIRS = 4_000_000


def middles(cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Twice the middle of each cell, a whole number."""
    return 2 * (low + cells.astype(np.int64) * width) + width - 1


def margin(queries: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Twice how far any score can lie from that of the cell's middle."""
    return np.abs(queries) @ (width - 1)


def possible(ids: np.ndarray, middle: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, bound) of the pairs whose greatest possible score reaches the k-th best least possible one.

    Scores are doubled. A query's own id is no candidate.
    """
    # products up to 2 ** 53 are exact in doubles, up to 2 ** 24 in floats
    reach = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(middle).max(initial=0))
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    middle, exact = middle.astype(kind).T, queries.astype(kind)
    order = np.argsort(ids, kind="stable")
    first, last = np.searchsorted(ids[order], query_ids, "left"), np.searchsorted(ids[order], query_ids, "right")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, PAIRS // max(1, len(ids)))
    for at in range(0, len(queries), step):
        score = (exact[at : at + step] @ middle).astype(np.float64 if kind != np.int64 else np.int64)
        least = score.min() - 1 if score.size else 0
        own = np.zeros(score.shape, bool)
        for q, (a, b) in enumerate(zip(first[at : at + step].tolist(), last[at : at + step].tolist(), strict=True)):
            own[q, order[a:b]] = True
        score[own] = least
        floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(score), least)
        q, c = np.nonzero((score >= (floor - 2 * off[at : at + step])[:, None]) & ~own)
        out.append((q + at, c, score[q, c].astype(np.int64) + off[q + at]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


def exact_top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "vector", k: int = 5, bits: int = 8) -> DataFrame:
    """(query_id, rank, ``key``, score): for each query row the k greatest inner products with other rows, ties to the smaller key.

    ``vector``: ARRAY<BIGINT>; rows with a null or empty one, or with null components, take no part, nor do null keys.
    Every row is a candidate, repeated ones each; queries of equal key and vector count once; rows of one key are never
    each other's candidates; vectors of other lengths than the query's aren't compared. ``bits``: 2 ** bits cells a
    dimension, 8 at most. Further columns are ignored; an empty table gives an empty one.
    """
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    rows = vectors.where(whole & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<bigint>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()})
    id_type = rows.schema["id"].dataType.simpleString()
    ends = {r.dim: r for r in rows.groupBy("dim").agg(F.expr("(min(array_min(vector)), max(array_max(vector)))").alias("ends"), F.count("*").alias("n"), F.count_if("query").alias("n_queries")).collect()}  # one row for each length of vectors
    low = {d: r.ends[0] for d, r in ends.items()}
    width = {d: (r.ends[1] - r.ends[0]) // (1 << bits) + 1 for d, r in ends.items()}

    def approximated(batches):
        for b in batches:
            n = b["vector"].value_lengths().to_numpy()
            dims, which = np.unique(n, return_inverse=True)
            lows, widths = (np.array([of[d] for d in dims.tolist()], np.int64)[which] for of in (low, width))
            cells = ((b["vector"].flatten().to_numpy() - np.repeat(lows, n)) // np.repeat(widths, n)).astype(np.uint8)
            ends = pa.py_buffer(np.r_[0, np.cumsum(n)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(cells)])], names=[*b.schema.names, "cells"])

    file = written(rows.mapInArrow(approximated, rows.withColumn("cells", F.lit(b"")).schema), "vectors")
    queries = written(file.where("query").groupBy("id", "vector", "dim").agg(F.min("row").alias("query")), "queries")
    most = max((r.n for r in ends.values()), default=0)
    c_blocks = max(1, -(-most // CANDIDATES), min(64, most // LEAST))
    q_blocks = max(1, -(-max((r.n_queries for r in ends.values()), default=0) // QUERIES))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    scanned = file.select("id", "row", "cells", "dim", F.pmod(F.xxhash64("row"), F.lit(c_blocks)).alias("c"), every(q_blocks).alias("q"))
    asked = queries.select("id", "query", "vector", "dim", F.pmod(F.xxhash64("query"), F.lit(q_blocks)).alias("q"), every(c_blocks).alias("c"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "bound": pa.array([], pa.int64())})
        dim = left["dim"][0].as_py()
        cells = np.frombuffer(b"".join(left["cells"].to_pylist()), np.uint8).reshape(-1, dim)
        exact = right["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        codes = pa.chunked_array([*left["id"].chunks, *right["id"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        ids, query_ids = codes[: left.num_rows], codes[left.num_rows :]
        wide = np.full(dim, width[dim], np.int64)
        q, c, bound = possible(ids, middles(cells, low[dim], wide), query_ids, exact, margin(exact, wide), k)
        return pa.table({"query": right["query"].take(pa.array(q)), "row": left["row"].take(pa.array(c)), "bound": pa.array(bound)})

    bounds = scanned.groupBy("dim", "c", "q").cogroup(asked.groupBy("dim", "c", "q")).applyInArrow(lambda left, right: scan(left, right), "query long, row long, bound long")
    bounds = written(bounds, "bounds")

    def read(pairs: DataFrame) -> DataFrame:
        """The pairs with their exact scores."""
        held = pairs.join(file.select("row", "id", F.col("vector").alias("candidate")), "row").join(queries.select("query", F.col("id").alias("query_id"), "vector"), "query")
        product = F.aggregate(F.zip_with("candidate", "vector", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return held.select("query", "query_id", "row", "id", product.alias("score"))

    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "row")
    first = written(read(bounds.withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= k).select("query", "row")), "first")
    # a query of fewer candidates than k has read them all
    floor = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    rest = bounds.join(floor, "query").where(F.col("bound") >= 2 * F.col("kth")).join(first.select("query", "row"), ["query", "row"], "left_anti").select("query", "row")
    scores = first.unionByName(read(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").cast(id_type).alias("query_id"), "rank", F.col("id").alias(key), "score")


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as DOUBLE; null if the vector is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


EXACT_TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
