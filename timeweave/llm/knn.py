"""Exact top-k search by a Voronoi kNN join.

Queries and data are grouped by their nearest pivot. Summaries of the groups
(rows, radius, longest and shortest norm) bound the scores between a query group
and a data group; the blocks of a query group go only to the blocks of those data
groups that may still reach its k-th best score, and are searched there. Groups
of any size are dealt out in blocks, so none is in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import materialize

#: Pivots, of which there are more where there are more rows, and rows of the bounded sample for each.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 48, 512, 40
DATA_BLOCK, QUERY_BLOCK = 4096, 1024


def quantise(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; rows with null or non-finite parts, or no parts, take no part."""
    finite = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
    return rows.where(F.col("id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)).where(finite).select("id", F.transform("_v", lambda x: F.floor(x * scale)).alias("v"))


def choose_pivots(rows: DataFrame) -> np.ndarray:
    """Pivots, far from each other, of a bounded sample: the first rows by hash."""
    pivots = max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(rows.count()) // 8))
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE * pivots).collect()
    if not sample:
        return np.zeros((0, 0))
    points = np.array([r["v"] for r in sample], dtype=np.float64)
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(pivots, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return points[chosen]


def check_widths(rows: DataFrame) -> None:
    """All vectors of a search have the same number of components."""
    found = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if found["least"] != found["most"]:
        raise ValueError(f"vectors of {found['least']} to {found['most']} components")


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def assign_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, cell, distance to the pivot, squared norm, packed vector)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                whole = np.array(batch["v"].tolist(), dtype=np.int64)
                x = whole.astype(np.float64)
                square = _norms(x)[:, None] - 2 * x @ pivots.T + _norms(pivots)[None]
                cell = square.argmin(axis=1)
                yield pd.DataFrame({"id": batch["id"], "cell": cell.astype(np.int32), "far": np.sqrt(np.maximum(0, square[np.arange(len(x)), cell])), "norm": _norms(x), "data": [r.tobytes() for r in whole.astype("<i8")]})

    return rows.mapInPandas(run, "id long, cell int, far double, norm double, data binary")


def needed(queries: list, cells: list, pivots: np.ndarray, k: int) -> dict[int, list[int]]:
    """Data cells that the queries of each cell need.

    For q in group g and x in cell c, |d(p_g, p_c) - what both radii allow| bounds
    d(q, x), and 2 q.x = |q|^2 + |x|^2 - d^2. The k-th highest lower bound over
    the cells' rows is the score that a cell's upper bound has to reach; a query
    may itself be a row of the data, so one row more is asked for.
    """
    out = {}
    between = np.sqrt(np.maximum(0, _norms(pivots)[:, None] + _norms(pivots)[None] - 2 * pivots @ pivots.T))
    for g in queries:
        bounds = []
        for c in cells:
            d, reach = between[g["cell"], c["cell"]], g["radius"] + c["radius"]
            least = (g["least"] + c["least"] - (d + reach) ** 2) / 2
            most = (g["most"] + c["most"] - max(0.0, d - reach) ** 2) / 2
            bounds.append((least, most, c["n"], c["cell"]))
        bounds.sort(reverse=True)
        floor, rows = -np.inf, 0
        for least, _, n, _ in bounds:
            rows += n
            if rows >= k + 1:
                floor = least
                break
        slack = 1e-6 * (1 + abs(floor)) + 1e-9 * (g["most"] + max(c["most"] for c in cells))
        out[g["cell"]] = [cell for _, most, _, cell in bounds if most >= floor - slack]
    return out


def blocks(rows: DataFrame, size: int, counts: dict[int, int]) -> DataFrame:
    """One row of packed ids and vectors for each block of about ``size`` rows of a cell; a large cell has many blocks."""
    table = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // size))])
    spread = rows.withColumn("block", F.pmod(F.xxhash64("id"), table[F.col("cell")]).cast("int"))
    packed = F.sort_array(F.collect_list(F.struct("id", "data")))
    return spread.groupBy("cell", "block").agg(packed.alias("_rows")).select("cell", "block", F.col("_rows.id").alias("ids"), F.col("_rows.data").alias("data"))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where that is exact, else in 64 bits, else in whole numbers of any size."""
    largest = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    bound = largest(a) * largest(b) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    if max(abs(x) for x in whole.ravel()) >= 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return whole.astype(np.int64)


def top_k(queries: DataFrame, data: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products of integer vectors.

    Both sides come from ``quantise``. A query's own id is no candidate, ties go
    to the smaller vec_id, and a query has fewer rows where there are fewer
    candidates. Empty sides give no rows. Scores are exact; one that a long can't
    hold is an error, as are vectors of different widths. Rows that repeat an id
    are candidates each, and as queries they are one if they are equal; different
    vectors of one query id are searched as one query with the higher scores.
    """
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    check_widths(data.unionByName(queries))
    pivots = choose_pivots(data)
    if not len(pivots):
        return spark.createDataFrame([], schema)
    cells = materialize(assign_cells(data, pivots), "cells")
    asked = materialize(assign_cells(queries.distinct(), pivots), "queries")
    summary = [F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.min("norm").alias("least"), F.max("norm").alias("most")]
    data_cells, query_cells = (x.groupBy("cell").agg(*summary).collect() for x in (cells, asked))
    if not query_cells:
        return spark.createDataFrame([], schema)
    sizes = {r["cell"]: r["n"] for r in data_cells}
    # Which cells meet: MOST_PIVOTS squared at most.
    meet = spark.createDataFrame([(g, c, -(-sizes[c] // DATA_BLOCK)) for g, wanted in needed(query_cells, data_cells, pivots, k).items() for c in wanted], "qcell int, cell int, blocks int")
    data_blocks = blocks(cells, DATA_BLOCK, sizes)
    query_blocks = blocks(asked, QUERY_BLOCK, {r["cell"]: r["n"] for r in query_cells})
    q = query_blocks.select(F.col("cell").alias("qcell"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    q = q.join(F.broadcast(meet), "qcell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = q.join(data_blocks, ["cell", "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qids, qdata, ids, rows in zip(batch["qids"], batch["qdata"], batch["ids"], batch["data"]):
                qids, ids = np.asarray(qids, dtype=np.int64), np.asarray(ids, dtype=np.int64)
                a = np.frombuffer(b"".join(qdata), dtype="<i8").reshape(len(qids), -1)
                b = np.frombuffer(b"".join(rows), dtype="<i8").reshape(len(ids), -1)
                # A query's own row comes last: scores are above the least long.
                score = np.where(qids[:, None] != ids[None], inner_products(a, b), np.iinfo(np.int64).min)
                least = max(0, len(ids) - k)
                row, at = np.nonzero((score >= np.partition(score, least, axis=1)[:, least, None]) & (score > np.iinfo(np.int64).min))
                # ids ascend in a block, so equal scores go by id.
                value = score[row, at]
                order = np.lexsort((at, ~value, row))
                row, at, value = row[order], at[order], value[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pd.DataFrame({"query_id": qids[row[first]], "vec_id": ids[at[first]], "score": value[first]})

    found = met.mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 5
"""
