"""Exact top-k inner products by columnar branch and bound.

Vectors are quantised to integers, floor(scale * x). Candidates are held in vertical layout, one row per
dimension, a block at a time. Scores are accumulated a block of dimensions after another; after each, a
candidate survives only if its partial score plus the product of the norms of the remaining dimensions
(no remaining part can add more) reaches the query's k-th best score so far, and survivors are compacted.
Every candidate meets every query: pruning never changes the result.

Queries are a stated set. They go to the candidates' tasks in waves of bounded size; each task returns k rows per
query, and the best of these are ranked and written before the next wave's queries are read, so neither the driver nor
an executor holds more than one wave however many there are.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do
null ids; rows with the query's id are its own; vectors of another length than the query's aren't compared
with it; repeated query rows (same id and vector) count once, repeated candidates each for itself; ties go
to the smaller id; scores outside 64 bits are cut to its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.shared import long_id, map_arrow, materialise

SCALE = 256
DIMENSIONS = 16
#: Numbers in a wave of queries.
WAVE_NUMBERS = 2_000_000
#: Queries whose first partial scores are computed by one matrix product.
TOGETHER = 64


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(np.asarray(values, np.float64) * scale)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, m: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0)] * m, [np.empty(0, np.int64)] * m

    def bound(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -math.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[q], scores), np.append(self.ids[q], ids)
        if len(scores) > self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[enough], ids[enough]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, best: Best, numbers: list[int]) -> int:
    """Adds the block's candidates (dimensions x candidates) to ``best``; returns how many products were finished."""
    d, finished = len(block), 0
    edges = [*range(0, d, DIMENSIONS), d]
    # Norms of what remains after each block of dimensions, rounded up.
    squares = lambda x, axis: np.sqrt(np.stack([np.square(x.take(range(e, d), axis)).sum(axis) for e in edges[1:]])) * (1 + 1e-9)
    rest_q, rest_x = squares(queries, 1), squares(block, 0)
    for start in range(0, len(queries), TOGETHER):
        partial = queries[start : start + TOGETHER, : edges[1]] @ block[: edges[1]]
        for q in range(start, start + len(partial)):
            score, least = partial[q - start], best.bound(numbers[q])
            other = ids != query_ids[q]
            if least == -math.inf and len(ids) > 256:
                # A first bound: the most promising candidates, in full.
                some = np.argpartition(-score, 64)[:64]
                full = np.sort((queries[q] @ block[:, some])[other[some]])
                least = full[-best.k] if len(full) >= best.k else least
            alive = np.flatnonzero(other & (score + rest_q[0, q] * rest_x[0] >= least - 1e-6))
            score = score[alive]
            for k in range(1, len(edges) - 1):
                score = score + queries[q, edges[k] : edges[k + 1]] @ block[edges[k] : edges[k + 1], alive]
                keep = score + rest_q[k, q] * rest_x[k, alive] >= least - 1e-6
                alive, score = alive[keep], score[keep]
            finished += len(alive)
            best.add(numbers[q], score, ids[alive])
    return finished


def exact_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, best: Best, numbers: list[int]) -> None:
    """For components whose products aren't exact in doubles: whole numbers of any size."""
    whole = [[int(x) for x in column] for column in block.T]
    for q, i in enumerate(query_ids):
        own = [int(x) for x in queries[q]]
        rows = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, x, strict=True)))), int(j)) for x, j in zip(whole, ids, strict=True) if j != i]
        scores, found = best.scores[numbers[q]], best.ids[numbers[q]]
        rows += [(int(s), int(j)) for s, j in zip(scores, found, strict=True)]
        rows = sorted(rows, key=lambda r: (-r[0], r[1]))[: best.k]
        best.scores[numbers[q]], best.ids[numbers[q]] = np.array([s for s, _ in rows], object), np.array([j for _, j in rows], np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    whole = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & whole).select(long_id(df, id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` holds for, the k other rows of largest inner product."""
    rows, asked = usable(df, id_col, vector_col), usable(df.where(is_query), id_col, vector_col).distinct()
    spark = df.sparkSession
    numbers, longest = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)), F.max(F.size("vector"))).first()
    waves = max(1, math.ceil(2 * numbers / max(WAVE_NUMBERS, longest or 0)))
    found = None
    for wave in range(waves):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(waves)) == wave) if waves > 1 else asked
        queries = sorted((r.vec_id, tuple(r.vector)) for r in own.collect())
        shared = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, list[int]] = {}
            for n, (_, vector) in enumerate(shared.value):
                by_length.setdefault(len(vector), []).append(n)
            sets = {d: (quantised([shared.value[n][1] for n in ns], scale), np.array([shared.value[n][0] for n in ns]), ns) for d, ns in by_length.items()}
            best = Best(len(shared.value), k)
            for batch in batches:
                column, ids = batch.column("vector"), batch.column("vec_id").to_numpy()
                lengths = column.value_lengths().to_numpy()
                for d in np.unique(lengths):
                    if int(d) not in sets:
                        continue
                    own, query_ids, ns = sets[int(d)]
                    some = lengths == d
                    block = np.ascontiguousarray(quantised(column.filter(pa.array(some)).flatten().to_numpy(), scale).reshape(-1, d).T)
                    small = np.abs(own).max(initial=0) * np.abs(block).max(initial=0) * d < 2**52
                    (search_block if small and not any(best.scores[n].dtype == object for n in ns) else exact_block)(own, query_ids, block, ids[some], best, ns)
            for start in range(0, len(shared.value), 2000):
                part = range(start, min(start + 2000, len(shared.value)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shared.value[n][0] for n in part for _ in best.ids[n]], pa.int64()), pa.array([n for n in part for _ in best.ids[n]], pa.int32()),
                     pa.array([int(i) for n in part for i in best.ids[n]], pa.int64()), pa.array([int(s) for n in part for s in best.scores[n]], pa.int64())],
                    names=["query_id", "number", "vec_id", "score"],
                )

        order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
        ranked = map_arrow(rows, run, "query_id long, number int, vec_id long, score long").withColumn("rank", F.row_number().over(order))
        some = materialise(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk-wave")
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    return found


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
