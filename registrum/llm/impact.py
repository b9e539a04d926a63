"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components become integers (floor(256 * x)). Candidates are cut into blocks; a block's index is built once, in the task that its rows are sorted
to, and all queries stream past it, so no query set has to fit anywhere. The best of the blocks are merged by a partial top-k and a final one. In a block, every dimension has postings cut into
segments by quantised value. For a query, a posting's impact is what it adds over the dimension's worst value for that query, so impacts
are never negative; segments are processed by descending quantised impact over all dimensions, adding exact impacts to accumulators. An
accumulator is a lower bound; with the highest impacts still open in each dimension added, an upper one. Processing stops when the upper
bounds prove all but a few candidates out of the top k; those few are rescored exactly from their vectors.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part; shorter vectors count as padded with zeros. Repeated rows are
candidates each, and one query; of an id with different vectors each is a query with ranks of its own. Ties go to the smaller id. A query's own row is any row of its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import releasing

#: Candidates of a block; segments of a dimension; segments between two proofs.
CANDIDATES, LEVELS, STRIDE = 8192, 8, 48


class Index:
    """Postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        low, high = vectors.min(0), vectors.max(0)
        width = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (vectors - low) // width
        self.low, self.high = low, high
        self.segments = []  # of each dimension by rising value: candidates, their values, smallest and largest
        for d in range(vectors.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            ends = np.searchsorted(level[order, d], np.arange(LEVELS + 1))
            own = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a]
            self.segments.append([(rows, vectors[rows, d], int(vectors[rows, d].min()), int(vectors[rows, d].max())) for rows in own])

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates whose id isn't `own`, best first."""
        worst = np.where(query >= 0, self.low, self.high)
        todo, open_ = [], np.where(query >= 0, self.high - worst, worst - self.low) * np.abs(query)
        for d in np.flatnonzero(query):
            runs = self.segments[d] if query[d] < 0 else self.segments[d][::-1]
            tops = [int(abs(query[d])) * abs((hi if query[d] > 0 else lo) - int(worst[d])) for _, _, lo, hi in runs]
            todo += [(top, d, run, (*tops, 0)[i + 1]) for i, (top, run) in enumerate(zip(tops, runs, strict=True))]
        todo.sort(key=lambda x: -x[0])
        sums = np.zeros(len(self.ids), np.int64)
        sums[self.ids == own] = np.iinfo(np.int64).min // 2
        rest, few, possible = int(open_.sum()), max(4 * k, len(self.ids) // 64), None
        for n, (_, d, (rows, values, _, _), then) in enumerate(todo, 1):
            sums[rows] += int(query[d]) * (values - int(worst[d]))
            rest += then - int(open_[d])
            open_[d] = then
            if n % STRIDE == 0 and len(sums) > k:
                floor = np.partition(sums, -k)[-k]
                possible = np.flatnonzero(sums + rest >= floor)
                if len(possible) <= few:
                    break
        else:
            possible = None
        if possible is None:
            possible = np.argpartition(-sums, k)[: k + 1] if len(sums) > k else np.arange(len(sums))
            possible = np.flatnonzero(sums >= sums[possible].min()) if len(sums) > k else possible
        possible = possible[self.ids[possible] != own]
        scores = self.vectors[possible] @ query
        order = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][order], scores[order]


def _integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of `width` numbers, padded with zeros or cut."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out[:, :width]


def searched(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best of all rows for each row whose id is divisible by `every`."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), _integers(F.col(vector), scale).alias("v")).where("id is not null and v is not null")
    across = -(-rows.count() // candidates) or 1
    offered = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(across)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    asked = rows.where(F.col("id") % every == 0).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v")
    names = ["query_id", "ask", "vec_id", "score"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block first the candidates, then the queries."""
        block, held, index = None, [], None
        for batch in batches:
            blocks, asks, ids, asked_as = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1), batch.num_rows]
            out = [(np.zeros(0, np.int64),) * 4]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if block != blocks[lo]:
                    block, held, index = blocks[lo], [], None
                vectors = batch.column(3).slice(lo, hi - lo)
                if not asks[lo]:
                    held.append((ids[lo:hi], vectors))
                    continue
                if index is None and held:
                    width = max(1, *(int(v.value_lengths().to_numpy().max(initial=0)) for _, v in held))
                    index = Index(np.concatenate([i for i, _ in held]), np.concatenate([_matrix(v, width) for _, v in held]))
                if index is not None:
                    for own, ask, query in zip(ids[lo:hi], asked_as[lo:hi], _matrix(vectors, index.vectors.shape[1]), strict=True):
                        found, scores = index.best(query, own, k)
                        out.append((np.full(len(found), own), np.full(len(found), ask), found, scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(4)], names)

    dealt = offered.unionByName(asked).withColumn("ask", F.when(F.col("asks"), F.xxhash64("v")).otherwise(0)).repartition(2 * across, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(releasing(best), "query_id long, ask long, vec_id long, score long")
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
