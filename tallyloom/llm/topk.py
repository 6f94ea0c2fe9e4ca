"""Exact top-k by integer inner product: MaxScore over blocks of candidates.

A component x of a vector becomes the integer floor(1024 * x). Every dimension is a term, whose posting list in a shard is
the shard's column of that dimension, and the bound of a query's term is the best product that the column can give. For a
tile of queries the terms are ordered by their bounds; the longest tail whose bounds together cannot lift an untouched
candidate over any query's running threshold is non-essential. The essential postings are traversed (one matrix product),
then the other terms are probed, in steps, for the candidates alone whose partial score plus the bounds left still beats
the threshold. Each shard keeps its k best of every query, and a ranking over the shards' lists merges them.

Candidates are dealt to shards by hash, so a vector that stands in many rows, or many with one label, load no shard more
than another. The queries, a stated part of the rows, travel once to each shard and meet it in tiles; nothing is broadcast
or collected. In a shard candidates come in the order of their ids, so a later one must beat the threshold, not tie it.

Rows without an id, and vectors that are null or hold null or non-finite components (or such as 1024 times them is not
finite), take no part. Vectors of different lengths never meet; those of length zero score zero. Rows that repeat a vec_id are candidates of their own for other ids;
none is a candidate for its own id; a repeated query row asks once for each distinct vector. Scores beyond 64 bits
count as the nearest 64-bit number. An empty table gives an empty result. Other columns of the
table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store

SCALE, K = 1024, 10
#: Components of a shard's candidates (64 MiB of doubles), candidates of a block and queries of a tile.
SHARD_CELLS, BLOCK, TILE = 1 << 23, 2048, 256
#: Partial scores are exact in doubles below this; larger components take Python's integers.
EXACT = float(1 << 52)

HITS = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Shard:
    """Candidates of one length in ascending order of ids: blocks of integer components with their bounds."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells
        self.large = float(np.abs(cells).max()) if cells.size else 0.0

    def top(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of q, candidate ids, scores) with the k best of every query, ties to the smaller id."""
        reach = self.large * (float(np.abs(q).max()) if q.size else 0.0) * max(q.shape[1], 1)
        if reach >= EXACT:
            yield from self._plain(q_ids, q, k)
            return
        for lo in range(0, len(q), TILE):
            yield from self._tile(q_ids[lo : lo + TILE], q[lo : lo + TILE], k, lo)

    def _tile(self, q_ids: np.ndarray, q: np.ndarray, k: int, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n = len(q)
        best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)  # best first
        for at in range(0, len(self.ids), BLOCK):
            ids, cells = self.ids[at : at + BLOCK], self.cells[at : at + BLOCK]
            rows, cols, scores = self._competitive(q, cells, best_s[:, -1])
            own = q_ids[rows] == ids[cols]
            rows, cols, scores = rows[~own], cols[~own], scores[~own]
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(rows)]):
                r = rows[s]
                # the held ones come first and have smaller ids, so a stable order keeps ties with them
                together = np.r_[best_s[r], scores[s:e]]
                order = np.argsort(-together, kind="stable")[:k]
                best_i[r], best_s[r] = np.r_[best_i[r], ids[cols[s:e]]][order], together[order]
        for r in range(n):
            held = np.isfinite(best_s[r])
            yield base + r, best_i[r][held], best_s[r][held].astype(np.int64)

    @staticmethod
    def _competitive(q: np.ndarray, cells: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all pairs whose score is over the query's threshold, in this order."""
        n, dims = q.shape
        if dims == 0:
            rows, cols = np.nonzero(np.broadcast_to(0.0 > threshold[:, None], (n, len(cells))))
            return rows, cols, np.zeros(len(rows))
        bound = np.maximum(q * cells.max(axis=0), q * cells.min(axis=0))
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        rest = np.zeros((n, dims + 1))  # what the terms from a place on can add
        rest[:, :dims] = bound[:, order][:, ::-1].cumsum(axis=1)[:, ::-1]
        # non-essential: the longest tail that no query can win with alone
        essential = int(np.argmax((rest <= threshold[:, None]).all(axis=0))) if (rest[:, -1] <= threshold).all() else dims
        if essential == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = essential
        part = q[:, order[:first]] @ cells[:, order[:first]].T
        rows, cols = np.nonzero(part + rest[:, first][:, None] > threshold[:, None])
        scores = part[rows, cols]
        # the others are probed by halves, for the pairs alone that stay competitive
        while first < dims and len(rows):
            then = min(dims, first + max(4, (dims - first) // 2))
            some = order[first:then]
            scores = scores + np.einsum("ij,ij->i", q[:, some][rows], cells[:, some][cols])
            stay = scores + rest[rows, then] > threshold[rows]
            rows, cols, scores, first = rows[stay], cols[stay], scores[stay], then
        return rows, cols, scores

    def _plain(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        exact = np.vectorize(int, otypes=[object])
        cells = exact(self.cells) if self.cells.size else self.cells.astype(object)
        for r in range(len(q)):
            scores = cells @ exact(q[r]) if q.shape[1] else np.zeros(len(cells), object)
            clipped = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores.tolist()]
            found = sorted((-s, i) for s, i in zip(clipped, self.ids.tolist()) if i != q_ids[r])[:k]
            yield r, np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).reshape(len(column), dims)


def _searched(k: int):
    """mapInArrow over rows (dims, shard, asks, id, embedding, asked), sorted so: a shard's candidates, then queries.

    `asked` is how often a candidate row stands in the table, or which of its vectors a query id asks with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, cells, shard = None, [], [], None
        for batch in batches:
            dims, number, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(dims)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if at != (dims[lo], number[lo]):
                    at, ids, cells, shard = (dims[lo], number[lo]), [], [], None
                rows_ids, rows = part.column(3).to_numpy(zero_copy_only=False), _integers(part.column(4), int(dims[lo]))
                asked = part.column(5).to_numpy(zero_copy_only=False)
                if not asks[lo]:
                    ids.append(np.repeat(rows_ids, asked))
                    cells.append(np.repeat(rows, asked, axis=0))
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(ids) if ids else rows_ids[:0], np.concatenate(cells) if cells else rows[:0])
                    ids, cells = [], []
                found = list(shard.top(rows_ids, rows, k))
                sizes = [len(i) for _, i, _ in found]
                which = np.repeat(np.array([r for r, _, _ in found], np.int64), sizes)
                out = [rows_ids[which], asked[which], *(np.concatenate([f[j] for f in found]) for j in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=HITS)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", embedding: str = "embedding", shard_cells: int = SHARD_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of `vectors` for each row of `queries`, both (key, embedding)."""
    spark = vectors.sparkSession
    store = Store(spark, "topk")

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("embedding")).where("id IS NOT NULL AND embedding IS NOT NULL")
        finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * SCALE < F.lit(float("inf"))))
        return rows.where(finite)

    # equal rows are one with a count, of which no list can hold more than k
    candidates = store.put(usable(vectors).groupBy("id", "embedding").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")).withColumn("dims", F.size("embedding")), "candidates")
    cores = spark.sparkContext.defaultParallelism
    # shards for the memory of a task and, where there are rows for it, for all cores
    wanted = F.greatest(F.ceil(F.sum("copies") * F.greatest("dims", F.lit(1)) / shard_cells), F.least(F.lit(2 * cores), F.ceil(F.sum("copies") / BLOCK)))
    sizes = store.put(candidates.groupBy("dims").agg(wanted.cast("int").alias("shards")), "sizes")
    asking = usable(queries).dropDuplicates(["id", "embedding"]).withColumn("dims", F.size("embedding")).join(sizes, "dims")
    placed = candidates.join(sizes, "dims").select("dims", F.pmod(F.xxhash64("id", "embedding"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "embedding", F.col("copies").cast("long").alias("asked"))
    spread = asking.select("dims", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("asks"), "id", "embedding", F.xxhash64("embedding").alias("asked"))
    rows = placed.unionByName(spread).repartition("dims", "shard").sortWithinPartitions("dims", "shard", "asks", "id")
    hits = store.put(rows.mapInArrow(_searched(k), "query_id long, asked long, vec_id long, score long"), "hits")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
