"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated by one fixed random rotation and split into BLOCKS blocks. Vectors with cosine c or more lie
within a squared distance of T = 2 - 2c, so in some block they lie within that block's proportional part of T (the
pigeonhole principle): the union over the blocks of the pairs within the blocks' budgets holds every link. A pair whose
distance in one block is above all of T is in no link, whatever the other blocks say; so the first block's range join,
a product of matrices over its few coordinates, leaves only the pairs that the later blocks still have to look at
(1 in some 2,000 for 64 dimensions and 0.9). The union is verified by the cosine of the vectors as they are given, in
double precision: dot(x, y) / sqrt(dot(x, x) * dot(y, y)), so that pairs at the very bound link.

Vectors meet in tiles: they fall into chunks of bounded size by a hash, and each pair of chunks is one group with at most
CHUNK_VALUES components of each side. In a tile, vectors are ordered into small leaves by cuts between far vectors;
pairs of leaves whose balls lie further apart than T are skipped, which clustered vectors gain from. No pair leaves a
tile: it sends the number of links of each vector and a forest that connects what its links connect. Where many pairs
of a leaf remain (a large group of near copies) they are verified by one product of matrices, and only what lies within
rounding of the bound pair by pair.

Equal vectors are one row with a count before any of this (they are told by 128 bits of hash). The work is quadratic in
the number of distinct vectors, with 2/BLOCKS x dimension operations a pair, and every vector is sent once to each chunk:
vectors of 64 dimensions to n / 32,768 tiles. No exact filter is known that needs less for vectors without clusters:
README gives the figures of finer grids.

Null vectors and such that are zero, empty or hold a null or a non-finite component link with nothing, and vectors of
different length never link. Pairs at exactly the least cosine link. Rows without an id are returned without links or
component. Repeated rows count as vectors of their own. Rows that share an id but not the vector keep their own counts of
links and are one vertex of the components. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components
from tallyloom.llm.shared import Store

COSINE, BLOCKS, SEED = 0.9, 3, 20240229
#: Components of a chunk of vectors on average; rows of a leaf; pairs looked at one by one at once.
CHUNK_VALUES, LEAF, PAIRS_AT_ONCE = 1 << 21, 256, 1 << 17
#: Rounding that float32 squared distances, and double cosines by matrix product, may be off by.
SLACK, UNSURE = 2e-5, 1e-9
#: From this share of a leaf's pairs on they are verified by a matrix product.
DENSE = 0.02


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int) -> list[slice]:
    at = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(at, at[1:])]


class Vectors:
    """A side of a tile: vectors as given (scaled by powers of two), rotated unit vectors, leaves with balls around them."""

    def __init__(self, given: np.ndarray):
        x = given.astype(float)
        # exact, and no square overflows or vanishes
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1]) if len(x) else x
        self.leaves = list(_leaves(x / np.sqrt((x * x).sum(1, keepdims=True))))
        self.order = np.concatenate(self.leaves) if self.leaves else np.zeros(0, np.int64)
        self.x = x[self.order]
        self.square = (self.x * self.x).sum(1)
        self.unit = self.x / np.sqrt(self.square)[:, None]
        self.y = (self.unit @ rotation(x.shape[1])).astype(np.float32)
        ends = np.cumsum([0, *map(len, self.leaves)])
        self.parts = [slice(a, b) for a, b in zip(ends, ends[1:])]
        self.center = np.array([self.unit[p].mean(0) for p in self.parts])
        self.radius = np.array([np.sqrt(((self.unit[p] - c) ** 2).sum(1).max()) for p, c in zip(self.parts, self.center)])

    def near(self, other: Vectors, i: int, apart: float) -> np.ndarray:
        """Leaves of the other side that leaf i may have links with."""
        d = np.sqrt(((other.center - self.center[i]) ** 2).sum(1))
        return np.flatnonzero(d - other.radius - self.radius[i] <= apart)


def _leaves(unit: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of LEAF at most: the nearer to one or the other of two far vectors, or halves if that is lopsided."""
    left = [np.arange(len(unit))] if len(unit) else []
    while left:
        rows = left.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        some = unit[rows]
        far = some[(some @ some[0]).argmin()]
        along = some @ (far - some[(some @ far).argmin()])
        nearer = along > 0
        if not len(rows) < 8 * nearer.sum() < 7 * len(rows):
            nearer = np.zeros(len(rows), bool)
            nearer[np.argpartition(along, len(rows) // 2)[: len(rows) // 2]] = True
        left += [rows[nearer], rows[~nearer]]


class Forest:
    """Union-find over arrays: every step hooks the larger root on the smaller and follows all to their roots."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.up[p], self.up[q]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


def _places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a sparse mask, eight places at a time."""
    flat = mask.ravel()
    whole = flat[: flat.size // 8 * 8]
    some = np.flatnonzero(whole.view(np.uint64) != 0)
    at, k = np.nonzero(whole.reshape(-1, 8)[some])
    return np.concatenate([8 * some[at] + k, whole.size + np.flatnonzero(flat[whole.size :])])


def _exactly(a: Vectors, b: Vectors, p: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    return (a.x[p] * b.x[q]).sum(1) / np.sqrt(a.square[p] * b.square[q]) >= cosine


def _linked_in(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows, columns) of a forest that connects what a matrix of links connects."""
    n, (rows, columns) = len(ok), ok.shape
    row = np.arange(n)
    while True:
        column = np.where(ok, row[:, None], n).min(0)
        lower = np.minimum(row, np.where(ok, column[None, :], n).min(1))
        if (lower == row).all():
            break
        row = lower
    # label c stands for row c: both sides are joined with columns through it
    first = ok.argmax(1)
    p, q = np.flatnonzero(ok.any(1)), np.flatnonzero(column < n)
    return np.concatenate([p, column[q]]), np.concatenate([first[p], q])


def links(a: Vectors, b: Vectors, same: bool, cosine: float, counts: dict | None = None) -> Iterator[tuple]:
    """(rows of a, rows of b, matrix): links one by one (matrix None), or the matrix of links between rows and columns.

    In one chunk (`same`), each pair comes once. `counts` takes how many pairs the first block, and the later ones, look at.
    """
    dim, total = a.x.shape[1], 2 - 2 * cosine
    parts = cuts(dim)
    cut = parts[0]
    budgets = [total * (c.stop - c.start) / dim + SLACK for c in parts]
    # with the halved squares as two more coordinates the product is minus half the squared distance
    half = lambda y: (y * y).sum(1, keepdims=True) / 2
    one = lambda y: np.ones((len(y), 1), np.float32)
    ya, yb = a.y[:, cut], b.y[:, cut]
    left, right = np.hstack([ya, -half(ya), one(ya)]), np.hstack([yb, one(yb), -half(yb)])
    least = np.float32(-(total + SLACK) / 2)
    for i, rows in enumerate(a.parts):
        near = a.near(b, i, np.sqrt(total) + SLACK)
        near = near[near >= i] if same else near
        if not len(near):
            continue
        columns = np.concatenate([np.arange(b.parts[j].start, b.parts[j].stop) for j in near])
        found = left[rows] @ right[columns].T
        if counts is not None:
            counts["first"] = counts.get("first", 0) + found.size
        mask = found >= least
        n = np.count_nonzero(mask)
        if n > DENSE * mask.size:
            some = np.arange(rows.start, rows.stop)[mask.any(1)]
            columns = columns[mask.any(0)]
            value = a.unit[some] @ b.unit[columns].T
            later = columns[None, :] > some[:, None] if same else True
            ok = (value >= cosine) & later
            # pairs at the bound are few; all others are further from it than the product's rounding
            r, c = np.nonzero((np.abs(value - cosine) <= UNSURE) & later)
            ok[r, c] = _exactly(a, b, some[r], columns[c], cosine)
            if ok.any():
                yield some, columns, ok
            continue
        where = _places(mask)
        p, q = where // mask.shape[1], where % mask.shape[1]
        d = -2 * found[p, q]
        p, q = p + rows.start, columns[q]
        if same:
            p, q, d = p[p < q], q[p < q], d[p < q]
        if counts is not None:
            counts["later"] = counts.get("later", 0) + len(p)
        for at in range(0, len(p), PAIRS_AT_ONCE):
            u, v, so_far = p[at : at + PAIRS_AT_ONCE], q[at : at + PAIRS_AT_ONCE], d[at : at + PAIRS_AT_ONCE]
            within = so_far <= budgets[0]
            for k, c in enumerate(parts[1:], 1):
                e = ((a.y[u, c] - b.y[v, c]) ** 2).sum(1)
                so_far, within = so_far + e, within | (e <= budgets[k])
                keep = so_far <= total + SLACK
                u, v, so_far, within = u[keep], v[keep], so_far[keep], within[keep]
            u, v = u[within], v[within]
            good = _exactly(a, b, u, v, cosine)
            if good.any():
                yield u[good], v[good], None


FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("links", pa.int64()), ("rep", pa.int64()), ("up", pa.int64())])


def _tile(cosine: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, chunk, other = (k.as_py() for k in key)
        h = np.stack([t.column(c).to_numpy() for c in ("h1", "h2")], 1)
        # a row may stand twice in the table with its id and vector
        _, first = np.unique(h, axis=0, return_index=True)
        of = t.column("chunk").to_numpy()[first]
        first = np.concatenate([first[of == chunk], first[of != chunk]])
        n, same = int((of == chunk).sum()), chunk == other
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        a = Vectors(flat[first[:n]])
        b = a if same else Vectors(flat[first[n:]])
        rows = first[a.order] if same else np.concatenate([first[:n][a.order], first[n:][b.order]])
        shift, weight = 0 if same else n, t.column("copies").to_numpy()[rows]
        count, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
        for p, q, ok in links(a, b, same, cosine):
            q = q + shift
            if ok is None:
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                forest.join(p, q)
            else:
                count[p] += ok @ weight[q]
                count[q] += weight[p] @ ok
                r, c = _linked_in(ok)
                forest.join(p[r], q[c])
        got = np.flatnonzero(count)
        rep = t.column("rep").to_numpy()[rows]
        return pa.Table.from_arrays([pa.array(h[rows[got], 0]), pa.array(h[rows[got], 1]), pa.array(count[got]), pa.array(rep[got]), pa.array(rep[forest.up[got]])], schema=FOUND)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", store: Store | None = None) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    if not 0 < cosine <= 1:
        raise ValueError("the least cosine must be above 0 and at most 1")
    store = store or Store(vectors.sparkSession, "embeddings")
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0)
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    # equal but for the sign of zeros is equal
    plain = F.transform(vector, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("embedding"), F.coalesce(fine & whole, F.lit(False)).alias("good"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(SEED), plain).alias("h2"))
    # with both hashes and the id, no table but the tiles' needs the vectors
    marked = rows.where("good").withColumn("dim", F.size("embedding"))
    reps = store.put(marked.groupBy("h1", "h2", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    parts = reps.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.col("dim") / CHUNK_VALUES)).cast("int").alias("parts"))
    placed = reps.join(parts, "dim").withColumn("chunk", F.pmod(F.col("h1"), F.col("parts")).cast("int"))
    held = marked.join(placed.withColumnRenamed("rep", "id").drop("dim"), ["id", "h1", "h2"]).withColumnRenamed("id", "rep")
    meets = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = meets.select("dim", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "h1", "h2", "rep", "copies", "embedding")
    found = store.put(tiles.groupBy("dim", "a", "b").applyInArrow(_tile(cosine), "h1 long, h2 long, links long, rep long, up long"), "found")
    sums = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    parts_of = connected_components(found.select(F.col("rep").alias("a"), F.col("up").alias("b")), store).withColumnRenamed("node", "rep")
    known = reps.join(sums, ["h1", "h2"], "left").join(parts_of, "rep", "left").select("h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    good = rows.where("good").select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n", "c")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return good.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))
