"""Exact top-k against all scores."""

import math
import random

from tallyloom.llm import topk

VEC = "vec_id long, embedding array<double>"


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in e)


def plain(rows, queries, k=10):
    cells = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and usable(e)]
    asked = {(i, tuple(e)) for i, e in queries if i is not None and usable(e)}
    out = []
    for i, e in asked:
        q = [math.floor(1024 * x) for x in e]
        clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        scores = sorted((-clip(sum(a * b for a, b in zip(q, c))), j) for j, c in cells if j != i and len(c) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, queries, **sizes):
    v, q = (spark.createDataFrame(r, VEC) for r in (rows, queries))
    return sorted(tuple(r) for r in topk.top_k(v.repartition(3), q, **sizes).select("query_id", "rank", "vec_id", "score").collect())


def test_scores_ties_and_shards(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(6000)]
    rows += [(10_000 + i, rows[i % 7][1]) for i in range(500)]  # many ties
    rows += [(20_000, rows[3][1])] * 40  # a row that repeats
    queries = [r for r in rows if r[0] % 100 == 0]
    want = plain(rows, queries)
    assert found(spark, rows, queries) == want
    assert found(spark, rows, queries, shard_cells=5000) == want


def test_pruning_leaves_no_better_candidate_behind():
    import numpy as np

    rng = np.random.default_rng(2)
    for dims in (1, 2, 7, 64):
        cells, q = np.floor(1024 * rng.normal(0, 0.1, (500, dims))), np.floor(1024 * rng.normal(0, 0.1, (9, dims)))
        scores = q @ cells.T
        for at in (0, 400, 490, 499):
            threshold = np.sort(scores, axis=1)[:, at]
            rows, cols, got = topk.Shard._competitive(q, cells, threshold)
            assert sorted(zip(rows.tolist(), cols.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(scores > threshold[:, None]))))
            assert (got == scores[rows, cols]).all()


def test_unusable_vectors_lengths_and_large_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, -1.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(5, []), (6, []), (7, [3.0]), (8, [0.5, -0.0]), (9, [1e17, 1e17]), (10, [-1e17, 3.0]), (11, [1e306, 1.0]), (12, [-0.0009, 0.0])]
    queries = [r for r in rows if r[0] in (0, 5, 7, 9, None)]
    assert found(spark, rows, queries) == plain(rows, queries)
    assert found(spark, [], []) == [] and found(spark, rows, []) == []


def test_clashing_columns(spark):
    v = spark.createDataFrame([(0, [1.0], 1, "a", 3), (1, [2.0], 2, "b", 4)], VEC + ", shard int, rank string, dims int")
    assert [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
