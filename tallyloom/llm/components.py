"""Connected components of a graph whose edges lie in a table.

Rounds of hooking and contraction: every vertex hooks on its smallest smaller neighbour, hooks are followed two steps,
and the edges are rewritten between what their ends hooked on, until none is left. Every round at least halves the
vertices that still have edges; a star or a chain of any size takes a few rounds. Each round is a `groupBy(min)` with
map-side partial results and two equi-joins, so a vertex with a third of all edges is pre-aggregated before the shuffle
and its join side is split by adaptive execution. Only a row count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store


def _step(edges: DataFrame, jump: DataFrame) -> DataFrame:
    hi, lo = jump.select(F.col("node").alias("hi"), F.col("up").alias("hi_up")), jump.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
    a, b = F.coalesce("hi_up", "hi"), F.coalesce("lo_up", "lo")
    moved = edges.join(hi, "hi", "left").join(lo, "lo", "left").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    return moved.where("hi <> lo").distinct()


def _followed(parent: DataFrame) -> DataFrame:
    above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
    return parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))


def connected_components(edges: DataFrame, store: Store, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of an edge; component is the smallest vertex reachable.

    Edges may repeat, point either way, join a vertex with itself (no effect) or hold a null end (no effect).
    """
    ends = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    left = store.put(ends.where("whole AND hi <> lo").select("hi", "lo").distinct(), "edges")
    labels = left.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        parent = left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        jump = store.put(_followed(_followed(parent)), "hooks")
        found = jump.select(F.col("node").alias("component"), F.col("up").alias("higher"))
        labels = labels.join(found, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
        labels = store.put(labels, "labels")
        after = store.put(_step(left, jump), "edges")
        store.drop(left)  # nothing reads it any more: the labels that came from it are written
        left = after
    return labels
