"""Numbers of rows in an order inside groups, where one group may hold most of all rows.

One window a group would sort the largest group in one task. Rows are put into ranges of the whole order instead, groups
first, so a large group spans many ranges; ranges are numbered each in its own task, and what stands before a range comes
from the counts of the group's ranges before it, of which there are no more than tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.staging import staged


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with `name`: 1, 2, .. in `order` inside each group of `by`. `order` must tell the rows of a group apart for the
    numbers to be the same in every run. The ranges are written before they are read twice, as a range that is computed
    again elsewhere must hold the same rows."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(ranges, *keys, *order) if ranges else df.repartitionByRange(*keys, *order)
    rows = staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    first = counts.select(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)), F.col("_range").alias("_in"), before.alias("_before"))
    same = F.col("_range") == F.col("_in")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return rows.withColumn("_nth", inside).join(first, same).select(*df.columns, (F.col("_before") + F.col("_nth")).cast("long").alias(name))
