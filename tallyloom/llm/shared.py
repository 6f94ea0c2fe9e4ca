"""What the operators share: the cluster's shared folder, written tables that cut lineage, and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.staging import shared_folder

#: Rows that a Python task holds as Python objects at once.
SLICE_ROWS = 256


class Store:
    """Tables written to the shared folder: a lost executor then costs a reread, not the whole lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(column: str, keep: list[str], work: Callable[[str], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: the kept columns in the types of the schema (keys are integers), then what `work` returns for
    each text (null: empty)."""
    made = [n for n in schema.names if n not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = [work(t or "") for t in part.column(column).to_pylist()]
                values = zip(*rows) if rows else [[] for _ in made]
                arrays = [part.column(k).cast(schema.field(k).type) for k in keep]
                arrays += [pa.array(list(v), schema.field(n).type) for n, v in zip(made, values)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def text_column(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
