"""Tables that are replaced in part and switched as one.

A snapshot holds several tables, each cut by a part (a hash of the household) and a period (a month or a
year, as its rows say). A commit writes the rebuilt
partitions of any of its tables as files of a new generation beside the old ones, and then one small pointer table that
says which generation each partition is read from. A pointer counts once its _SUCCESS mark stands, so whoever reads sees
all of a commit or nothing of it, and a job that dies midway leaves files that no pointer names. One writer at a time.

The pointer has a row for each table, part and period (PARTS x periods x tables at most) and is what the driver reads; of the
tables themselves only the files of the wanted partitions are opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

H = "household_id"
PARTS = 64
POINTER = "name string, part int, period string, generation string"


def part_of(household: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(household), F.lit(parts)).cast("int")


class Snapshot:
    """Tables under a folder, each with household_id and period; `schemas` names them and their columns."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType], parts: int = PARTS):
        self.spark, self.root, self.schemas, self.parts = spark, root.rstrip("/"), schemas, parts

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The newest pointer that was written whole; 0 if there is none."""
        fs, where = self._folder(f"{self.root}/pointers")
        if not fs.exists(where):
            return 0
        made = [int(f.getPath().getName().removeprefix("v=")) for f in fs.listStatus(where)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return max((v for v in made if fs.exists(path(f"{self.root}/pointers/v={v}/_SUCCESS"))), default=0)

    def pointer(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).parquet(f"{self.root}/pointers/v={version}")

    def read(self, name: str, version: int | None = None, households: DataFrame | None = None, periods: Iterable[str] | None = None) -> DataFrame:
        """A table, or of it what lies in the parts of some households and in some periods; its other files are not opened."""
        at = self.pointer(version).where(F.col("name") == name)
        if households is not None:
            at = at.join(households.select(part_of(F.col(H), self.parts).alias("part")).distinct(), "part", "left_semi")
        if periods is not None:
            at = at.where(F.col("period").isin(list(periods)))
        out = self._partitions(name, at)
        return out if households is None else out.join(households.select(H).distinct(), H, "left_semi")

    def _partitions(self, name: str, at: DataFrame) -> DataFrame:
        base, schema = f"{self.root}/data/{name}", self.schemas[name]
        paths = [f"{base}/generation={r.generation}/part={r.part}/period={r.period}" for r in at.collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = StructType([f for f in schema.fields if f.name != "period"]).add("generation", "string").add("part", "integer").add("period", "string")
        return self.spark.read.schema(read).option("basePath", base).parquet(*paths).select(*schema.names)

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame | None]]) -> int:
        """Switches to a new version in which each named table has `rows` in place of what its `touched` partitions
        (household_id, period) held; with None they are those that rows fall into. A partition is touched for all
        households of its part, so rows must hold what is kept of it."""
        before, generation = self.pointer(), uuid.uuid4().hex
        after = before
        for name, (rows, touched) in changes.items():
            base = f"{self.root}/data/{name}/generation={generation}"
            cut = rows.select(*self.schemas[name].names).withColumn("part", part_of(F.col(H), self.parts))
            cut.repartition("part", "period").write.partitionBy("part", "period").parquet(base)
            there = self._written(base)
            gone = there if touched is None else there.unionByName(touched.select(part_of(F.col(H), self.parts).alias("part"), "period").distinct()).distinct()
            kept = after.join(gone.withColumn("name", F.lit(name)), ["name", "part", "period"], "left_anti")
            after = kept.unionByName(there.select(F.lit(name).alias("name"), "part", "period", F.lit(generation).alias("generation")))
        version = self.version() + 1
        after.select("name", "part", "period", "generation").coalesce(1).write.parquet(f"{self.root}/pointers/v={version}")
        return version

    def _written(self, base: str) -> DataFrame:
        """(part, period) of the partitions that a generation has, from the names of its folders."""
        fs, where = self._folder(base)
        found = [(int(p.getPath().getName().removeprefix("part=")), m.getPath().getName().removeprefix("period=")) for p in fs.listStatus(where) if p.isDirectory() and "=" in p.getPath().getName() for m in fs.listStatus(p.getPath())]
        return self.spark.createDataFrame(found, "part int, period string")

    def splice(self, name: str, rows: DataFrame, keys: list[str], gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What `commit` wants for rows that take the place of those whose keys are in `gone` (keys, household_id, period):
        the partitions they lie in, with the rest of their rows."""
        both = gone.select(H, "period").unionByName(rows.select(H, "period"))
        touched = both.select(part_of(F.col(H), self.parts).alias("part"), "period").distinct()
        old = self._partitions(name, self.pointer().where(F.col("name") == name).join(touched, ["part", "period"], "left_semi"))
        columns = self.schemas[name].names
        kept = old.join(gone.select(*keys).distinct(), keys, "left_anti")
        return kept.select(*columns).unionByName(rows.select(*columns)), both
