"""Steps of a lineage as written tables in the cluster's shared folder.

A plan that reads a step several times would otherwise carry the step's whole plan as often, and a lost executor would
cost all of it anew.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions in one process that name none, by application.
_MADE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one new folder for the application if Spark runs in one process. On a
    cluster it must be set: a folder of one machine would lose what executors write. The setting itself is static, so it
    is left as it is; the context's checkpoints go to the new folder too."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _MADE:
            _MADE[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
            context.setCheckpointDir(_MADE[context.applicationId])
        found = _MADE[context.applicationId]
    return found.rstrip("/")


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledger/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
