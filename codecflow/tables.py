"""Tables that cut lineage: written to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="codecflow-checkpoint-")
        sc.setCheckpointDir(folder)
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def kept(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read from there: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codecflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote and that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._codecflow_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
