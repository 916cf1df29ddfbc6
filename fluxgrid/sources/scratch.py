"""Cutting lineage through files that outlive an executor.

``cut`` writes a DataFrame as Parquet below the folder named by ``spark.checkpoint.dir`` and reads it
back. The folder is shared by all executors, so a lost executor costs a re-read, never a recomputation
that could come out in another order. Where the setting is absent and Spark runs in one process (tests,
notebooks) a folder of its own is set once per session; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a fresh local one only where none is set and Spark runs in one process."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: computed once, re-read by everything after it.

    The files go when the application ends. Row order and Spark partition ids are not kept; a column that
    depends on either has to be in ``df`` already.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
