"""Intermediate tables in the folder that the cluster's driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, *without: str) -> Column:
    """``_doc``: the columns of ``df`` but ``without``, in one struct, where no name of theirs can clash."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns) if c not in without]).alias("_doc")


def unpacked(df: DataFrame, *without: str) -> list[tuple[str, Column]]:
    """(name, column) of what ``packed`` put into ``_doc``."""
    return [(c, F.col("_doc").getField(f"c{k}")) for k, c in enumerate(df.columns) if c not in without]


#: Bytes that Spark hands to a Python worker at once; its own default is eight times as much.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most BATCH_BYTES to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    Unlike a checkpoint of rows the table is compressed and column-pruned, and it outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graticule/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(file).getParent()
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget unreachable shuffles, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
