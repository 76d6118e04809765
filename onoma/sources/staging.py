"""Tables written to a folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where the session names none and runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("onoma.local.checkpoint", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="onoma-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            spark.conf.set("onoma.local.checkpoint", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for drop_staged() to delete."""
    path = f"{shared_dir(spark)}/onoma/{uuid.uuid4().hex}-{label}"
    _written.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and the plan, and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(spark: SparkSession) -> int:
    """Delete all that was staged in this process; for when results have been read or written."""
    done = len(_written)
    _delete(spark, _written)
    _written.clear()
    return done


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: results must be read or written before. Not for use by several threads at once."""
    before = len(_written)
    try:
        yield
    finally:
        _delete(spark, _written[before:])
        del _written[before:]


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with `name`, its place in a total order from 1, without passing all rows through one task.

    Rows are dealt by ranges of the order and written, so that ranges stay as they are; each range numbers its
    own rows and adds the sizes of those before it, of which there are as many as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, (F.row_number().over(own) + F.col("_before")).cast("long")).drop("_range", "_before")
