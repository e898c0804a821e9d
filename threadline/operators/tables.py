"""Intermediate tables in the folder that driver and executors share, and numbering of rows without one task for a group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a fresh folder where that is unset, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends there and lost executors do no harm."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` for a join in which both sides are dealt by the key and sorted, whatever its size is taken for: that of a stored table is
    taken from its compressed files, and that of columns of arrays from one element each, far less than a broadcast would hold."""
    return df.hint("merge")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``name``: the place of each row in its group, from 1, however large the group is.

    Rows are range-sorted as a whole; a group's rows in a range are numbered there, and a table with one row for each
    range and group tells how many of the group lie in the ranges before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = laid.groupBy("__range", *keys).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__range").alias("__of"), *[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    here = laid.withColumn("__here", F.row_number().over(W.partitionBy("__range", *keys).orderBy(*order)))
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return here.join(offsets, same).select(*rows.columns, (F.col("__here") + F.col("__before")).cast("long").alias(name))
