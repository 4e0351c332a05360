"""Helpers that keep the operators safe on very large and very skewed tables.

Nothing here caps, samples or drops rows, and nothing depends on the size of
the input: joins are left to Catalyst and its adaptive skew handling, numbering
goes by range.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/litmill/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table and read it back: cuts lineage, survives executor loss, gives real sizes."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on an input that comes in too few splits.

    A table with at least as many splits as cores, as any large one, is returned
    as it is and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def join_all(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}_right"))
    return left.join(other, met, how).drop(*(f"_{k}_right" for k in keys))


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """The rows dealt by range of keys and order, with the number of their range in ``_part``; written out.

    A key with many rows spans several ranges, so no task holds more than one;
    only rows that tie in every column stay together.
    """
    lead = [F.col(k).asc_nulls_first() for k in keys]
    return stage(df.repartitionByRange(*lead, *order).withColumn("_part", F.spark_partition_id()), label)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column | None = None,
    name: str = "seq",
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the given total order; rows with a null key form a group.

    With ``value`` omitted this numbers the rows 1..n.  Rows are summed within
    their range, and what the key's earlier ranges hold is carried forward: one
    total for each key and range, few of which are not a key's first.
    """
    keys = list(keys)
    value = F.lit(1) if value is None else value
    rows = ranges(df.withColumn("_v", value.cast("long")), keys, order, "ranges")
    parts = ["_part", *keys]
    totals = rows.groupBy(*parts).agg(F.sum("_v").alias("_t"))
    if keys:
        before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        bases = totals.withColumn("_base", F.sum("_t").over(before)).filter("_base is not null").drop("_t")
    else:
        # As many rows as ranges.
        at, listed = 0, []
        for part, total in sorted(totals.collect()):
            listed.append((part, at))
            at += total or 0
        bases = df.sparkSession.createDataFrame(listed, "_part int, _base long")
    within = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = join_all(rows.withColumn(name, F.sum("_v").over(within)), bases, parts)
    return out.withColumn(name, F.col(name) + F.coalesce("_base", F.lit(0))).drop("_v", "_part", "_base")


def previous(df: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``value`` of the row before, per key in the order of the given columns (nulls first); null keys form a group."""
    sort = [F.col(c).asc_nulls_first() for c in order]
    rows = ranges(df, [key], sort, "ranges")
    lasts = rows.groupBy("_part", key).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    bases = lasts.withColumn("_carry", F.lag("_last").over(W.partitionBy(key).orderBy("_part"))).filter("_carry is not null")
    own = W.partitionBy("_part", key).orderBy(*sort)
    rows = rows.withColumn("_lag", F.lag(value).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    out = join_all(rows, bases.drop("_last"), ["_part", key])
    return out.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop(
        "_part", "_lag", "_first", "_carry"
    )
