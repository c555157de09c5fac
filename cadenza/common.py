"""Helpers shared by every operator: table access, lineage cuts, redelivery."""

from __future__ import annotations

import os
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session of one machine gets a folder of that machine; on a cluster such a
    folder would be another one on each host, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cadenza-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    The copy outlives a lost executor; it is read back by every branch instead of being recomputed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def millis(seconds: Column) -> Column:
    """Seconds to whole milliseconds; NULL, NaN and infinite values become NULL, negatives 0."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e14))
    return F.when(finite, F.greatest(F.round(seconds * 1000.0), F.lit(0.0)).cast("bigint"))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Drop re-delivered rows, which repeat every column but the delivery time."""
    return df.dropDuplicates(list(keys))


def bounded_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows, and never more than twice as many, drawn evenly by a hash of ``key``.

    The share is set by a count, so that no task sends more than its part to the driver.
    """
    total = df.count()
    if total <= size:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(size / total * (1 << 30))).limit(2 * size)


#: Keys with more than this part of all rows are joined by broadcast; there are fewer than its inverse of them.
HEAVY = 1 / 1000


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, *, n: str = "n") -> DataFrame:
    """Left join with a table of one row a key, in which no key's rows meet in one task.

    ``counts`` tells how many rows of ``left`` each key has. Keys that hold over ``HEAVY`` of them are
    fewer than ``1 / HEAVY``, whatever the data, and are joined by broadcast; the rows of all others
    are shuffled. Rows with a NULL key are joined with nothing and not moved.
    """
    spark = left.sparkSession
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot_keys = counts.where(F.col(n) > total * HEAVY).select(*keys)
    hot = spark.createDataFrame(hot_keys.collect(), hot_keys.schema).withColumn("_hot", F.lit(True))
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    flagged = left.where(~some_null).join(F.broadcast(hot), keys, "left")
    few = right.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")
    out = flagged.where("_hot").drop("_hot").join(F.broadcast(few), keys, "left").unionByName(flagged.where("_hot IS NULL").drop("_hot").join(right, keys, "left"))
    return out.unionByName(left.where(some_null), allowMissingColumns=True)
