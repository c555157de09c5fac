"""Order within an entity without gathering the entity: numbers and neighbours across buckets.

Each entity's rows are spread over buckets that follow its order (an hour of its time line, a
thousand of its positions). Windows run within a bucket; one summary row a bucket carries what the
next ones need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], *, name: str = "number") -> DataFrame:
    """``df`` with a running number from 1 in each ``keys`` group; ``bucket`` must rise with ``order``."""
    spread = [*keys, bucket]
    counts = df.groupBy(*spread).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*spread, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*spread).orderBy(*order))
    return df.join(base, spread).withColumn(name, (inside + F.col("_base")).cast("bigint")).drop("_base")


def with_previous(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, *, name: str = "previous") -> DataFrame:
    """``df`` with ``value`` of the row before in each ``keys`` group (NULL for the first), across buckets."""
    spread = [*keys, bucket]
    tagged = df.withColumn("_v", value)
    last = tagged.groupBy(*spread).agg(F.max_by(F.struct("_v"), F.struct(*order)).alias("_last"))
    carry = last.select(*spread, F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carry"))
    inside = F.lag(F.struct("_v")).over(Window.partitionBy(*spread).orderBy(*order))
    return tagged.join(carry, spread).withColumn(name, F.coalesce(inside, F.col("_carry"))["_v"]).drop("_v", "_carry")


def running_max(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, *, name: str, include: bool = True) -> DataFrame:
    """``df`` with the largest ``value`` so far in each ``keys`` group, the row itself included or not."""
    spread = [*keys, bucket]
    tagged = df.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = tagged.groupBy(*spread).agg(F.max("_v").alias("_top")).select(*spread, F.max("_top").over(before).alias("_carry"))
    w = Window.partitionBy(*spread).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    return tagged.join(carry, spread).withColumn(name, F.greatest(F.max("_v").over(w), F.col("_carry"))).drop("_v", "_carry")


def islands(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], fresh: Column, *, name: str = "island") -> DataFrame:
    """``df`` with the ordering key of the row that began its island; ``fresh`` tells whether a row begins one."""
    return running_max(df.withColumn("_fresh", fresh), keys, bucket, order, F.when(F.col("_fresh"), F.struct(*order)), name=name).drop("_fresh")


def text_before(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], text: str, *, most: int, name: str = "context") -> DataFrame:
    """``df`` with the last ``most`` characters of all ``text`` before each row, joined by spaces; NULL if there is none.

    A bucket must be small (some dozens of rows). Beyond its own bucket a row sees the ends of as many
    buckets before it as ``most`` characters take, found by running sums of their lengths.
    """
    spread = [*keys, bucket]
    w = Window.partitionBy(*spread).orderBy(*order)
    said = F.when(F.trim(text) != "", F.col(text))
    inside = F.array_join(F.collect_list(said).over(w.rowsBetween(Window.unboundedPreceding, -1)), " ")
    rows = df.withColumn("_inside", F.right(inside, F.lit(most)))
    whole = df.groupBy(*spread).agg(F.sort_array(F.collect_list(F.struct(*order, said.alias("_t")))).alias("_x"))
    ends = whole.select(*spread, F.right(F.array_join(F.transform("_x", lambda x: x["_t"]), " "), F.lit(most)).alias("_end"))
    by_bucket = Window.partitionBy(*keys).orderBy(bucket)
    size = F.when(F.col("_end") != "", F.length("_end") + 1).otherwise(0).cast("bigint")
    sums = ends.withColumn("_upto", F.sum(size).over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*keys).orderBy("_upto").rangeBetween(-most, 0)
    tails = sums.withColumn("_tail", F.right(F.array_join(F.collect_list(F.nullif("_end", F.lit(""))).over(back), " "), F.lit(most)))
    carry = tails.select(*spread, F.lag("_tail").over(by_bucket).alias("_carry"))
    both = F.concat_ws(" ", F.nullif(F.col("_carry"), F.lit("")), F.nullif(F.col("_inside"), F.lit("")))
    return rows.join(carry, spread).withColumn(name, F.nullif(F.right(both, F.lit(most)), F.lit(""))).drop("_inside", "_carry")
