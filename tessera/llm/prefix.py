"""Running totals within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Buckets of a group's rows. They decide on the order of rows, so their number does not follow from any setting of a session.
BUCKETS = 1024


def spread_width(spark: SparkSession) -> int:
    """How many partitions work is dealt to that results do not depend on."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(rows: DataFrame, group: str, order: list[str], amount: Column, out: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` over the rows before it in its ``group``, as a long.

    Rows of a group are summed within ``buckets`` hash buckets of their ``order`` columns, and a bucket starts
    where the buckets before it end; so no task holds a group, and only totals per group and bucket
    meet. Buckets come in the order of their numbers; rows equal in ``order`` may change places.
    """
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_amount", amount.cast("long"))
    totals = placed.groupBy(group, "_bucket").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_of")))
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_amount", "_group", "_of", "_start", "_inside")
    )
