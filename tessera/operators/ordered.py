"""Orders over all rows of a table, without one task that holds them: ranges are cut first, and only their totals meet."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(rows: DataFrame, by: str, ranges: int = 32, drawn: int = 64) -> DataFrame:
    """``rows`` with ``_range`` (int, in the order of ``by``; nulls first): equal values are in one range.

    Ranges are cut at values drawn by a hash, ``drawn`` for each, which is all that reaches the driver. Where they are cut decides on
    the work of tasks only, never on a result.
    """
    values = sorted(r[0] for r in rows.select(by).where(F.col(by).isNotNull()).distinct().orderBy(F.xxhash64(by)).limit(ranges * drawn).collect())
    cuts = [values[len(values) * i // ranges] for i in range(1, ranges)] if len(values) >= ranges else values
    # the number of cuts below a value, by halving: a handful of comparisons a row
    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(by) <= F.lit(cuts[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    return rows.withColumn("_range", F.when(F.col(by).isNull(), -1).otherwise(place(0, len(cuts))).cast("int"))


def running(rows: DataFrame, by: str, agg, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``agg`` (F.min, F.max or F.sum) of ``value`` over the rows up to each in the order of ``by``, its own included."""
    cut = in_ranges(rows, by)
    up_to = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy("_range").agg(agg(value).alias("_total"))
    earlier = totals.alias("a").join(totals.alias("b"), F.col("b._range") < F.col("a._range")).groupBy("a._range").agg(agg("b._total").alias("_earlier"))  # a row a range
    both = {F.min: F.least, F.max: F.greatest, F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[agg]
    own = cut.withColumn(out, agg(value).over(up_to)).join(earlier, "_range", "left")
    return own.withColumn(out, both(F.col(out), F.col("_earlier"))).drop("_range", "_earlier")


def numbered(rows: DataFrame, by: str, out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, ... in the order of ``by``."""
    counted = running(rows.withColumn("_one", F.lit(1).cast("long")), by, F.sum, "_one", out)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


def with_next(rows: DataFrame, by: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the value of ``by`` in the row after each; the first after the last."""
    cut = in_ranges(rows, by)
    firsts = cut.groupBy("_range").agg(F.min(by).alias("_first"))
    behind = firsts.alias("a").join(firsts.alias("b"), F.col("b._range") > F.col("a._range"), "left").groupBy("a._range").agg(F.min("b._first").alias("_behind"))  # a row a range
    first = firsts.agg(F.min("_first").alias("_least"))
    ahead = F.lead(by).over(Window.partitionBy("_range").orderBy(by))
    found = cut.withColumn(out, ahead).join(behind, "_range", "left").join(F.broadcast(first))
    return found.withColumn(out, F.coalesce(out, "_behind", "_least")).drop("_range", "_behind", "_least")
