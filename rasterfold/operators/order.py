"""Places, running totals and order statistics over all rows, without one task that sorts them all."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.operators.keep import kept


def running(df: DataFrame, order: list[str], out: str, weight: Column | None = None) -> DataFrame:
    """Adds out: the sum of weight (1 if not given) over the rows before this one in `order`, nulls first.

    Rows are dealt into ranges of the order; each range is summed by itself and starts after the sum of those before it. The driver sees
    one number a range. Rows that are equal in `order` lie in one range and follow each other in any order.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    dealt = kept(weighed.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sums = sorted(dealt.groupBy("_range").agg(F.sum("_weight")).collect())
    before = [0, *accumulate(s for _, s in sums)]
    starts = df.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sums, before)], "_range int, _start long")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(out, F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return placed.join(F.broadcast(starts), "_range").withColumn(out, F.col(out) + F.col("_start")).select(*df.columns, out)


def numbered(df: DataFrame, order: list[str], out: str, keys: list[str] | None = None) -> DataFrame:
    """Adds out: the place from 0 in `order`, within each of the keys; a key may hold any share of the rows and may be null."""
    if not keys:
        return running(df, order, out)
    placed = running(df, [*keys, *order], out)
    firsts = placed.groupBy(*keys).agg(F.min(out).alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return placed.join(firsts, same).withColumn(out, F.col(out) - F.col("_first")).select(*df.columns, out)


def order_statistic(df: DataFrame, value: str, index: Callable[[Column], Column], tie: list[str]) -> DataFrame:
    """stat: the element at the 0-based place index(n) of all n values in ascending order; no row without values."""
    placed = numbered(df.select(value, *tie), [value, *tie], "_place").withColumn("_all", F.lit(0))
    counted = placed.groupBy("_all").agg(F.count("*").alias("_n"))
    return placed.join(F.broadcast(counted), "_all").filter(F.col("_place") == index(F.col("_n"))).select(F.col(value).alias("stat"))
