"""Numbering rows in a global order without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_dir, staged

#: Ranges that the rows are cut into.
RANGES = 200


def before(df: DataFrame, key: str, amount: Column, *then: str) -> DataFrame:
    """df with `before`: the sum of amount over all rows that come earlier in order of key (a number), then the other columns.

    Rows are cut at RANGES approximate quantiles of the key. A range's rows are summed by a window of its own, and what
    the ranges before it hold is a window over RANGES sums. Equal keys share a range, so the order is that of one sort.
    """
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("__cuts"))
    cuts = staged(cuts, new_dir(df.sparkSession, "cuts"))  # approximate, and read twice: both must see the same
    cut = F.size(F.filter("__cuts", lambda c: c < F.col(key).cast("double")))
    x = df.withColumn("__amount", amount).join(F.broadcast(cuts)).withColumn("__range", cut).drop("__cuts")  # one row is broadcast
    sums = x.groupBy("__range").agg(F.sum("__amount").alias("__sum"))  # RANGES rows at most
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(key, *then).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    return x.join(F.broadcast(sums), "__range").withColumn("before", (F.col("__base") + F.col("__inside")).cast("long")).drop("__range", "__amount", "__inside", "__base")


def numbered(df: DataFrame, key: str, *then: str, name: str = "n") -> DataFrame:
    """df with its rows numbered from 1 in order of key (a number), then the other columns."""
    return before(df, key, F.lit(1), *then).withColumn(name, (F.col("before") + 1).cast("int")).drop("before")
