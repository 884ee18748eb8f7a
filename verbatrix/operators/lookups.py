"""Helpers of operators that would otherwise need a product or one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.sources import shared


def runs_with(runs: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, run): which of the distinct words ``runs`` (run) contain which of
    ``needles`` (needle). They meet by the needle's first three characters, or all of a
    shorter one; needles of one or two characters meet words that have them."""
    short = needles.select("needle", F.substring("needle", 1, 3).alias("gram")).where("gram <> ''").distinct()
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("run") - (n - 1))), lambda i: F.substring("run", i, F.lit(n)))
    grams = runs.select("run").distinct().select("run", F.explode(F.array_distinct(F.concat(parts(1), parts(2), parts(3)))).alias("gram"))
    return short.join(grams, "gram").where(F.col("run").contains(F.col("needle"))).select("needle", "run")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with the running number ``number`` and running sums (new name: column)
    in an order over all rows. Rows are range partitioned and summed within their
    partition; what lies before a partition comes from one row for each."""
    spark = df.sparkSession
    parted = shared.written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    of = {"number": F.lit(1), **{name: F.col(c) for name, c in sums.items()}}
    totals = parted.groupBy("__part").agg(*[F.sum(c).alias(name) for name, c in of.items()])
    # as many rows as partitions
    starts = totals.select("__part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__{name}") for name in of])
    own = parted.withColumns({name: F.sum(c).over(within) for name, c in of.items()})
    return own.join(F.broadcast(starts), "__part").withColumns({name: F.col(name) + F.col(f"__{name}") for name in of}).drop("__part", *[f"__{name}" for name in of])
