"""Ranks and running sums inside groups of any size: a group is never in one task only.

Rows are range-partitioned by group and order, so a large group takes several partitions, in order. A row's rank is the number of
rows of its group in earlier partitions (a small table: groups by partitions) plus its rank within its own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... inside each group of ``by`` in the order given, which must be total."""
    placed = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    rows = placed.withColumn("_inside", inside).join(offsets, same)
    return rows.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(out))


def prefix(df: DataFrame, by: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The leading rows of every group whose running cost stays within the budget; adds ``used``. ``order`` is unique in a group.

    At most budget + 1 rows that cost something decide where a group ends, and Spark cuts to them before the shuffle.
    """
    rows = df.withColumn("_cost", cost)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    first = rows.where("_cost > 0").select(by, order, "_cost").withColumn("_nth", nth).where(F.col("_nth") <= budget + 1)
    run = F.sum("_cost").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = first.withColumn("_used", run).where(F.col("_used") > budget).groupBy(F.col(by).alias("_by")).agg(F.min(order).alias("_end"))
    kept = rows.join(ends, F.col(by).eqNullSafe(F.col("_by")), "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return kept.withColumn("used", run).select(*df.columns, "used")
