"""Samples, caps and batches in an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import stored


def first_samples(rows: DataFrame, by: str, value: str, order: str, k: int) -> DataFrame:
    """The first ``k`` distinct values of each group in arrival order, joined."""
    seen = rows.groupBy(by, value).agg(F.min(order).alias("at"))
    top = seen.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("at", value))).filter(F.col("r") <= k)
    return top.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", value))), lambda x: x[value].cast("string")), ",").alias("samples"))


def cap_per_group(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """Rows with their rank in the group and whether they are beyond ``most``; none goes."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("truncated", F.col("rank") > most)


def fixed_batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("bigint"))


def sampled_roots(rows: DataFrame, by: list[str], sample: str, order: str, k: int) -> DataFrame:
    """Per group its rows (``hits``), distinct samples, and the first ``k`` of these in arrival order.

    Samples are combined before they are counted; only the first ``k`` of a map task are ranked, so no group is gathered whole.
    """
    seen = rows.groupBy(*by, sample).agg(F.count("*").alias("c"), F.min(order).alias("at"))
    counts = seen.groupBy(*by).agg(F.sum("c").alias("hits"), F.count("*").alias("distinct_samples"))
    ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("at", sample))).filter(F.col("r") <= k)
    top = F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(sample).cast("string").alias("s")))), lambda x: x.s)
    return counts.join(ranked.groupBy(*by).agg(F.array_join(top, ",").alias("samples")), by)


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with their place (from 1) in a total order of the whole table.

    Rows are dealt into ranges of the order and numbered inside their range; the rows of the ranges before are added, of
    which a table with one row for each range tells. The numbered ranges are stored, as they must not change in between.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_at", 33)), "ranges")
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(before), "_part").withColumn(name, place).drop("_part", "_at", "_before")
