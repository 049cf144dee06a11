"""Running sums in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.storage import written


def _dealt(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """``df`` by ranges of (by, order), written, with the number of each row's range."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(width, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_before(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row, per ``by``, in the order of ``order``.

    Rows are dealt by ranges of (by, order) and written; sums run inside each range, and the sums of whole
    ranges before come from a table of one row a range. ``order`` must be total, else equal rows take any order.
    """
    dealt = _dealt(df, order, by)
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_head", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_sum")).drop("_sum")
    met = dealt.withColumn("_inside", F.sum(value).over(inside) - F.col(value)).join(sums.hint("merge"), [*by, "_range"])
    return met.withColumn(out, F.col("_head") + F.col("_inside")).drop("_head", "_inside", "_range")


def greatest_before(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "before") -> DataFrame:
    """Like ``running_before`` with the greatest ``value`` of the rows before; null for a group's first row."""
    dealt = _dealt(df, order, by)
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*by, "_range").agg(F.max(value).alias("_top"))
    tops = tops.withColumn("_head", F.max("_top").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    met = dealt.withColumn("_inside", F.max(value).over(inside)).join(tops.hint("merge"), [*by, "_range"])
    return met.withColumn(out, F.greatest("_head", "_inside")).drop("_head", "_inside", "_range")


def numbered(files: DataFrame, pages: str, order: list[str], start: Column, prefix: Column, digits: Column) -> DataFrame:
    """``files`` with ``first_no, last_no, first_label, last_label``: consecutive numbers by ``order`` within ``batch_id``."""
    from paperloom.functions.labels import format_label

    out = running_before(files, pages, order, ["batch_id"])
    out = out.withColumn("first_no", start + F.col("before")).withColumn("last_no", F.col("first_no") + F.col(pages) - 1).drop("before")
    return out.withColumn("first_label", format_label(prefix, F.col("first_no"), digits)).withColumn("last_label", format_label(prefix, F.col("last_no"), digits))
