"""Rows picked from groups with stated ties: modes, first and last, prioritized lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.storage import written


def mode(rows: DataFrame, by: list[str], value: str, place: Column, first: Column | None = None) -> DataFrame:
    """(by, value): the most frequent value of each group; of equal ones the one seen first by ``place``.

    Values where ``first`` holds come before all others, and count by themselves.
    """
    preferred = (F.lit(1) if first is None else first.cast("int")).alias("_class")
    counted = rows.select(*by, value, preferred, place.alias("_place")).groupBy(*by, value, "_class").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_at"))
    best = F.max_by(value, F.struct(F.col("_class"), F.col("_n"), (-F.col("_at")).alias("_early"))).alias(value)
    return counted.groupBy(*by).agg(best) if by else counted.agg(best)


def last_by(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``: a later row of a key replaces an earlier one."""
    pick = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_pick", pick).where("_pick = 1").drop("_pick")


def lookup_table(records: DataFrame, keys: list[tuple[Column, bool]], values: list[str], order: str, by: list[str]) -> DataFrame:
    """(by, key, values) of records under several keys each.

    ``keys`` lists (key, overwrites) in falling priority. Keys that overwrite beat all others, and of them the last
    record wins; of others the first record does, in the order of records, then keys. Null and empty keys are none.
    """
    entries = F.array(*[F.struct(k.alias("key"), F.lit(over).alias("over"), F.lit(i).alias("at")) for i, (k, over) in enumerate(keys)])
    rows = records.select(*by, *values, F.col(order).alias("_ord"), F.explode(entries).alias("_e")).where("_e.key is not null and _e.key <> ''")
    rank = F.struct(F.col("_e.over").cast("int"), F.when(F.col("_e.over"), F.col("_ord")).otherwise(-F.col("_ord")), -F.col("_e.at"))
    picked = rows.groupBy(*by, F.col("_e.key").alias("key")).agg(F.max_by(F.struct(*values), rank).alias("_v"))
    return picked.select(*by, "key", *[F.col(f"_v.{v}").alias(v) for v in values])


def lookup(probe: DataFrame, table: DataFrame, keys: list[Column], values: list[str], by: list[str]) -> DataFrame:
    """``probe`` with the values of the first of its ``keys`` that the table has, and ``found``, the key's number from 1.

    The first key that is there wins even if its values are empty; without any, values and ``found`` are null.
    ``table`` is read once a key, so it should be a written one.
    """
    out, met = probe, []
    for i, k in enumerate(keys):
        side = table.select(*[F.col(b).alias(f"_b{j}") for j, b in enumerate(by)], F.col("key").alias("_k"), F.struct(*values).alias("_v"))
        on = [F.col(b).eqNullSafe(F.col(f"_b{j}")) for j, b in enumerate(by)] + [k == F.col("_k")]
        out = out.join(side.hint("merge"), on, "left").drop("_k", *[f"_b{j}" for j in range(len(by))])
        if i + 1 < len(keys):  # what is found does not meet the other keys
            out = written(out, "probed")
            met.append(out.where("_v is not null").withColumn("found", F.lit(i + 1)))
            out = out.where("_v is null").drop("_v")
    out = out.withColumn("found", F.when(F.col("_v").isNotNull(), F.lit(len(keys))))
    for m in met:
        out = out.unionByName(m)
    return out.withColumns({v: F.col("_v")[v] for v in values}).drop("_v")
