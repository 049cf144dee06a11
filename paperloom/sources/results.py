"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sidecar_json(records: DataFrame) -> DataFrame:
    """(batch_id, content): a batch's label records (batch_id, ord, ...) as one JSON list in order.

    A batch is one row: at about 100 bytes a record, some millions of records. ``write_json`` has no such bound.
    """
    fields = [c for c in records.columns if c not in ("batch_id", "ord")]
    ordered = F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("r"))))
    return records.groupBy("batch_id").agg(F.to_json(F.transform(ordered, lambda x: x["r"])).alias("content"))


def write_json(rows: DataFrame, path: str) -> None:
    """Records of any size, one a line, over as many files as there are tasks."""
    rows.write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str, place: str = "place", batches: DataFrame | None = None) -> None:
    """One JSON array a batch, of the rows in the order of ``place`` (from 0 without gaps in each batch), over as many files as there are ranges.

    A batch's folder holds text files; one after the other, by name, they are its array, an entry a line. Entries have all columns but
    batch_id and ``place``. Batches of ``batches`` without rows get an empty array.
    """
    entry = F.to_json(F.struct(*[c for c in rows.columns if c not in ("batch_id", place)]), {"ignoreNullFields": "false"})
    lines = rows.select("batch_id", F.col(place).cast("long").alias("_at"), F.concat(F.when(F.col(place) > 0, ",").otherwise(""), entry).alias("value"))
    counted = lines.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    if batches is not None:
        counted = batches.select("batch_id").distinct().join(counted.hint("merge"), "batch_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ends = counted.select("batch_id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("_at"), F.lit("[").alias("value")), F.struct(F.col("_n").alias("_at"), F.lit("]").alias("value")))).alias("e"))
    lines = lines.unionByName(ends.select("batch_id", "e.*"))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(width, "batch_id", "_at").sortWithinPartitions("batch_id", "_at").drop("_at").write.mode("overwrite").partitionBy("batch_id").text(path)


def read_json_array(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(batch_id, and the fields of ``kind``) of arrays that ``write_json_array`` wrote; order is not kept."""
    lines = spark.read.schema("value string, batch_id string").text(path).where("value not in ('[', ']')")
    return lines.select("batch_id", F.from_json(F.ltrim(F.col("value"), F.lit(",")), kind).alias("e")).select("batch_id", "e.*")


def write_by_folder(rows: DataFrame, path: str, folder: str = "folder") -> None:
    """Rows below a folder for each value, as organized files are."""
    rows.write.mode("overwrite").partitionBy(folder).parquet(path)


def write_sheet(sheet: DataFrame, path: str) -> None:
    """Index rows in order of their numbers, as CSV."""
    sheet.orderBy("batch_id", "row_no").write.mode("overwrite").option("header", True).csv(path)


def deliverable(files: DataFrame, **extra: DataFrame) -> DataFrame:
    """(batch_id, entry_name, kind): what a batch's package holds; ``extra`` are tables with batch_id and entry_name."""
    out = files.select("batch_id", F.col("path").alias("entry_name"), F.lit("file").alias("kind"))
    for kind, df in extra.items():
        out = out.unionByName(df.select("batch_id", "entry_name").distinct().withColumn("kind", F.lit(kind)))
    return out
