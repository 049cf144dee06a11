"""Discovery index: labels of files by the batch's best source, dates, order, and sheet layout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import labels as L
from paperloom.functions import paths as P
from paperloom.operators.numbering import running_before
from paperloom.operators.picks import lookup, lookup_table
from paperloom.operators.storage import joined_small, written

LABELS = ["first_label", "last_label"]
# The sheet's header and the name of the group without one.
HEADER = ("Date Produced", "Category & Documents provided", "Bated labels")
NO_CATEGORY = "Uncategorized"
FIRST_ROW = 4


def sidecar_table(records: DataFrame) -> DataFrame:
    """Lookup of a sidecar's records (batch_id, ord, path, rel_dir, filename, first_label, last_label) by path, else names.

    A path's last record beats all; folder with name, and the bare name, go to the first record.
    """
    last = F.coalesce(F.nullif(F.col("last_label"), F.lit("")), F.col("first_label"))
    rows = records.withColumn("first_label", F.coalesce("first_label", F.lit(""))).withColumn("last_label", F.coalesce(last, F.lit("")))
    has_path = F.coalesce(F.col("path"), F.lit("")) != ""
    whole = F.when(~has_path & (F.coalesce(F.col("rel_dir"), F.lit("")) != ""), P.norm_key(F.concat_ws("/", "rel_dir", "filename")))
    keys = [(F.when(has_path, P.norm_key(F.col("path"))), True), (whole, False), (P.norm_key(F.col("filename")), False)]
    return lookup_table(rows, keys, LABELS, "ord", ["batch_id"])


def metadata_table(meta: DataFrame) -> DataFrame:
    """Lookup of a client's metadata (batch_id, ord, name, path, bates_range): by path the last, by name the first."""
    r = L.split_range(F.col("bates_range"))
    rows = meta.withColumn("first_label", r["first"]).withColumn("last_label", r["last"])
    return lookup_table(rows, [(P.norm_key(F.col("path")), True), (P.norm_key(F.col("name")), False)], LABELS, "ord", ["batch_id"])


def index_rows(
    files: DataFrame, records: DataFrame | None = None, meta: DataFrame | None = None, detected: DataFrame | None = None, default_date: dt.date = dt.date(2000, 1, 1), also: tuple[str, ...] = ()
) -> DataFrame:
    """A row a file (batch_id, ord, path, and the columns ``also``): labels, range, date produced.

    A batch takes its labels from its sidecar if there is one, else from the client's metadata, else from detection;
    the choice is the batch's, not the row's. Junk and the engine's own files are left out.
    """
    rows = files.where(~P.is_junk(F.col("path")) & ~P.is_sidecar(F.col("path"))).select("batch_id", "ord", "path", *also)
    rows = rows.withColumn("rel_dir", P.rel_dir(F.col("path"))).withColumn("filename", P.filename(F.col("path"))).withColumn("category", P.category(F.col("path")))
    none = F.lit("")
    out = rows.withColumns({"first_label": none, "last_label": none})
    sources = [(n, t) for n, t in ((1, records), (2, meta), (3, detected)) if t is not None]
    if sources:
        out = _labeled(rows, sources).select(*rows.columns, *[F.coalesce(c, none).alias(c) for c in LABELS])
    out = out.withColumn("bates_range", L.bates_range(F.col("first_label"), F.col("last_label")))
    return out.withColumn("date_produced", D.date_produced(F.col("rel_dir"), F.col("filename"), default_date))


def _labeled(rows: DataFrame, sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` with the labels of their batch's source, the least number that has the batch: 1 records, 2 metadata, 3 detection. A row meets that source only."""
    each = None
    for n, table in sources:
        part = table.select("batch_id").distinct().withColumn("_source", F.lit(n))
        each = part if each is None else each.unionByName(part)
    # One row a batch: sent to all tasks while batches are few, so that a large batch is not one task's.
    source = written(each.groupBy("batch_id").agg(F.min("_source").alias("_source")), "batches")
    rows = written(joined_small(rows, source, ["batch_id"], "left"), "sourced")  # read for each source

    def own(n: int, table: DataFrame) -> DataFrame:
        return joined_small(table, source.where(F.col("_source") == n), ["batch_id"], "left_semi") if len(sources) > 1 else table

    none = F.lit(None).cast("string")
    out = rows.where("_source is null").withColumns({c: none for c in LABELS})
    keyed = None
    for n, table in sources:
        if n == 3:
            side = own(n, table).select("batch_id", "path", *LABELS)
            out = out.unionByName(rows.where("_source = 3").join(side.hint("merge"), ["batch_id", "path"], "left"))
        else:
            part = sidecar_table(own(n, table)) if n == 1 else metadata_table(own(n, table))
            keyed = part if keyed is None else keyed.unionByName(part)
    if keyed is not None:  # each batch is in one of both
        probe = [P.norm_key(F.col("path")), P.norm_key(F.col("filename"))]
        out = out.unionByName(lookup(rows.where("_source < 3"), written(keyed, "keys"), probe, LABELS, ["batch_id"]).drop("found"))
    return out


def sheet(rows: DataFrame) -> DataFrame:
    """(batch_id, row_no, row_type, date_text, text, bates) of the index sheet.

    The header is row 3. Per category, in order: its own row, its documents by name, a blank row. Row numbers come from
    counts: files of a category by prefix sums over ranges, categories of a batch in a window.
    """
    rows = written(rows, "index")  # read for the ranges, the groups and the header
    named = running_before(rows.withColumn("_one", F.lit(1)), "_one", ["filename", "ord"], ["batch_id", "category"]).withColumn("_at", F.col("before") + 1)
    groups = rows.groupBy("batch_id", "category").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("batch_id").orderBy("category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("_head", F.sum(F.col("_n") + 2).over(before) - F.col("_n") - 2 + FIRST_ROW)
    groups = written(groups, "categories")
    docs = joined_small(named, groups, ["batch_id", "category"], "inner").select(
        "batch_id", (F.col("_head") + F.col("_at")).alias("row_no"), F.lit("document").alias("row_type"), F.col("date_produced").cast("string").alias("date_text"), F.col("filename").alias("text"), F.col("bates_range").alias("bates")
    )
    blank = F.lit("")
    title = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(NO_CATEGORY))
    heads = groups.select("batch_id", F.col("_head").alias("row_no"), F.lit("category").alias("row_type"), blank.alias("date_text"), title.alias("text"), blank.alias("bates"))
    ends = groups.select("batch_id", (F.col("_head") + F.col("_n") + 1).alias("row_no"), F.lit("blank").alias("row_type"), blank.alias("date_text"), blank.alias("text"), blank.alias("bates"))
    top = groups.select("batch_id").distinct().select("batch_id", F.lit(FIRST_ROW - 1).cast("long").alias("row_no"), F.lit("header").alias("row_type"), *[F.lit(h).alias(c) for h, c in zip(HEADER, ("date_text", "text", "bates"), strict=True)])
    return docs.unionByName(heads).unionByName(ends).unionByName(top)


def by_range(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Rows in the order of the first number of their range; rows without one last, or first if descending."""
    n = L.order_number(F.col("bates_range"))
    return rows.orderBy(n.desc_nulls_first() if descending else n.asc_nulls_last(), "ord")


def range_ranks(rows: DataFrame, by: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with ``rank``, from 1, their place in the order of ``by_range`` within each group of ``by``; groups may be few and large."""
    n = L.order_number(F.col("bates_range"))
    key = F.coalesce(-n if descending else n, F.lit(-(1 << 62) if descending else 1 << 62))
    # Ranges are drawn from a sample, for which the rows would be made twice.
    rows = written(rows.withColumn("_key", key), "keyed")
    out = running_before(rows.withColumn("_one", F.lit(1)), "_one", ["_key", "ord"], by)
    return out.withColumn("rank", F.col("before") + 1).drop("_key", "_one", "before")
