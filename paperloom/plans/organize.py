"""Filing by year: from the name, else the metadata, else the first page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import paths as P
from paperloom.operators.collisions import free_names
from paperloom.operators.storage import written

FILE = ["batch_id", "path"]
# Fixed value: how the reason starts where a PDF's content gave no year.
FAILED = "all-methods-failed:content-content-"


def with_year(files: DataFrame, pages: DataFrame | None = None, low: int = 1900, high: int = 2099, policy: str = "first") -> DataFrame:
    """``files`` with ``year, method, reason``; method is filename, metadata, content or none.

    ``files``: batch_id, ord, path, mod_date, creation_date; ``pages``: batch_id, path, page_no, text. Only PDFs have metadata
    and content; only PDFs undecided so far are joined with their first page. Unknown policies act as ``first``.
    """
    bare = F.when(F.col("path").rlike("19|20"), D.without_label(P.filename(F.col("path"))))
    rows = files.withColumn("_name", bare).withColumn("_hit", D.year_of(F.col("_name"), low, high, policy)).drop("_name").withColumn("_pdf", P.ext(F.col("path")) == ".pdf")
    rows = rows.withColumns({"_mod": F.when(F.col("_pdf"), D.pdf_date_year(F.col("mod_date"))), "_made": F.when(F.col("_pdf"), D.pdf_date_year(F.col("creation_date")))})
    mod, made = F.col("_mod"), F.col("_made")
    use_mod = F.coalesce(mod.between(low, high), F.lit(False))
    meta = F.when(F.col("_pdf"), F.when(use_mod, mod).when(made.between(low, high), made))
    source = F.when(use_mod, F.concat(F.lit("metadata-ModDate:"), F.col("mod_date"))).otherwise(F.concat(F.lit("metadata-CreationDate:"), F.col("creation_date")))
    place = lambda c: F.concat(F.lit("pattern"), c["pattern"].cast("string"), F.lit("@("), c["start"].cast("string"), F.lit(", "), c["end"].cast("string"), F.lit(")"))
    rows = rows.withColumn("_meta", meta).withColumn("year", F.coalesce(F.col("_hit.year"), F.col("_meta")))
    rows = rows.withColumn("method", F.when(F.col("_hit").isNotNull(), "filename").when(F.col("_meta").isNotNull(), "metadata"))
    rows = rows.withColumn("reason", F.when(F.col("_hit").isNotNull(), place(F.col("_hit"))).when(F.col("_meta").isNotNull(), source)).drop("_hit", "_meta", "_mod", "_made")
    rows = rows.withColumn("method", F.when(F.col("method").isNull() & ~F.col("_pdf"), "none").otherwise(F.col("method")))
    rows = rows.withColumn("reason", F.when(F.col("method") == "none", "all-methods-failed:non-pdf-no-content-scan").otherwise(F.col("reason")))
    if pages is None:
        return rows.withColumns({"reason": F.coalesce("reason", F.lit(f"{FAILED}no-text-extracted")), "method": F.coalesce("method", F.lit("none"))}).drop("_pdf")
    open_ = rows.where("method is null")
    front = pages.where("page_no = 1").select(*FILE, F.col("text").alias("_text"))
    open_ = open_.join(front.hint("merge"), FILE, "left")
    found = D.year_of(F.col("_text"), low, high, policy, by_place=True)
    blank = F.trim(F.regexp_replace(F.coalesce("_text", F.lit("")), r"(?U)\s+", " ")) == ""
    open_ = open_.withColumn("_hit", found).withColumn("year", F.col("_hit.year")).withColumn("method", F.when(F.col("_hit").isNotNull(), "content").otherwise("none"))
    said = F.concat(F.lit("content-pattern"), F.col("_hit.pattern").cast("string"), F.lit("@pos"), F.col("_hit.start").cast("string"))
    none = F.when(blank, f"{FAILED}no-text-extracted").otherwise(f"{FAILED}no-year-found")
    open_ = open_.withColumn("reason", F.when(F.col("_hit").isNotNull(), said).otherwise(none)).drop("_hit", "_text")
    return rows.where("method is not null").unionByName(open_).drop("_pdf")


def organized(files: DataFrame, pages: DataFrame | None = None, low: int = 1900, high: int = 2099, policy: str = "first", unknown: str = "Unknown") -> DataFrame:
    """``files`` with year, method, reason, ``folder`` and ``placed``, the free name in the folder."""
    rows = with_year(files, pages, low, high, policy)
    rows = rows.withColumn("folder", F.coalesce(F.col("year").cast("string"), F.lit(unknown))).withColumn("name", P.filename(F.col("path")))
    # The names of a folder are read twice, the years' patterns should not be.
    return free_names(written(rows, "years"))


def folder_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("batch_id", "folder").agg(F.count(F.lit(1)).alias("files"))
