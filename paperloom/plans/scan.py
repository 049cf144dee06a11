"""Pre-flight scan, searchability triage, and password resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import paths as P
from paperloom.operators.picks import last_by

FILE = ["batch_id", "path"]
# Limits and estimates of the scan.
SAMPLE_PAGES, MAX_PAGES = 10, 500
MIN_SAMPLE_CHARS, SEARCHABLE_RATIO = 50, 0.80
MIN_PAGE_CHARS = 20
PAGE_MB, FLOOR_MB, WARN_MB = 90, 30, 1800


def sample_pages(files: DataFrame) -> DataFrame:
    """(batch_id, path, page_no): all pages of short files, else ten spread evenly; pages beyond 500 do not count."""
    n = F.least(F.col("page_count"), F.lit(MAX_PAGES))
    spread = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PAGES - 1)), lambda i: (i * (F.col("_n") / SAMPLE_PAGES)).cast("int") + 1)
    every = F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)).cast("int"))
    rows = files.withColumn("_n", n).where("_n > 0")
    return rows.select(*FILE, F.explode(F.when(F.col("_n") <= SAMPLE_PAGES, every).otherwise(spread)).alias("page_no"))


def scan_files(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Per file: kind, size, pages, lock, whether it has a text layer, and the memory to recognize it.

    A locked PDF has no page count and no estimate. A PDF is searchable if 80 % of its sampled pages have 50 characters
    besides blanks and line ends.
    """
    kind = F.when(F.col("_ext").isin(*P.PDF), "pdf").when(F.col("_ext").isin(*P.SCAN_IMAGES), "image").otherwise("other")
    rows = files.withColumn("_ext", P.ext(F.col("path"))).withColumn("file_type", kind)
    locked = (F.col("file_type") == "pdf") & F.coalesce("is_locked", F.lit(False))
    rows = rows.withColumn("is_locked", locked).withColumn("page_count", F.when((F.col("file_type") == "pdf") & ~locked, F.least(F.col("page_count"), F.lit(MAX_PAGES))))
    sample = sample_pages(rows.where("file_type = 'pdf' and not is_locked").select(*FILE, "page_count"))
    good = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \n]", "")) >= MIN_SAMPLE_CHARS
    read = sample.join(pages.select(*FILE, F.col("page_no").cast("int").alias("page_no"), "text").hint("merge"), [*FILE, "page_no"], "left")
    ratio = read.groupBy(*FILE).agg(F.avg(good.cast("int")).alias("_ratio"))
    out = rows.join(ratio.hint("merge"), FILE, "left").withColumn("is_already_ocr", F.coalesce(F.col("_ratio") >= SEARCHABLE_RATIO, F.lit(False)))
    scan_pdf = (F.col("file_type") == "pdf") & ~F.col("is_locked") & ~F.col("is_already_ocr")
    est = F.when(scan_pdf, F.greatest(F.col("page_count") * PAGE_MB, F.lit(FLOOR_MB))).when(F.col("file_type") == "image", PAGE_MB).otherwise(0)
    return out.select(*FILE, "file_type", "size_bytes", "page_count", "is_locked", "is_already_ocr", est.cast("long").alias("estimated_ocr_mb"))


def manifest(scanned: DataFrame) -> DataFrame:
    """Totals of each batch and its warnings."""
    total = scanned.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("total_pages"), F.count_if("is_locked").alias("locked_count"),
        F.count_if("is_already_ocr").alias("already_ocr_count"), F.sum("estimated_ocr_mb").alias("estimated_mb"),
    )
    locked = F.when(F.col("locked_count") > 0, F.concat(F.col("locked_count").cast("string"), F.lit(" file(s) are password-protected")))
    heavy = F.when(F.col("estimated_mb") > WARN_MB, F.concat(F.lit("recognition may need "), F.col("estimated_mb").cast("string"), F.lit(" MB")))
    return total.withColumn("warnings", F.filter(F.array(locked, heavy), lambda w: w.isNotNull()))


def searchable(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(batch_id, path, searchable): whether every page of a readable PDF has 20 characters besides blanks, tabs and line ends."""
    full = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \n\t]", "")) >= MIN_PAGE_CHARS
    every = pages.groupBy(*FILE).agg(F.every(full).alias("_all"))
    pdfs = files.where(P.ext(F.col("path")).isin(*P.PDF))
    out = pdfs.join(every.hint("merge"), FILE, "left")
    readable = F.col("read_error").isNull() & ~F.coalesce("is_locked", F.lit(False))
    return out.select(*FILE, (readable & F.coalesce("_all", F.lit(False))).alias("searchable"))


def passwords(files: DataFrame, given: DataFrame, mode: str = "per_file", all_password: str | None = None, fall_back: bool = False) -> DataFrame:
    """(batch_id, path, password, password_source): a file's password by path, else name, else stem.

    ``given``: batch_id, ord, filename, password; of equal names the last counts; an empty password is none. ``mode`` is
    ``all``, ``per_file`` or ``none``; with ``fall_back`` files without an own password take ``all_password``.
    """
    rows = files.select(*FILE)
    whole = F.nullif(F.lit(all_password or ""), F.lit(""))
    if mode != "per_file":
        use = whole if mode == "all" else F.lit(None).cast("string")
        return rows.withColumn("password", use).withColumn("password_source", F.when(use.isNotNull(), "all").otherwise("none"))
    table = last_by(given, ["batch_id", "filename"], "ord").where("password <> ''")
    out = rows
    keys = (("path", F.col("path")), ("basename", P.filename(F.col("path"))), ("stem", P.stem(F.col("path"))))
    for name, key in keys:
        side = table.select("batch_id", F.col("filename").alias("_k"), F.col("password").alias(f"_{name}"))
        out = out.withColumn("_k", key).join(side.hint("merge"), ["batch_id", "_k"], "left").drop("_k")
    found = F.coalesce(*[F.col(f"_{n}") for n, _ in keys])
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in keys])
    rest = whole if fall_back else F.lit(None).cast("string")
    return out.select(*FILE, F.coalesce(found, rest).alias("password"), F.coalesce(source, F.when(rest.isNotNull(), "all"), F.lit("none")).alias("password_source"))
