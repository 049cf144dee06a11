"""Page labels: detection, continuation of numbering, assignment, filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import labels as L
from paperloom.functions import paths as P
from paperloom.operators.numbering import greatest_before, numbered, running_before
from paperloom.operators.picks import last_by, mode
from paperloom.operators.storage import joined_small, written

#: Share of a page's height, at its foot, where labels stand.
MARGIN = 0.12
FILE = ["batch_id", "path"]
# Fixed value: the reason given for a locked file.
LOCKED = "Password-protected — run Unlock first"


def margin_blocks(blocks: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Text blocks in the foot of a PDF's page, and all of an image; other kinds have none."""
    kind = P.ext(F.col("path"))
    foot = kind.isin(*P.PDF) & (F.col("y0") >= F.col("page_height") * (1 - margin))
    return blocks.where((F.col("block_type") == 0) & (F.trim("text") != "") & (foot | kind.isin(*P.LABEL_IMAGES)))


def detect(blocks: DataFrame, files: DataFrame, extra: tuple[str, ...] = (), profile: str = "margin") -> DataFrame:
    """(batch_id, path, first_label, last_label) of every file; empty where no label is found.

    ``blocks`` (batch_id, path, page_no, block_no, block_type, y0, page_height, text) are read from the first and last
    page of each of ``files`` (batch_id, path, page_count). The file's prefix is the most frequent one of zero-padded
    numbers, else of all, words that are no prefixes left out; of equal ones the first. Without any, zero-padded
    numbers by themselves count. An image is read whole and has one label, the first; other kinds have none. With ``profile='browser'`` whole pages are read and there is no such fallback.
    """
    nos = [*L.NO_PREFIXES, *(x.strip().upper() for x in extra if x.strip())]
    near = margin_blocks(blocks) if profile == "margin" else blocks.where((F.col("block_type") == 0) & P.ext(F.col("path")).isin(*P.PDF, *P.LABEL_IMAGES))
    # Both kinds of labels have six digits in a row.
    near = near.where(F.col("text").rlike(r"(?U)\d{6}")).select(*FILE, F.col("page_no").cast("int").alias("page_no"), "block_no", F.upper("text").alias("up"))
    ends = files.select(*FILE, F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)).cast("int").alias("_last"))
    text = near.join(ends.hint("merge"), FILE).where("page_no = 1 or page_no = _last")
    pattern = L.CANDIDATE if profile == "margin" else L.BROWSER_CANDIDATE
    part = lambda p, k: F.regexp_extract_all("up", F.lit(p), F.lit(k))
    zipped = F.arrays_zip(part(pattern, 1).alias("word"), part(pattern, 2).alias("num"), *([part(L.BARE, 1).alias("bare")] if profile == "margin" else []))
    # An outer explode: an inner one gets a filter that matches all patterns once more.
    rows = text.select(*FILE, "page_no", "_last", "block_no", F.posexplode_outer(zipped).alias("pos", "c")).where("c is not null")
    bare = F.when(F.col("c.bare").try_cast("long") > 0, F.col("c.bare")) if profile == "margin" else F.lit(None).cast("string")
    rows = rows.select(*FILE, "page_no", "_last", "block_no", "pos", L.normalize_prefix(F.col("c.word")).alias("prefix"), F.col("c.num").alias("num"), bare.alias("bare"))
    usable = ~F.col("prefix").isin(*nos) if profile == "margin" else ~F.col("prefix").isin(*nos) & (F.length("prefix") >= 2)
    rows = rows.withColumn("prefix", F.when(usable, F.col("prefix"))).where("prefix is not null or bare is not null")
    sides = F.when((F.col("page_no") == 1) & (F.col("_last") == 1), F.array(F.lit(0), F.lit(1))).when(F.col("page_no") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    rows = rows.select(*FILE, "block_no", "pos", "prefix", "num", "bare", F.explode_outer(sides).alias("side"))
    rows = rows.withColumn("at", F.col("side") * 1e12 + F.col("block_no") * 1e6 + F.col("pos")).withColumn("zp", F.coalesce(L.is_zero_padded(F.col("num")), F.lit(False)))
    token = F.concat_ws(" ", "prefix", "num")
    # The first label stands on the first page if that has any, the last one likewise; zero-padded ones come first.
    pick = lambda best, back: F.max_by(token, F.struct(F.col("side") == best, F.col("zp"), (F.col("at") if back else -F.col("at"))))
    last = F.coalesce(F.min_by(F.when(F.col("side") == 1, token), F.when(F.col("side") == 1, F.struct(~F.col("zp"), F.col("at")))), pick(0, True))
    # Of each prefix how often and where it stands, zero-padded or, if it never is, at all; and the labels that the file has if the prefix is its own.
    of = F.max("zp")
    count, place = F.count_if("zp"), F.min(F.when(F.col("zp"), F.col("at")))
    rank = F.struct(of.alias("zp"), F.when(of, count).otherwise(F.count(F.lit(1))).alias("n"), -F.when(of, place).otherwise(F.min("at")))
    has_bare = F.col("bare").isNotNull()
    plain = lambda f: f(F.when(has_bare, F.struct("at", "bare")))
    each = rows.groupBy(*FILE, "prefix").agg(rank.alias("rank"), pick(0, False).alias("a"), last.alias("b"), plain(F.min).alias("low"), plain(F.max).alias("high"))
    best = F.max_by(F.struct("a", "b"), F.when(F.col("prefix").isNotNull(), F.col("rank")))
    found = each.groupBy(*FILE).agg(best.alias("own"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.select(*FILE, F.coalesce("own", F.struct(F.col("low.bare").alias("a"), F.col("high.bare").alias("b"))).alias("l")).select(*FILE, "l.a", "l.b")
    number = lambda c: F.regexp_extract(c, r"(\d{6,10})$", 1).try_cast("long")
    swap = F.coalesce(number(F.col("b")) < number(F.col("a")), F.lit(False))
    found = found.select(*FILE, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("first_label"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("last_label"))
    image = P.ext(F.col("path")).isin(*P.LABEL_IMAGES)
    found = found.withColumn("last_label", F.when(image, F.col("first_label")).otherwise(F.col("last_label")))
    out = files.select(*FILE).join(found.hint("merge"), FILE, "left")
    return out.select(*FILE, F.coalesce("first_label", F.lit("")).alias("first_label"), F.coalesce("last_label", F.lit("")).alias("last_label"))


def continuation(found: DataFrame, user_prefix: str, user_start: int) -> DataFrame:
    """(batch_id, n_labeled, prefix, start): how numbering goes on, from (batch_id, ord, first_label, last_label).

    The prefix is the most frequent one of all first and last labels, of equal ones the first in order, and may be
    empty; the start follows the largest last number. A batch without labels goes on as the user says.
    """
    rows = found.where("first_label <> ''").withColumn("last_label", F.coalesce(F.nullif(F.col("last_label"), F.lit("")), F.col("first_label")))
    rows = rows.withColumn("f", L.parse_token(F.col("first_label"))).withColumn("l", L.parse_token(F.col("last_label")))
    ends = rows.select("batch_id", F.explode(F.array(F.struct(F.col("f").alias("t"), (F.col("ord") * 2).alias("at")), F.struct(F.col("l").alias("t"), (F.col("ord") * 2 + 1).alias("at")))).alias("e"))
    prefix = mode(ends.where("e.t is not null").select("batch_id", F.col("e.t.prefix").alias("prefix"), F.col("e.at").alias("at")), ["batch_id"], "prefix", F.col("at"))
    most = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_labeled"), F.max(F.coalesce("l.number", "f.number")).alias("top"))
    every = found.select("batch_id").distinct()
    out = every.join(most.hint("merge"), "batch_id", "left").join(prefix.hint("merge"), "batch_id", "left")
    n = F.coalesce("n_labeled", F.lit(0))
    return out.select("batch_id", n.cast("long").alias("n_labeled"), F.when(n == 0, F.lit(user_prefix)).otherwise(F.coalesce("prefix", F.lit(""))).alias("prefix"), F.when(F.col("top") > 0, F.col("top") + 1).otherwise(F.lit(user_start)).cast("long").alias("start"))


def _taken(files: DataFrame, prefix: str, start: int, digits: int, skip: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Files of a batch in walk order with the numbers each takes, and the locked ones, which take none."""
    rows = last_by(files.withColumn("path", P.norm_key(F.col("path"))), FILE, "ord").where(~P.is_junk(F.col("path")))
    rows = rows.withColumn("_ext", P.ext(F.col("path"))).where(F.col("_ext").isin(*P.PDF, *P.LABEL_IMAGES))
    pdf = F.col("_ext").isin(*P.PDF)
    locked = F.coalesce(F.col("is_locked"), F.lit(False)) & pdf
    closed, rows = rows.where(locked), rows.where(~locked)
    if skip is None:
        rows = rows.withColumn("_f", F.lit(None).cast("string")).withColumn("_l", F.lit(None).cast("string"))
    else:
        rows = rows.join(skip.select(*FILE, F.col("first_label").alias("_f"), F.col("last_label").alias("_l")).hint("merge"), FILE, "left")
    pages = F.when(pdf, F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))).otherwise(1).cast("long")
    failed = F.col("failed_after").isNotNull() if "failed_after" in files.columns else F.lit(False)
    burnt = F.when(pdf, F.least(F.greatest(F.col("failed_after"), F.lit(0)), F.col("pages"))).otherwise(0) if "failed_after" in files.columns else F.lit(0)
    rows = rows.withColumn("pages", pages).withColumn("_failed", failed).withColumn("_walk", P.walk_key(F.col("path")))
    take = F.when(F.col("_f").isNotNull(), 0).when(F.col("_failed"), burnt).otherwise(F.col("pages"))
    return numbered(rows.withColumn("_take", take.cast("long")), "_take", ["_walk", "path"], F.lit(start), F.lit(prefix), F.lit(digits)), closed


def assign(files: DataFrame, prefix: str = "", start: int = 1, digits: int = 8, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of labeling a batch in walk order.

    ``files``: batch_id, ord, path, page_count, is_locked; of rows with one path the last counts. Junk and kinds other
    than PDF and JPEG or PNG images vanish; locked PDFs fail and take no number; images take one. Files in ``skip``
    (batch_id, path, first_label, last_label) keep their labels and take none. Where ``files`` has ``failed_after`` and ``error``, a file
    with a number there broke after so many of its pages: it has no record, and the numbers of those pages are gone.
    """
    out, closed = _taken(files, prefix, start, digits, skip)
    failures = closed.select(*FILE, F.lit("labels").alias("stage"), F.lit(LOCKED).alias("reason"))
    if "failed_after" in files.columns:
        what = F.when(F.col("_f").isNull(), "Failed to label ").otherwise("Failed to preserve ")
        kind = F.when(F.col("_ext").isin(*P.PDF), "PDF: ").otherwise("image: ")
        broken = out.where("_failed").select(*FILE, F.lit("labels").alias("stage"), F.concat(what, kind, F.coalesce("error", F.lit("Exception"))).alias("reason"))
        failures, out = failures.unionByName(broken), out.where(~F.col("_failed"))
    fresh = F.col("_f").isNull()
    name = F.when(fresh & ~F.col("_ext").isin(*P.PDF), P.to_pdf_name(F.col("path"))).otherwise(F.col("path"))
    records = out.select(
        "batch_id", F.col("path").alias("source_path"), name.alias("path"), P.rel_dir(name).alias("rel_dir"), P.filename(name).alias("filename"),
        F.when(fresh, F.col("first_label")).otherwise(F.col("_f")).alias("first_label"), F.when(fresh, F.col("last_label")).otherwise(F.col("_l")).alias("last_label"),
        "pages", P.category(name).alias("category"), F.when(fresh, F.col("first_no")).alias("first_no"), F.when(fresh, F.col("last_no")).alias("last_no"), (~fresh).alias("skipped"),
    )
    return records, failures


def ledger(files: DataFrame, prefix: str = "", start: int = 1, digits: int = 8, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(intervals, totals): where all numbers of a batch went, for the same arguments as ``assign``.

    intervals: batch_id, path, kind, prefix, first_no, last_no, overlaps. ``kind`` is ``used``, ``burnt`` (given to pages of a file that
    broke later) or ``preserved`` (labels that a file had; those that are no label with a number are left out). ``overlaps`` tells an interval that has a
    number in common with an earlier one of its prefix; of equal starts the first by end, then path, is the earlier.
    totals: batch_id, used, burnt, preserved (files), last_used, the last number that was given; start - 1 if none was.
    """
    out, _ = _taken(files, prefix, start, digits, skip)
    out = written(out.select(*FILE, "_take", "_failed", "_f", "_l", "first_no", "last_no"), "taken")
    given = out.where("_take > 0").select(*FILE, F.when(F.col("_failed"), "burnt").otherwise("used").alias("kind"), F.lit(prefix).alias("prefix"), "first_no", "last_no")
    a, b = L.parse_token(F.col("_f")), L.parse_token(F.coalesce(F.nullif(F.col("_l"), F.lit("")), F.col("_f")))
    kept = out.where("_f is not null and not _failed").select(*FILE, F.lit("preserved").alias("kind"), a.alias("a"), b.alias("b")).where("a is not null")
    low, high = F.least("a.number", "b.number"), F.greatest("a.number", "b.number")
    rows = given.unionByName(kept.select(*FILE, "kind", F.col("a.prefix").alias("prefix"), low.alias("first_no"), high.alias("last_no")))
    rows = greatest_before(rows, "last_no", ["first_no", "last_no", "path"], ["batch_id", "prefix"], "_top")
    intervals = rows.select(*FILE, "kind", "prefix", "first_no", "last_no", F.coalesce(F.col("first_no") <= F.col("_top"), F.lit(False)).alias("overlaps"))
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("_take"))), F.lit(0))
    totals = out.groupBy("batch_id").agg(
        number(~F.col("_failed")).alias("used"), number(F.col("_failed")).alias("burnt"), F.count_if(F.col("_f").isNotNull() & ~F.col("_failed")).alias("preserved"),
        (F.lit(start - 1) + F.sum("_take")).cast("long").alias("last_used"),
    )
    return intervals, totals


def islands(intervals: DataFrame) -> DataFrame:
    """(batch_id, prefix, first_no, last_no, files, overlaps, missing): runs of numbers without a gap, and how many numbers are missing before each."""
    by, order = ["batch_id", "prefix"], ["first_no", "last_no", "path"]
    rows = greatest_before(intervals, "last_no", order, by, "_top")
    rows = rows.withColumn("_new", F.coalesce(F.col("first_no") > F.col("_top") + 1, F.lit(True)).cast("int"))
    rows = running_before(rows, "_new", order, by, "_runs").withColumn("_run", F.col("_runs") + F.col("_new"))
    missing = F.max(F.when(F.col("_new") == 1, F.col("first_no") - F.col("_top") - 1))
    out = rows.groupBy(*by, "_run").agg(F.min("first_no").alias("first_no"), F.max("last_no").alias("last_no"), F.count(F.lit(1)).alias("files"), F.count_if("overlaps").alias("overlaps"), F.coalesce(missing, F.lit(0)).alias("missing"))
    return out.drop("_run")


def page_labels(records: DataFrame, prefix: str, digits: int) -> DataFrame:
    """One row a page of freshly labeled files."""
    rows = records.where("first_no is not null").select(*FILE, "first_no", F.explode(F.sequence("first_no", "last_no")).alias("number"))
    return rows.select(*FILE, (F.col("number") - F.col("first_no") + 1).alias("page_no"), L.format_label(F.lit(prefix), F.col("number"), F.lit(digits)).alias("label"))


def predicted(files: DataFrame, prefix: str, start: int, digits: int, order: list[str]) -> DataFrame:
    """Ranges that a client expects, in its own order; a missing page count is one page."""
    rows = files.withColumn("_n", F.coalesce("page_count", F.lit(1)).cast("long"))
    out = numbered(rows, "_n", order, F.lit(start), F.lit(prefix), F.lit(digits))
    return out.withColumn("bates_range", L.bates_range(F.col("first_label"), F.col("last_label"))).drop("_n")


def infer_numbering(records: DataFrame) -> DataFrame:
    """(batch_id, prefix, digits, next_number) of a sidecar's records (batch_id, ord, first_label, last_label).

    Prefix and width are the most frequent ones, of equal ones the first; empty, 8 and 1 if no label can be read.
    """
    last = F.coalesce(F.nullif(F.col("last_label"), F.lit("")), F.col("first_label"))
    both = F.array(F.struct(L.parse_token(F.col("first_label")).alias("t"), (F.col("ord") * 2).alias("at")), F.struct(L.parse_token(last).alias("t"), (F.col("ord") * 2 + 1).alias("at")))
    ends = records.select("batch_id", F.explode(both).alias("e")).where("e.t is not null").select("batch_id", "e.at", "e.t.*")
    prefix = mode(ends, ["batch_id"], "prefix", F.col("at"))
    width = mode(ends.join(prefix.hint("merge"), ["batch_id", "prefix"]), ["batch_id"], "width", F.col("at"))
    top = ends.groupBy("batch_id").agg(F.max("number").alias("top"))
    out = records.select("batch_id").distinct()
    for part in (prefix, width, top):
        out = out.join(part.hint("merge"), "batch_id", "left")
    return out.select("batch_id", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("width", F.lit(8)).alias("digits"), (F.coalesce("top", F.lit(0)) + 1).alias("next_number"))


def fill_gaps(files: DataFrame, records: DataFrame) -> DataFrame:
    """Labels of all files of a batch given a sidecar: matched files keep theirs, loose PDFs and images get the next ones.

    ``files``: batch_id, path, page_count; ``records``: batch_id, ord, path, first_label, last_label. Of records with one
    path the last counts. Loose files go in natural order of their paths; every other loose file stays without label.
    """
    rules = infer_numbering(records)
    kept = last_by(records.withColumn("path", P.norm_key(F.col("path"))), FILE, "ord").select(*FILE, F.col("first_label").alias("_f"), F.col("last_label").alias("_l"))
    rows = files.withColumn("path", P.norm_key(F.col("path"))).join(kept.hint("merge"), FILE, "left").withColumn("_ext", P.ext(F.col("path")))
    loose = F.col("_f").isNull() & F.col("_ext").isin(*P.PDF, *P.OCR_IMAGES)
    pages = F.when(F.col("_ext").isin(*P.PDF), F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))).otherwise(1).cast("long")
    rows = rows.withColumn("pages", pages).withColumn("_loose", loose).withColumn("_take", F.when(loose, pages).otherwise(0)).withColumn("_nat", P.natural_key(F.col("path")))
    # One row a batch: sent to all tasks while batches are few, so that a large batch is not one task's.
    rows = joined_small(running_before(rows, "_take", ["_nat", "path"], ["batch_id"]), written(rules, "rules"), ["batch_id"], "left")
    number = F.coalesce("next_number", F.lit(1)) + F.col("before")
    label = lambda n: L.format_label(F.coalesce("prefix", F.lit("")), n, F.coalesce("digits", F.lit(8)))
    image = F.col("_ext").isin(*P.OCR_IMAGES)
    return rows.select(
        "batch_id", F.when(image, P.to_pdf_name(F.col("path"))).otherwise(F.col("path")).alias("path"), "pages",
        F.when(F.col("_loose"), label(number)).otherwise(F.col("_f")).alias("first_label"),
        F.when(F.col("_loose"), label(number + F.col("pages") - 1)).otherwise(F.col("_l")).alias("last_label"), F.col("_loose").alias("filled"),
    )
