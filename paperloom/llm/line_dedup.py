"""Line dedup by site-relative frequency.

Pages are grouped by host. For each host and line, the pages that hold the line are divided
by the pages of the host; lines above a ratio are boilerplate and go from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import fresh, joined_small, table, written

#: Production parameters: a line on more than 2 % of a host's pages, and on 3 pages at least, is boilerplate.
MAX_RATIO = 0.02
MIN_PAGES = 3


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, family: DataFrame | None = None) -> DataFrame:
    """(host, h1, h2, pages, ratio) of every boilerplate line; two hashes stand for the line.

    With ``family`` (a written table of doc_id and family) the documents of one family, and the rows of one
    doc_id, are one page of each host they are on: a line of copies of one text is not boilerplate by their number.

    A line counts once a page. Lines are compared as they are but for blanks at their ends;
    blank lines never count. Rows with a null host or null text take no part. A host has at most
    (mean lines a page) / ``max_ratio`` such lines.
    """
    if family is not None:  # only the host, the text and doc_id are read
        family = family.select(F.col("doc_id").alias("_doc_id"), F.col("family").alias("_family"))
        docs = joined_small(docs.select(F.col(host), "text", F.col("doc_id").alias("_doc_id")), family, ["_doc_id"], "left", rows=200_000)
        docs = docs.withColumn("_page", F.coalesce("_family", "_doc_id", F.xxhash64("text")))
    own = ["_page"] if family is not None else []
    pages = F.count_distinct("_page") if family is not None else F.count(F.lit(1))
    page = docs.select(F.col(host).alias("host"), F.col("text").alias("page_text"), *own).where("host is not null and page_text is not null")
    # The hash decides which lines are alike: 128 bits, and 16 bytes a line to shuffle instead of the line.
    line = F.explode(F.array_distinct(F.transform(F.split("page_text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")))))
    lines = page.select("host", *own, line.alias("line")).where("line <> ''")
    keys = lines.select("host", *own, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    often = keys.groupBy("host", "h1", "h2").agg(pages.alias("pages")).where(F.col("pages") >= min_pages)
    totals = page.groupBy("host").agg(pages.alias("host_pages"))
    return (
        often.join(totals.hint("merge"), "host")
        .withColumn("ratio", F.col("pages") / F.col("host_pages"))
        .where(F.col("ratio") > max_ratio)
        .select("host", "h1", "h2", "pages", "ratio")
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, family: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_removed`` (in place of any of that name).

    Every row stays, repeated rows included, and so does every other column; the text of a row
    without boilerplate stays as it is, byte for byte. Null text stays null with 0 lines; rows
    with a null host keep their text. An empty table gives an empty one. ``family``: see ``boilerplate``.
    """
    found = boilerplate(docs, host, max_ratio, min_pages, family)
    # One row a host with its few boilerplate lines, so that a text meets them in one step.
    per_host = found.groupBy("host").agg(F.collect_set(F.struct("h1", "h2")).alias("_boilerplate"))
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    at, boiler, kept_lines = (fresh(docs, x) for x in ("host", "boilerplate", "kept"))
    per_host = written(per_host.withColumnsRenamed({"host": at, "_boilerplate": boiler}), "boilerplate")
    met = joined_small(docs.select(*own, F.col(host).alias(at)), per_host, [at], "left", rows=1_000)
    lines = F.split("text", "\n")
    key = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))
    trimmed = lambda x: F.trim(x, F.lit(" \t\r"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(boiler), key(trimmed(x))))
    met = met.withColumn(kept_lines, F.when(F.col(boiler).isNull(), lines).otherwise(kept))
    count = lambda x: F.when(F.col("text").isNull(), 0).otherwise(F.size(x)).cast("long")
    met = met.withColumn("n_lines", count(lines)).withColumn("n_removed", F.col("n_lines") - count(F.col(kept_lines)))
    met = met.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    return met.select(*own, "n_lines", "n_removed")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = f"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line from documents where text is not null
), per_page as (
  select distinct doc_id, source, trim(line, ' ' || chr(9) || chr(13)) as line from lines where source is not null
), totals as (
  select source, count(*) as host_pages from documents where source is not null and text is not null group by source
), boiler as (
  select source, line from per_page join totals using (source)
  where line <> '' group by source, line
  having count(*) >= {MIN_PAGES} and count(*) / max(host_pages) > {MAX_RATIO}
), parts as (
  select d.doc_id, u.k, u.line, b.line is not null as bad
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as k from documents) u
  join documents d using (doc_id)
  left join boiler b on b.source = d.source and b.line = trim(u.line, ' ' || chr(9) || chr(13))
)
select d.doc_id, count(p.k) as n_lines, count(*) filter (where p.bad) as n_removed,
       sha256(coalesce(string_agg(p.line, chr(10) order by p.k) filter (where not p.bad), '')) as kept_sha256
from documents d left join parts p on p.doc_id = d.doc_id group by d.doc_id
"""
