"""Queries over the given tables, and the same in SQL.

The tables hold no PDFs, so each query derives its files, pages, blocks or words from them, by the same expressions
in both languages.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.batch_queries import QUERIES as BATCHES
from paperloom.case_queries import QUERIES as CASES
from paperloom.functions import labels as L
from paperloom.functions import paths as P
from paperloom.functions.matching import without_last_digits
from paperloom.functions.patterns import load_patterns
from paperloom.operators.numbering import running_before
from paperloom.page_queries import QUERIES as PAGES
from paperloom.plans import index, labels, organize, redact, report, scan

PAGE = 3000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Files and pages of documents ---------------------------------------------------------------------------------------

FILES_SQL = f"""
files as (
  select 'b' || (doc_id % 3) as batch_id, doc_id as ord, n_chars as size_bytes, text,
    case when doc_id % 7 = 0 then '' else source || '/' || lang || '/' end || 'doc_' || doc_id
      || case doc_id % 5 when 3 then '.png' when 4 then '.txt' else '.pdf' end as path,
    case when doc_id % 5 < 3 then greatest(1, ceil(n_chars / {PAGE}.0))::bigint end as page_count,
    doc_id % 17 = 0 and doc_id % 5 < 3 as is_locked, doc_id, source, lang
  from documents
)"""
PAGES_SQL = f"""
pages as (
  select batch_id, path, p as page_no, substr(text, {PAGE} * (p - 1) + 1, {PAGE}) as text
  from (select *, unnest(range(1, greatest(1, ceil(length(text) / {PAGE}.0))::bigint + 1)) as p from files)
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kind = F.when(F.expr("doc_id % 5 = 3"), ".png").when(F.expr("doc_id % 5 = 4"), ".txt").otherwise(".pdf")
    folder = F.when(F.expr("doc_id % 7 = 0"), "").otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/")))
    return docs.select(
        F.expr("concat('b', doc_id % 3)").alias("batch_id"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("size_bytes"), "text",
        F.concat(folder, F.lit("doc_"), F.col("doc_id").cast("string"), kind).alias("path"),
        F.when(F.expr("doc_id % 5 < 3"), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / PAGE))).cast("long").alias("page_count"),
        F.expr("doc_id % 17 = 0 and doc_id % 5 < 3").alias("is_locked"), "doc_id", "source", "lang",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    n = F.greatest(F.lit(1), F.ceil(F.char_length("text") / PAGE)).cast("int")
    rows = rows.select("batch_id", "path", "text", F.explode(F.sequence(F.lit(1), n)).alias("page_no"))
    return rows.select("batch_id", "path", F.col("page_no").cast("long").alias("page_no"), F.expr(f"substring(text, {PAGE} * (page_no - 1) + 1, {PAGE})").alias("text"))


# Sensitive content --------------------------------------------------------------------------------------------------


def _hits(spark, sf_dir, presets):
    return redact.hits(pages(spark, sf_dir), load_patterns(presets))


def _found_sql(presets) -> str:
    each = " union all ".join(
        f"select batch_id, path, page_no, '{p.regex.replace(chr(39), chr(39) * 2)}' as pattern, unnest(regexp_extract_all(text, '(?i){p.regex.replace(chr(39), chr(39) * 2)}')) as matched from pages where path not like '%.txt'"
        for p in load_patterns(presets)
    )
    return f"with {FILES_SQL}, {PAGES_SQL}, found as ({each})"


AUDIT_PRESETS = ["Email,Phone", "Credit Card", "8-digit number"]


def redaction_audit(spark, sf_dir):
    """Hits of several presets by file, page and pattern."""
    return redact.audit(_hits(spark, sf_dir, AUDIT_PRESETS))


AUDIT_SQL = _found_sql(AUDIT_PRESETS) + " select batch_id, path as file, page_no as page, pattern, count(*) as match_count from found group by all"


def hits_by_file(spark, sf_dir):
    return redact.hits_by_file(_hits(spark, sf_dir, ["Email", "Phone"]))


HITS_SQL = _found_sql(["Email", "Phone"]) + " select batch_id, path, count(*) as hits from found group by all"


def ssn9_hits(spark, sf_dir):
    """Runs of nine digits, the guard off."""
    found = redact.hits(pages(spark, sf_dir), load_patterns(["SSN"])[2:], require_context=False)
    return found.select("batch_id", "path", "page_no", "matched")


SSN9_SQL = f"""with {FILES_SQL}, {PAGES_SQL} select batch_id, path, page_no, m as matched from (
  select batch_id, path, page_no, unnest(regexp_extract_all(text, '[0-9]+')) as m from pages where path not like '%.txt')
  where length(m) = 9 and m[1:3] not in ('000', '666')"""

# A line for each order: numbers with and without the words that guards look for.
LINES_SQL = """
lines as (
  select o_orderkey,
    case o_orderkey % 4 when 0 then 'SSN: ' when 1 then 'Ref ' when 2 then 'EIN ' else 'Case no ' end
    || case when o_orderkey % 4 in (0, 1)
       then lpad((o_orderkey % 599 + 1)::varchar, 3, '0') || '-' || lpad((o_custkey % 98 + 1)::varchar, 2, '0') || '-' || lpad((o_orderkey % 9998 + 1)::varchar, 4, '0')
       else lpad((o_custkey % 90 + 10)::varchar, 2, '0') || '-' || lpad((o_orderkey % 9999999)::varchar, 7, '0') end as text
  from orders
)"""


def _lines(spark, sf_dir) -> DataFrame:
    two = "concat(lpad(cast(o_orderkey % 599 + 1 as string), 3, '0'), '-', lpad(cast(o_custkey % 98 + 1 as string), 2, '0'), '-', lpad(cast(o_orderkey % 9998 + 1 as string), 4, '0'))"
    one = "concat(lpad(cast(o_custkey % 90 + 10 as string), 2, '0'), '-', lpad(cast(o_orderkey % 9999999 as string), 7, '0'))"
    head = "case o_orderkey % 4 when 0 then 'SSN: ' when 1 then 'Ref ' when 2 then 'EIN ' else 'Case no ' end"
    text = F.expr(f"concat({head}, case when o_orderkey % 4 in (0, 1) then {two} else {one} end)")
    return _table(spark, sf_dir, "orders").select(F.lit("b").alias("batch_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"), F.lit(1).alias("page_no"), text.alias("text"), "o_orderkey")


def ssn_ein_context(spark, sf_dir):
    """Numbers that look like SSNs or EINs, kept where the guard finds its words."""
    found = redact.hits(_lines(spark, sf_dir), load_patterns(["SSN,EIN"]))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("hits"), F.min("matched").alias("matched"))


CONTEXT_SQL = f"""with {LINES_SQL} select o_orderkey || '.pdf' as path, case when o_orderkey % 4 = 0 then 2 else 1 end as hits,
  split_part(text, ' ', 2) as matched from lines where o_orderkey % 4 in (0, 2)"""


def keep_last_digits(spark, sf_dir):
    """What is masked of each number if four digits stay."""
    rows = _lines(spark, sf_dir).withColumn("matched", F.element_at(F.split("text", " "), -1))
    return rows.select("o_orderkey", "matched", without_last_digits(F.col("matched"), 4).alias("masked_part"))


KEEP_SQL = f"""with {LINES_SQL} select o_orderkey, list_last(string_split(text, ' ')) as matched,
  regexp_extract(list_last(string_split(text, ' ')), '^(.*?)[0-9][^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9][^0-9]*$', 1) as masked_part from lines"""


def masked_lines(spark, sf_dir):
    """Lines with their guarded numbers masked but for four digits."""
    lines = _lines(spark, sf_dir)
    return redact.masked(lines, redact.hits(lines, load_patterns(["SSN,EIN"]), keep_last=4)).select("o_orderkey", "redacted")


MASKED_SQL = f"""with {LINES_SQL} select o_orderkey, case o_orderkey % 4
  when 0 then left(text, 5) || repeat('█', 7) || right(text, 4)
  when 2 then left(text, 4) || repeat('█', 6) || right(text, 4) else text end as redacted from lines"""


def split_token_ssn(spark, sf_dir):
    """Numbers in words of their own, five words in a row."""
    lines = _lines(spark, sf_dir)
    w = lines.select("batch_id", "path", "page_no", F.posexplode(F.split(F.regexp_replace("text", "-", " - "), " ")).alias("word_idx", "text"))
    return redact.split_numbers(w).select("path", "word_idx", "matched")


SPLIT_SQL = f"""with {LINES_SQL} select o_orderkey || '.pdf' as path, 1 as word_idx, split_part(text, ' ', 2) as matched from lines where o_orderkey % 4 = 0"""


def split_boxes(spark, sf_dir):
    """The box around each of those numbers, on pages of 612 by 792 points."""
    lines = _lines(spark, sf_dir)
    w = lines.select("batch_id", "path", "page_no", "o_orderkey", F.posexplode(F.split(F.regexp_replace("text", "-", " - "), " ")).alias("word_idx", "text"))
    place = "(word_idx * 8 + o_orderkey % 8) / 128.0D"
    w = w.selectExpr("*", f"{place} as xmin", f"{place} + 0.03125D as xmax", "word_idx / 64.0D as ymin", "(word_idx + 2) / 64.0D as ymax", "612.0D as page_width", "792.0D as page_height")
    return redact.split_numbers(w).select("path", "x0", "y0", "x1", "y1")


BOXES_SQL = f"""with {LINES_SQL} select o_orderkey || '.pdf' as path, (8 + o_orderkey % 8) / 128.0::double * 612 as x0, 1 / 64.0::double * 792 as y0,
  ((40 + o_orderkey % 8) / 128.0::double + 0.03125::double) * 612 as x1, 7 / 64.0::double * 792 as y1 from lines where o_orderkey % 4 = 0"""


def word_hits(spark, sf_dir):
    """Words that are numbers as a whole, near a word that the guard looks for, and the share to cover."""
    w = _lines(spark, sf_dir).select("batch_id", "path", "page_no", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    return redact.word_hits(w, load_patterns(["SSN,EIN"]), keep_last=4).select("path", "word_idx", "pattern_no", "matched", F.round("share", 6).alias("share"))


WORD_HITS_SQL = f"""with {LINES_SQL} select o_orderkey || '.pdf' as path, 1 as word_idx, unnest([0, 1]) as pattern_no, split_part(text, ' ', 2) as matched, round(5 / 9.0::double, 6) as share from lines where o_orderkey % 4 = 0
  union all select o_orderkey || '.pdf', 1, 3, split_part(text, ' ', 2), round(5 / 9.0::double, 6) from lines where o_orderkey % 4 = 2"""


def custom_hits(spark, sf_dir):
    """Hits of a user's pattern, by file."""
    return redact.hits_by_file(redact.hits(pages(spark, sf_dir), load_patterns([], r"mail[0-9]+\.example\.(?:com|org)")))


CUSTOM_SQL = f"""with {FILES_SQL}, {PAGES_SQL}, found as (select batch_id, path, unnest(regexp_extract_all(text, '(?i)mail[0-9]+\\.example\\.(?:com|org)')) as m from pages where path not like '%.txt')
  select batch_id, path, count(*) as hits from found group by all"""

# Labels -------------------------------------------------------------------------------------------------------------

# The order of a walk of the derived files: the root's PDFs, its images, then folders in natural order.
_WALK = "doc_id % 7 <> 0, case when doc_id % 7 <> 0 then substr(source, 4)::bigint end, case when doc_id % 7 <> 0 then lang end, doc_id % 5 >= 3, doc_id"
ASSIGN_SQL = f"""with {FILES_SQL}, own as (
  select *, case when doc_id % 5 < 3 then page_count else 1 end as pages from files where doc_id % 5 <> 4 and not is_locked
), placed as (
  select *, sum(pages) over (partition by batch_id order by {_WALK}) as stop from own
), assigned as (
  select batch_id, doc_id, path as source_path, case when doc_id % 5 = 3 then replace(path, '.png', '.pdf') else path end as path, pages::bigint as pages,
    (stop - pages + 1)::bigint as first_no, stop::bigint as last_no from placed
)"""


def _assigned(spark, sf_dir):
    return labels.assign(files(spark, sf_dir), "PLM", 1, 6)[0]


def bates_assign(spark, sf_dir):
    """Labels of all files in walk order."""
    return _assigned(spark, sf_dir).select("batch_id", "path", "first_label", "last_label", "pages", "category")


BATES_SQL = (
    ASSIGN_SQL
    + """ select batch_id, path, 'PLM ' || case when first_no > 999999 then first_no::varchar else lpad(first_no::varchar, 6, '0') end as first_label,
  'PLM ' || case when last_no > 999999 then last_no::varchar else lpad(last_no::varchar, 6, '0') end as last_label, pages,
  case when doc_id % 7 = 0 then '' else split_part(path, '/', 2) end as category from assigned"""
)


def page_labels(spark, sf_dir):
    """A label for each page."""
    return labels.page_labels(_assigned(spark, sf_dir), "PLM", 6)


PAGE_LABELS_SQL = (
    ASSIGN_SQL
    + """ select batch_id, path, n - first_no + 1 as page_no, 'PLM ' || case when n > 999999 then n::varchar else lpad(n::varchar, 6, '0') end as label
  from (select *, unnest(range(first_no, last_no + 1)) as n from assigned)"""
)


def label_failures(spark, sf_dir):
    """Locked files, which get no numbers."""
    return labels.assign(files(spark, sf_dir), "PLM", 1, 6)[1]


FAILURES_SQL = f"with {FILES_SQL} select batch_id, path, 'labels' as stage, 'Password-protected — run Unlock first' as reason from files where is_locked"


def predicted_ranges(spark, sf_dir):
    """Ranges in the order of upload, pages that are unknown counting one."""
    return labels.predicted(files(spark, sf_dir), "PLM", 1, 6, ["ord"]).select("batch_id", "path", "bates_range")


PREDICTED_SQL = f"""with {FILES_SQL}, n as (
  select *, sum(coalesce(page_count, 1)) over (partition by batch_id order by ord) as stop from files
), l as (
  select *, 'PLM ' || lpad((stop - coalesce(page_count, 1) + 1)::varchar, 6, '0') as a, 'PLM ' || lpad(stop::varchar, 6, '0') as b from n
) select batch_id, path, case when a = b then a else a || ' - ' || b end as bates_range from l"""

# Two-page files of orders with blocks at the foot (or above it), real and false prefixes.
BLOCKS_SQL = """
blocks as (
  select 'b' || (o_custkey % 4) as batch_id, o_orderkey as ord, 'ord/' || o_orderkey || '.pdf' as path, p as page_no, k as block_no,
    case when o_orderkey % 5 = 0 then 400.0 else 720.0 end as y0,
    case when k = 0 then case o_orderkey % 4 when 0 then 'Abc ' when 1 then 'XYZ - ' when 2 then 'Page ' else '' end || lpad((2 * o_orderkey - 2 + p)::varchar, 8, '0')
         else 'Inv ' || lpad(o_custkey::varchar, 6, '0') || ' of 12 pages' end as text
  from orders, (select unnest([1, 2]) as p) ps, (select unnest([0, 1]) as k) ks where k = 0 or (p = 1 and o_custkey % 3 = 0)
)"""


def _blocks(spark, sf_dir) -> DataFrame:
    text = """case when k = 0 then concat(case o_orderkey % 4 when 0 then 'Abc ' when 1 then 'XYZ - ' when 2 then 'Page ' else '' end, lpad(cast(2 * o_orderkey - 2 + p as string), 8, '0'))
         else concat('Inv ', lpad(cast(o_custkey as string), 6, '0'), ' of 12 pages') end"""
    rows = _table(spark, sf_dir, "orders").withColumn("p", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("k = 0 or (p = 1 and o_custkey % 3 = 0)")
    return rows.selectExpr("concat('b', o_custkey % 4) as batch_id", "o_orderkey as ord", "concat('ord/', o_orderkey, '.pdf') as path", "p as page_no", "k as block_no", "0 as block_type", "case when o_orderkey % 5 = 0 then 400.0D else 720.0D end as y0", "792.0D as page_height", f"{text} as text")


def _detected(spark, sf_dir) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    own = blocks.groupBy("batch_id", "path").agg(F.max("page_no").alias("page_count"), F.max("ord").alias("ord"))
    return labels.detect(blocks, own).join(own.select("batch_id", "path", "ord").hint("merge"), ["batch_id", "path"])


def bates_detect(spark, sf_dir):
    """First and last label of each file from the feet of its first and last page."""
    return _detected(spark, sf_dir).select("batch_id", "path", "first_label", "last_label")


DETECT_SQL = f"""{BLOCKS_SQL}, ends as (
  select *, upper(text) as up from blocks where y0 >= 792 * (1 - 0.12) and trim(text) <> ''
), cand as (
  select batch_id, ord, path, page_no, block_no, unnest(regexp_extract_all(up, '\\b([A-Z][A-Z0-9.]{{0,20}})[ \\t\\-–—]+([0-9]{{6,10}})\\b', 1)) as prefix,
    unnest(regexp_extract_all(up, '\\b([A-Z][A-Z0-9.]{{0,20}})[ \\t\\-–—]+([0-9]{{6,10}})\\b', 2)) as num from ends
), usable as (
  select *, (length(num) >= 6 and num[1] = '0')::int as zp, page_no * 10 + block_no as place from cand
  where prefix not in ('MONTHLY', 'BOX', 'ID', 'TARGET', 'REQUESTED', 'MISC', 'PAGE', 'LOREM', 'IPSUM')
), counted as (
  select batch_id, path, prefix, zp, count(*) as n, min(place) as place from usable group by all
), dom as (
  select batch_id, path, prefix from counted qualify row_number() over (partition by batch_id, path order by zp desc, n desc, place) = 1
), own as (
  select u.* from usable u join dom using (batch_id, path, prefix)
), tok as (
  select batch_id, path, max_by(prefix || ' ' || num, (page_no = 1)::int * 1000 + zp * 100 - place) as a, max_by(prefix || ' ' || num, (page_no = 2)::int * 1000 + zp * 100 - place) as b
  from own group by all
), bare as (
  select batch_id, path, min_by(num, place) as a, max_by(num, place) as b from (
    select batch_id, path, page_no * 10 + block_no as place, unnest(regexp_extract_all(up, '\\b(0[0-9]{{5,9}})\\b', 1)) as num from ends)
  where num::bigint > 0 and (batch_id, path) not in (select batch_id, path from dom) group by all
), found as (
  select * from tok union all select * from bare
), detected as (
  select f.batch_id, f.ord, f.path,
    coalesce(case when right(b, 6)::bigint < right(a, 6)::bigint and length(a) = length(b) then b else a end, '') as first_label,
    coalesce(case when right(b, 6)::bigint < right(a, 6)::bigint and length(a) = length(b) then a else b end, '') as last_label
  from (select distinct batch_id, ord, path from blocks) f left join found using (batch_id, path)
)"""
BATES_DETECT_SQL = f"with {DETECT_SQL} select batch_id, path, first_label, last_label from detected"


def detect_images(spark, sf_dir):
    """Labels at the head of a page: found in images, which are read whole; not in PDFs, whose feet are read; never in texts."""
    text = "concat('Case ', o_custkey, ' Abc ', lpad(cast(o_orderkey as string), 8, '0'), ' Abc ', lpad(cast(o_orderkey + 3 as string), 8, '0'))"
    kind = "case o_orderkey % 3 when 0 then '.pdf' when 1 then '.PNG' else '.txt' end"
    blocks = _table(spark, sf_dir, "orders").selectExpr("'b' as batch_id", f"concat('d/', o_orderkey, {kind}) as path", "1 as page_no", "0 as block_no", "0 as block_type", "40.0D as y0", "792.0D as page_height", f"{text} as text")
    return labels.detect(blocks, blocks.select("batch_id", "path", F.lit(1).alias("page_count")))


DETECT_IMAGES_SQL = """select 'b' as batch_id, 'd/' || o_orderkey || case o_orderkey % 3 when 0 then '.pdf' when 1 then '.PNG' else '.txt' end as path,
  case when o_orderkey % 3 = 1 then 'ABC ' || lpad(o_orderkey::varchar, 8, '0') else '' end as first_label,
  case when o_orderkey % 3 = 1 then 'ABC ' || lpad(o_orderkey::varchar, 8, '0') else '' end as last_label from orders"""


def bates_prepass(spark, sf_dir):
    """How numbering goes on after the labels that are there."""
    return labels.continuation(_detected(spark, sf_dir), "NEW", 1)


PREPASS_SQL = f"""with {DETECT_SQL}, tokens as (
  select batch_id, 2 * ord as place, first_label as t from detected where first_label <> '' union all select batch_id, 2 * ord + 1, last_label from detected where first_label <> ''
), parsed as (
  select batch_id, place, coalesce(regexp_extract(t, '^\\s*([A-Z][A-Z0-9.]*)?\\s*([0-9]{{4,10}})\\s*$', 1), '') as prefix, regexp_extract(t, '([0-9]{{4,10}})\\s*$', 1)::bigint as number from tokens
), main as (
  select batch_id, prefix from (select batch_id, prefix, count(*) as n, min(place) as place from parsed group by all) qualify row_number() over (partition by batch_id order by n desc, place) = 1
)
select d.batch_id, count(*) filter (where first_label <> '') as n_labeled, any_value(main.prefix) as prefix,
  max(try_cast(regexp_extract(last_label, '([0-9]{{4,10}})\\s*$', 1) as bigint)) filter (where first_label <> '') + 1 as start
from detected d left join main using (batch_id) group by d.batch_id"""


def _records(rows: DataFrame) -> DataFrame:
    """Label records of derived files: numbers of documents."""
    no = F.col("doc_id") * 3 + 1
    return rows.select("batch_id", "ord", "path", L.format_label(F.lit("OLD"), no, F.lit(7)).alias("first_label"), L.format_label(F.lit("OLD"), no + 1, F.lit(7)).alias("last_label"))


def gap_fill(spark, sf_dir):
    """Files without a record, every fourth document, get the next numbers, in natural order of their paths."""
    return labels.fill_gaps(files(spark, sf_dir), _records(files(spark, sf_dir).where("doc_id % 4 <> 0"))).select("batch_id", "path", "pages", "first_label", "last_label")


GAP_SQL = f"""with {FILES_SQL}, m as (
  select *, doc_id % 4 = 0 and doc_id % 5 <> 4 as loose, case when doc_id % 5 < 3 then page_count else 1 end as pages from files
), top as (
  select batch_id, max(doc_id * 3 + 3) as next from files where doc_id % 4 <> 0 group by batch_id
), placed as (
  select m.*, next + sum(case when loose then pages else 0 end) over (partition by m.batch_id
    order by case when doc_id % 7 = 0 then 'doc_' else 'src' end, case when doc_id % 7 <> 0 then substr(source, 4)::bigint end, case when doc_id % 7 <> 0 then lang end, doc_id) as stop
  from m join top using (batch_id)
)
select batch_id, case when doc_id % 5 = 3 then replace(path, '.png', '.pdf') else path end as path, pages::bigint as pages,
  case when loose then 'OLD ' || lpad((stop - pages)::varchar, 7, '0') when doc_id % 4 <> 0 then 'OLD ' || lpad((doc_id * 3 + 1)::varchar, 7, '0') end as first_label,
  case when loose then 'OLD ' || lpad((stop - 1)::varchar, 7, '0') when doc_id % 4 <> 0 then 'OLD ' || lpad((doc_id * 3 + 2)::varchar, 7, '0') end as last_label
from placed"""

# Index --------------------------------------------------------------------------------------------------------------

# Files in folders with dates; sidecar records by path for some and by bare names for others, in two of three batches.
INDEX_SQL = """
items as (
  select 'b' || (o_custkey % 3) as batch_id, o_orderkey as ord,
    'set' || (o_orderkey % 5) || '/' || strftime(o_orderdate, '%Y.%m.%d') || '/' || case o_orderkey % 6 when 0 then '' else 'c' || (o_custkey % 4) || '/' end || 'f' || (o_orderkey % 500) || '.pdf' as path,
    o_orderdate::date as day, o_orderkey, o_custkey
  from orders
), names as (
  select *, string_split(path, '/')[-1] as filename, string_split(path, '/')[-2] as category, o_orderkey % 500 as no from items
), recs as (
  select batch_id, ord, case when o_orderkey % 2 = 0 then path else '' end as path, filename,
    case when o_orderkey % 11 = 0 then '' else 'IDX ' || lpad(o_orderkey::varchar, 7, '0') end as a, 'IDX ' || lpad((o_orderkey + 1)::varchar, 7, '0') as b
  from names where batch_id <> 'b2'
), by_path as (
  select batch_id, path as key, arg_max({'a': a, 'b': b}, ord) as v from recs where path <> '' group by all
), by_name as (
  select batch_id, filename as key, arg_min({'a': a, 'b': b}, ord) as v from recs group by all
), labeled as (
  select n.batch_id, n.ord, n.path, n.filename, n.category, n.day, coalesce(p.v, q.v).a as a, coalesce(p.v, q.v).b as b
  from names n left join by_path p on p.batch_id = n.batch_id and p.key = n.path left join by_name q on q.batch_id = n.batch_id and q.key = n.filename
), rows as (
  select batch_id, ord, path, category, filename, coalesce(a, '') as first_label, coalesce(b, '') as last_label,
    case when coalesce(a, '') <> '' and coalesce(b, '') <> '' and a <> b then a || ' - ' || b when coalesce(a, '') <> '' then a else coalesce(b, '') end as bates_range, day as date_produced
  from labeled
)"""


def _index(spark, sf_dir) -> DataFrame:
    path = """concat('set', o_orderkey % 5, '/', date_format(o_orderdate, 'yyyy.MM.dd'), '/', case o_orderkey % 6 when 0 then '' else concat('c', o_custkey % 4, '/') end, 'f', o_orderkey % 500, '.pdf')"""
    items = _table(spark, sf_dir, "orders").selectExpr("concat('b', o_custkey % 3) as batch_id", "o_orderkey as ord", f"{path} as path", "o_orderkey")
    recs = items.where("batch_id <> 'b2'").select(
        "batch_id", "ord", F.when(F.expr("o_orderkey % 2 = 0"), F.col("path")).otherwise("").alias("path"), F.lit("").alias("rel_dir"), P.filename(F.col("path")).alias("filename"),
        F.expr("case when o_orderkey % 11 = 0 then '' else concat('IDX ', lpad(cast(o_orderkey as string), 7, '0')) end").alias("first_label"), F.expr("concat('IDX ', lpad(cast(o_orderkey + 1 as string), 7, '0'))").alias("last_label"),
    )
    return index.index_rows(items.select("batch_id", "ord", "path"), recs)


def index_rows(spark, sf_dir):
    """Labels by path, else by name; dates from folders."""
    return _index(spark, sf_dir).select("batch_id", "ord", "path", "category", "first_label", "last_label", "bates_range", "date_produced")


INDEX_ROWS_SQL = f"with {INDEX_SQL} select batch_id, ord, path, category, first_label, last_label, bates_range, date_produced from rows"


def index_layout(spark, sf_dir):
    """The sheet: header, and categories with their documents."""
    return index.sheet(_index(spark, sf_dir))


LAYOUT_SQL = f"""with {INDEX_SQL}, g as (
  select batch_id, category, count(*) as n, sum(count(*) + 2) over (partition by batch_id order by category) - count(*) - 2 + 4 as head from rows group by batch_id, category
), d as (
  select r.*, head + row_number() over (partition by r.batch_id, r.category order by filename, ord) as row_no from rows r join g using (batch_id, category)
)
select batch_id, row_no::bigint as row_no, 'document' as row_type, date_produced::varchar as date_text, filename as text, bates_range as bates from d
union all select batch_id, head::bigint, 'category', '', category, '' from g
union all select batch_id, (head + n + 1)::bigint, 'blank', '', '', '' from g
union all select distinct batch_id, 3::bigint, 'header', 'Date Produced', 'Category & Documents provided', 'Bated labels' from rows"""

# Organizing ---------------------------------------------------------------------------------------------------------

# Names with a year, with none but metadata, or with neither; of items with the same part they meet in one folder.
ORGANIZE_SQL = """
items as (
  select 'b' as batch_id, l_orderkey * 8 + l_linenumber as ord,
    case l_orderkey % 4 when 0 then 'scan_' || strftime(l_shipdate, '%Y%m%d') || '.pdf' when 1 then 'letter ' || strftime(l_shipdate, '%m-%d-%Y') || '.pdf'
      when 2 then 'part' || (l_partkey % 50) || '.pdf' else 'note' || (l_partkey % 50) || '.txt' end as name,
    case when l_linenumber % 3 <> 0 then 'D:' || strftime(l_shipdate, '%Y%m%d') || '120000' end as mod_date, year(l_shipdate)::int as y, l_orderkey % 4 as k
  from lineitem
), yeared as (
  select *, case when k in (0, 1) then y when k = 2 and mod_date is not null then y end as year, case when k in (0, 1) then 'filename' when k = 2 and mod_date is not null then 'metadata' else 'none' end as method from items
), filed as (
  select *, coalesce(year::varchar, 'Unknown') as folder, row_number() over (partition by coalesce(year::varchar, 'Unknown'), name order by ord) - 1 as n from yeared
)"""


def _organized(spark, sf_dir) -> DataFrame:
    name = """case l_orderkey % 4 when 0 then concat('scan_', date_format(l_shipdate, 'yyyyMMdd'), '.pdf') when 1 then concat('letter ', date_format(l_shipdate, 'MM-dd-yyyy'), '.pdf')
      when 2 then concat('part', l_partkey % 50, '.pdf') else concat('note', l_partkey % 50, '.txt') end"""
    rows = _table(spark, sf_dir, "lineitem").selectExpr(
        "'b' as batch_id", "l_orderkey * 8 + l_linenumber as ord", f"{name} as path", "case when l_linenumber % 3 <> 0 then concat('D:', date_format(l_shipdate, 'yyyyMMdd'), '120000') end as mod_date", "cast(null as string) as creation_date"
    )
    return organize.organized(rows)


def organize_year(spark, sf_dir):
    """Year, method, folder and free name of each file."""
    return _organized(spark, sf_dir).select("ord", "year", "method", "folder", "placed")


ORGANIZE_YEAR_SQL = f"""with {ORGANIZE_SQL} select ord, year, method, folder,
  case when n = 0 then name else string_split(name, '.')[1] || '__' || n || '.' || string_split(name, '.')[2] end as placed from filed"""


def folder_counts(spark, sf_dir):
    return organize.folder_counts(_organized(spark, sf_dir))


FOLDERS_SQL = f"with {ORGANIZE_SQL} select batch_id, folder, count(*) as files from filed group by all"

# Scan, triage, passwords --------------------------------------------------------------------------------------------

SCAN_SQL = f"""{FILES_SQL}, {PAGES_SQL}, sample as (
  select batch_id, path, unnest(case when n <= 10 then range(1, n + 1) else list_transform(range(10), lambda i: (i * (n / 10.0))::decimal(18, 6)::double::bigint + 1) end) as page_no
  from (select *, least(page_count, 500) as n from files where doc_id % 5 < 3 and not is_locked)
), ratio as (
  select batch_id, path, avg((length(regexp_replace(coalesce(p.text, ''), '[ \\n]', '', 'g')) >= 50)::int) as r from sample left join pages p using (batch_id, path, page_no) group by all
), scanned as (
  select f.batch_id, f.path, case when doc_id % 5 < 3 then 'pdf' when doc_id % 5 = 3 then 'image' else 'other' end as file_type, size_bytes,
    case when doc_id % 5 < 3 and not is_locked then least(page_count, 500) end as page_count, is_locked, coalesce(r >= 0.8, false) as is_already_ocr,
    (case when doc_id % 5 = 3 then 90 when doc_id % 5 < 3 and not is_locked and not coalesce(r >= 0.8, false) then greatest(least(page_count, 500) * 90, 30) else 0 end)::bigint as estimated_ocr_mb
  from files f left join ratio using (batch_id, path)
)"""


def scan_manifest_files(spark, sf_dir):
    """The scan's row for each file."""
    return scan.scan_files(files(spark, sf_dir), pages(spark, sf_dir))


SCAN_FILES_SQL = f"with {SCAN_SQL} select * from scanned"


def scan_manifest(spark, sf_dir):
    """Totals of each batch."""
    return scan.manifest(scan.scan_files(files(spark, sf_dir), pages(spark, sf_dir))).withColumn("warnings", F.array_join("warnings", "; "))


MANIFEST_SQL = f"""with {SCAN_SQL} select batch_id, count(*) as total_files, coalesce(sum(page_count), 0)::bigint as total_pages, count(*) filter (where is_locked) as locked_count,
  count(*) filter (where is_already_ocr) as already_ocr_count, sum(estimated_ocr_mb)::bigint as estimated_mb,
  concat_ws('; ', case when count(*) filter (where is_locked) > 0 then (count(*) filter (where is_locked))::varchar || ' file(s) are password-protected' end,
    case when sum(estimated_ocr_mb) > 1800 then 'recognition may need ' || sum(estimated_ocr_mb)::varchar || ' MB' end) as warnings
  from scanned group by batch_id"""


def searchable_files(spark, sf_dir):
    """Whether every page has text."""
    return scan.searchable(files(spark, sf_dir).withColumn("read_error", F.lit(None).cast("string")), pages(spark, sf_dir))


SEARCHABLE_SQL = f"""with {FILES_SQL}, {PAGES_SQL}, e as (
  select batch_id, path, bool_and(length(regexp_replace(coalesce(text, ''), '[ \\n\\t]', '', 'g')) >= 20) as ok from pages group by all
) select f.batch_id, f.path, not is_locked and coalesce(ok, false) as searchable from files f left join e using (batch_id, path) where doc_id % 5 < 3"""

PASSWORD_SQL = """
f as (
  select 'b' || (c_custkey % 2) as batch_id, c_custkey, c_nationkey || '/' || c_mktsegment || '/' || c_name || '.pdf' as path, c_name || '.pdf' as base, c_name as stem from customer
), given as (
  select batch_id, case c_custkey % 5 when 0 then path when 1 then base when 2 then stem else 'x' || c_custkey end as filename, case when c_custkey % 20 = 0 then '' else 'pw' || c_custkey end as password from f
)"""


def password_resolve(spark, sf_dir):
    """Passwords by path, name or stem."""
    rows = _table(spark, sf_dir, "customer").selectExpr("concat('b', c_custkey % 2) as batch_id", "c_custkey as ord", "concat(c_nationkey, '/', c_mktsegment, '/', c_name, '.pdf') as path")
    key = F.when(F.expr("ord % 5 = 0"), F.col("path")).when(F.expr("ord % 5 = 1"), P.filename(F.col("path"))).when(F.expr("ord % 5 = 2"), P.stem(F.col("path"))).otherwise(F.expr("concat('x', ord)"))
    given = rows.select("batch_id", "ord", key.alias("filename"), F.expr("case when ord % 20 = 0 then '' else concat('pw', ord) end").alias("password"))
    return scan.passwords(rows, given)


PASSWORDS_SQL = f"""with {PASSWORD_SQL} select f.batch_id, f.path, coalesce(a.password, b.password, c.password) as password,
  case when a.password is not null then 'path' when b.password is not null then 'basename' when c.password is not null then 'stem' else 'none' end as password_source
from f left join given a on a.batch_id = f.batch_id and a.filename = f.path and a.password <> ''
  left join given b on b.batch_id = f.batch_id and b.filename = f.base and b.password <> '' left join given c on c.batch_id = f.batch_id and c.filename = f.stem and c.password <> ''"""

# Names and dates ----------------------------------------------------------------------------------------------------


def junk_filter(spark, sf_dir):
    """Files that stay when archive leftovers go."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 6 when 0 then concat('a/__MACOSX/', c_name) when 1 then concat('d\\\\._', c_name) when 2 then 'b/.DS_Store' when 3 then concat('__MACOSX/', c_name) else concat(c_mktsegment, '/', c_name, '.pdf') end as path")
    return rows.where(~P.is_junk(F.col("path"))).select("c_custkey", "path", P.ext(F.col("path")).alias("ext"))


JUNK_SQL = """select c_custkey, case c_custkey % 6 when 3 then '__MACOSX/' || c_name else c_mktsegment || '/' || c_name || '.pdf' end as path,
  case c_custkey % 6 when 3 then '' else '.pdf' end as ext from customer where c_custkey % 6 >= 3"""


def natural_order(spark, sf_dir):
    """Rank of part names in natural order within their brand."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "concat('Item ', p_partkey % 97, '-', p_size, '.pdf') as name", "1 as one")
    out = running_before(rows.withColumn("key", P.natural_key(F.col("name"))), "one", ["key", "p_partkey"], ["p_brand"])
    return out.select("p_partkey", (F.col("before") + 1).cast("int").alias("rank"))


NATURAL_SQL = "select p_partkey, row_number() over (partition by p_brand order by p_partkey % 97, p_size, p_partkey)::int as rank from part"


def date_produced(spark, sf_dir):
    """Dates from the second folder, any folder, or the name."""
    from paperloom.functions import dates as D

    rows = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """case o_orderkey % 4 when 0 then concat('2019.01.01/', date_format(o_orderdate, 'yyyy-MM-dd')) when 1 then concat('x/y/', date_format(o_orderdate, 'M_d_yyyy')) when 2 then 'x/2021.13.40' else '' end as rel_dir""",
        """case o_orderkey % 4 when 2 then concat('a ', date_format(o_orderdate, 'yyyyMMdd'), '.pdf') when 3 then 'none.pdf' else '2001-01-01.pdf' end as name""",
    )
    return rows.select("o_orderkey", D.date_produced(F.col("rel_dir"), F.col("name"), dt.date(2000, 1, 1)).alias("day"))


DATES_SQL = "select o_orderkey, case when o_orderkey % 4 = 3 then date '2000-01-01' else o_orderdate::date end as day from orders"

# Report -------------------------------------------------------------------------------------------------------------

EVENTS_SQL = """
ev as (
  select 'r' || (user_id % 5) as run_id, ts, event_id as seq, event_type as stage, case event_id % 4 when 0 then 'start' when 1 then 'end' when 2 then 'ok' else case when event_id % 3 = 0 then 'failed' else 'ok' end end as event,
    case when event_id % 4 >= 2 then 'f' || user_id end as filename, 'reason ' || event_id as reason from events
)"""


def _events(spark, sf_dir) -> DataFrame:
    kind = "case event_id % 4 when 0 then 'start' when 1 then 'end' when 2 then 'ok' else case when event_id % 3 = 0 then 'failed' else 'ok' end end"
    return _table(spark, sf_dir, "events").selectExpr("concat('r', user_id % 5) as run_id", "ts", "event_id as seq", "event_type as stage", f"{kind} as event", "case when event_id % 4 >= 2 then concat('f', user_id) end as filename", "concat('reason ', event_id) as reason")


def stage_elapsed(spark, sf_dir):
    """Seconds of each stage of each run."""
    return report.stage_elapsed(_events(spark, sf_dir)).select("run_id", "stage", "elapsed_s")


ELAPSED_SQL = f"""with {EVENTS_SQL}, s as (
  select run_id, stage, max(ts) filter (where event = 'start') as a, max(ts) filter (where event = 'end') as b from ev where event in ('start', 'end') group by all
) select run_id, stage, case when b >= a then round((epoch_us(b) - epoch_us(a)) / 1e6, 3) end as elapsed_s from s"""


def run_report(spark, sf_dir):
    """Per file: stages that went well in order, and failed ones with their last reason."""
    out = report.file_results(_events(spark, sf_dir))
    failed = F.array_join(F.transform(F.map_entries("stages_failed"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("run_id", "filename", F.array_join("stages_ok", ",").alias("stages_ok"), failed.alias("stages_failed"))


REPORT_SQL = f"""with {EVENTS_SQL}, s as (
  select run_id, filename, stage, min(seq) filter (where event = 'ok') as ok, max_by(reason, seq) filter (where event = 'failed') as why from ev where filename is not null group by all
) select run_id, filename, coalesce(string_agg(stage, ',' order by ok) filter (where ok is not null), '') as stages_ok,
  coalesce(string_agg(stage || '=' || why, ';' order by stage) filter (where why is not null), '') as stages_failed from s group by all"""


def run_summary(spark, sf_dir):
    return report.summary(report.file_results(_events(spark, sf_dir)))


SUMMARY_SQL = f"""with {EVENTS_SQL}, s as (
  select run_id, filename, bool_or(event = 'failed') as bad from ev where filename is not null group by all
) select run_id, count(*) as total_files, count(*) filter (where not bad) as fully_succeeded, count(*) filter (where bad) as partially_failed from s group by run_id"""



def label_tokens(spark, sf_dir):
    """Labels taken apart and put together again; a prefix takes the digits that the number can spare."""
    token = "case o_orderkey % 4 when 0 then concat('ABC ', lpad(cast(o_orderkey as string), 8, '0')) when 1 then cast(o_custkey + 100000 as string) when 2 then concat('bad-', o_orderkey) else concat('A.B', lpad(cast(o_custkey as string), 6, '0'), ' ') end"
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{token} as token").withColumn("t", L.parse_token(F.col("token")))
    return rows.select("o_orderkey", "t.prefix", "t.number", "t.width", L.format_label(F.col("t.prefix"), F.col("t.number"), F.col("t.width")).alias("label"))


TOKENS_SQL = """with k as (select o_orderkey, o_orderkey % 4 as k, lpad(o_orderkey::varchar, 8, '0') as a, (o_custkey + 100000)::varchar as b, lpad(o_custkey::varchar, 6, '0') as c from orders)
select o_orderkey, case k when 0 then 'ABC' when 1 then '' when 3 then 'A.B' || left(c, 2) end as prefix, case k when 0 then a when 1 then b when 3 then right(c, 4) end::bigint as number,
  case k when 0 then 8 when 1 then 6 when 3 then 4 end as width, case k when 0 then 'ABC ' || a when 1 then ' ' || b when 3 then 'A.B' || left(c, 2) || ' ' || right(c, 4) end as label from k"""


def range_order(spark, sf_dir):
    """Rank of index rows by the number in their range, both ways; rows without one last, and first the other way."""
    rows = _index(spark, sf_dir).select("batch_id", "ord", "category", "bates_range")
    rows = index.range_ranks(rows, ["batch_id", "category"]).withColumnRenamed("rank", "up")
    return index.range_ranks(rows, ["batch_id", "category"], descending=True).select("batch_id", "ord", F.col("up").cast("int").alias("rank"), F.col("rank").alias("rank_down"))


RANGE_SQL = f"""with {INDEX_SQL}, n as (select *, try_cast(regexp_extract(bates_range, '([0-9]{{6,10}})', 1) as bigint) as no from rows)
  select batch_id, ord, row_number() over (partition by batch_id, category order by no nulls last, ord)::int as rank,
    row_number() over (partition by batch_id, category order by no desc nulls first, ord) as rank_down from n"""


def delivery_plan(spark, sf_dir):
    """Batches that are one file alone, which is handed out bare."""
    path = "case when o_orderkey % 5 = 0 then '_redaction_audit.json' else concat('d/f', o_orderkey, case when o_orderkey % 3 = 0 then '.txt' else '.PDF' end) end"
    return report.delivery(_table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) as batch_id", f"{path} as path"))


DELIVERY_SQL = """select 'c' || o_custkey as batch_id, count(*) as files, case when count(*) = 1 and bool_and(o_orderkey % 3 <> 0) then max('d/f' || o_orderkey || '.PDF') end as single
  from orders where o_orderkey % 5 <> 0 group by o_custkey"""


def failure_headers(spark, sf_dir):
    """Failures of two stages over all orders, each file's first reason, as JSON; a batch is a customer, a file its orders of a month."""
    path = "concat('p', date_format(o_orderdate, 'yyyyMM')) as path"
    rows = _table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) as batch_id", path, "o_orderpriority as reason", "o_orderstatus = 'F' as early")
    return report.failures_header(report.merged_failures([rows.where("early"), rows.where("not early")]))


HEADERS_SQL = """with r as (select 'c' || o_custkey as b, 'p' || strftime(o_orderdate, '%Y%m') as p, o_orderpriority as why, case when o_orderstatus = 'F' then 0 else 1 end as k from orders),
one as (select b, p, why from r qualify row_number() over (partition by b, p order by k, why) = 1)
select b as batch_id, '{' || string_agg('"' || p || '":"' || why || '"', ',' order by p) || '}' as header from one group by b"""


def sidecar_round_trip(spark, sf_dir):
    """Records of all files written as sidecars, one a batch of 1000 documents, and read from them."""
    from paperloom.sources import intake, results

    records = _records(files(spark, sf_dir)).withColumn("batch_id", F.expr("concat('b', ord div 1000)"))
    members = results.sidecar_json(records).select("batch_id", F.lit(0).alias("ord"), F.lit("./" + P.SIDECARS[0]).alias("path"), "content")
    return intake.sidecar_records(members).select("batch_id", "ord", "path", "first_label", "last_label")


SIDECAR_SQL = f"""with {FILES_SQL} select 'b' || (doc_id // 1000) as batch_id, (row_number() over (partition by doc_id // 1000 order by ord) - 1)::int as ord, path,
  'OLD ' || lpad((doc_id * 3 + 1)::varchar, 7, '0') as first_label, 'OLD ' || lpad((doc_id * 3 + 2)::varchar, 7, '0') as last_label from files"""


def report_texts(spark, sf_dir):
    """Stages of each run's report, read back from its JSON."""
    events = _events(spark, sf_dir)
    out = report.report_json(report.file_results(events), report.stage_elapsed(events), {"prefix": "PLM"})
    return out.select("run_id", F.get_json_object("report", "$.total_files").cast("long").alias("total_files"), F.get_json_object("report", "$.settings.prefix").alias("prefix"))


REPORTS_SQL = f"with {EVENTS_SQL} select run_id, count(distinct filename) as total_files, 'PLM' as prefix from ev where filename is not null group by run_id"

QUERIES = {
    "split_boxes": (split_boxes, BOXES_SQL),
    "word_hits": (word_hits, WORD_HITS_SQL),
    "custom_hits": (custom_hits, CUSTOM_SQL),
    "label_tokens": (label_tokens, TOKENS_SQL),
    "range_order": (range_order, RANGE_SQL),
    "delivery_plan": (delivery_plan, DELIVERY_SQL),
    "failure_headers": (failure_headers, HEADERS_SQL),
    "sidecar_round_trip": (sidecar_round_trip, SIDECAR_SQL),
    "report_texts": (report_texts, REPORTS_SQL),
    "redaction_audit": (redaction_audit, AUDIT_SQL),
    "hits_by_file": (hits_by_file, HITS_SQL),
    "ssn9_hits": (ssn9_hits, SSN9_SQL),
    "ssn_ein_context": (ssn_ein_context, CONTEXT_SQL),
    "keep_last_digits": (keep_last_digits, KEEP_SQL),
    "masked_lines": (masked_lines, MASKED_SQL),
    "split_token_ssn": (split_token_ssn, SPLIT_SQL),
    "bates_assign": (bates_assign, BATES_SQL),
    "page_labels": (page_labels, PAGE_LABELS_SQL),
    "label_failures": (label_failures, FAILURES_SQL),
    "predicted_ranges": (predicted_ranges, PREDICTED_SQL),
    "bates_detect": (bates_detect, BATES_DETECT_SQL),
    "detect_images": (detect_images, DETECT_IMAGES_SQL),
    "bates_prepass": (bates_prepass, PREPASS_SQL),
    "gap_fill": (gap_fill, GAP_SQL),
    "index_rows": (index_rows, INDEX_ROWS_SQL),
    "index_layout": (index_layout, LAYOUT_SQL),
    "organize_year": (organize_year, ORGANIZE_YEAR_SQL),
    "folder_counts": (folder_counts, FOLDERS_SQL),
    "scan_files": (scan_manifest_files, SCAN_FILES_SQL),
    "scan_manifest": (scan_manifest, MANIFEST_SQL),
    "searchable_files": (searchable_files, SEARCHABLE_SQL),
    "password_resolve": (password_resolve, PASSWORDS_SQL),
    "junk_filter": (junk_filter, JUNK_SQL),
    "natural_order": (natural_order, NATURAL_SQL),
    "date_produced": (date_produced, DATES_SQL),
    "stage_elapsed": (stage_elapsed, ELAPSED_SQL),
    "run_report": (run_report, REPORT_SQL),
    "run_summary": (run_summary, SUMMARY_SQL),
} | CASES | PAGES | BATCHES
