"""Queries of whole jobs on pages and numbers, with their SQL: combined findings, ordered audits, masks, the ledger of numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.patterns import load_patterns
from paperloom.operators.numbering import running_before
from paperloom.operators.storage import shared_dir
from paperloom.plans import labels, redact
from paperloom.sources import results

PAGE = 1000
PRESETS = ["Email,Phone", "Credit Card", "8-digit number"]

# Pages of documents with a text of their own, with words only, and with neither; and pages of orders whose numbers stand in one word or in five.
PAGES_SQL = f"""
docs as (
  select 'b' || (doc_id % 3) as batch_id, doc_id as ord, 'd/doc_' || doc_id || case doc_id % 4 when 3 then '.png' else '.pdf' end as path, doc_id, text from documents
), cut as (
  select batch_id, ord, path, p as page_no, (doc_id + p) % 3 as way, substr(text, {PAGE} * (p - 1) + 1, {PAGE}) as text
  from (select *, unnest(range(1, greatest(1, ceil(length(text) / {PAGE}.0))::bigint + 1)) as p from docs)
), lines as (
  select 'o' as batch_id, o_orderkey as ord, o_orderkey || '.pdf' as path, 1::bigint as page_no, 0 as way,
    case o_custkey % 2 when 0 then 'SSN: ' else 'Ref ' end || lpad((o_orderkey % 599 + 1)::varchar, 3, '0') || ' - ' || lpad((o_custkey % 98 + 1)::varchar, 2, '0') || ' - ' || lpad((o_orderkey % 9998 + 1)::varchar, 4, '0')
      || ' tel. 555-' || lpad((o_orderkey % 999)::varchar, 3, '0') || '-' || lpad((o_custkey % 9999)::varchar, 4, '0') as text
  from orders
), given as (
  select * from cut union all select * from lines
), read as (
  select batch_id, ord, path, page_no, text, way = 1 and path like '%.pdf' as own, string_split_regex(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') as ws, way from given
)"""


def _given(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "concat('b', doc_id % 3) as batch_id", "doc_id as ord", "concat('d/doc_', doc_id, case doc_id % 4 when 3 then '.png' else '.pdf' end) as path", "doc_id", "text",
        f"explode(sequence(1L, greatest(1L, cast(ceil(char_length(text) / {PAGE}) as bigint)))) as page_no",
    )
    docs = docs.selectExpr("batch_id", "ord", "path", "page_no", "cast((doc_id + page_no) % 3 as int) as way", f"substring(text, cast({PAGE} * (page_no - 1) + 1 as int), {PAGE}) as text")
    text = """concat(case o_custkey % 2 when 0 then 'SSN: ' else 'Ref ' end, lpad(cast(o_orderkey % 599 + 1 as string), 3, '0'), ' - ', lpad(cast(o_custkey % 98 + 1 as string), 2, '0'), ' - ', lpad(cast(o_orderkey % 9998 + 1 as string), 4, '0'),
      ' tel. 555-', lpad(cast(o_orderkey % 999 as string), 3, '0'), '-', lpad(cast(o_custkey % 9999 as string), 4, '0'))"""
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("'o' as batch_id", "o_orderkey as ord", "concat(o_orderkey, '.pdf') as path", "1L as page_no", "0 as way", f"{text} as text")
    return docs.unionByName(lines)


def _pages(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    pages = given.select("batch_id", "path", "page_no", F.when(F.col("way") == 1, F.col("text")).when(F.col("way") == 2, " \n").alias("text"))
    words = F.posexplode(F.split(F.trim("text", F.lit(" \t\n\r")), r"[ \t\n\r]+")).alias("word_idx", "text")
    return pages, given.where("way <> 2").select("batch_id", "path", "page_no", words)


def _findings(spark, sf_dir) -> DataFrame:
    return redact.findings(*_pages(_given(spark, sf_dir)), load_patterns(PRESETS))


def page_findings(spark, sf_dir):
    """Hits of pages by their text, else by their words, else none."""
    return _findings(spark, sf_dir).select("batch_id", "path", "page_no", "source", "pattern", F.coalesce("word_idx", "start").alias("place"), "n_words", "matched")


def _quoted(regex: str) -> str:
    return regex.replace("'", "''")


_EACH = [(k, _quoted(p.regex)) for k, p in enumerate(load_patterns(PRESETS))]


def _starts(pages: str, pattern: str, columns: str) -> str:
    """Matches in ``text`` with their places: the lengths of what is between them and of the matches before."""
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    return f"""select {columns}, m[j] as matched, ({length('g[1:j]')} + {length('m[1:j - 1]')})::bigint as place from (select *, unnest(range(1, len(m) + 1)) as j
      from (select *, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from {pages}))"""


_TEXT_HITS = " union all ".join(_starts("(select * from read where own)", f"(?i){p}", f"batch_id, ord, path, page_no, {k} as k, '{p}' as pattern") for k, p in _EACH)
_WORD_HITS = " union all ".join(f"select batch_id, ord, path, page_no, {k} as k, '{p}' as pattern, w as matched, i from word where regexp_full_match(w, '(?i){p}')" for k, p in _EACH)
_NEAR = r"(?i)(^|[^\p{L}\p{N}_])(ssn|social\s*security|soc\s*sec|ss#|tin|taxpayer\s*id)($|[^\p{L}\p{N}_])"
FOUND_SQL = f"""{PAGES_SQL}, text_hits as ({_TEXT_HITS}), word as (
  select batch_id, ord, path, page_no, ws, unnest(ws) as w, generate_subscripts(ws, 1)::int - 1 as i from read where not own and way <> 2
), whole as ({_WORD_HITS}), five as (
  select batch_id, ord, path, page_no, i, ws[i + 1] || '-' || ws[i + 3] || '-' || ws[i + 5] as matched, len(ws) as n from word
  where i + 5 <= len(ws) and regexp_full_match(ws[i + 1], '[0-9]{{3}}') and regexp_full_match(ws[i + 3], '[0-9]{{2}}') and regexp_full_match(ws[i + 5], '[0-9]{{4}}')
    and regexp_full_match(ws[i + 2], '[^0-9]*') and regexp_full_match(ws[i + 4], '[^0-9]*') and regexp_matches(array_to_string(ws[greatest(i - 4, 0) + 1:i + 9], ' '), '{_NEAR}')
), found as (
  select batch_id, ord, path, page_no, 'text' as source, pattern, place, null::int as n_words, matched, k as a, place as b from text_hits
  union all select batch_id, ord, path, page_no, 'words', pattern, i, 1, matched, i, k from whole
  union all select batch_id, ord, path, page_no, 'words', 'OCR_SSN_SPLIT', i, 5, matched, n, i from five
)"""
FINDINGS_SQL = f"with {FOUND_SQL} select batch_id, path, page_no, source, pattern, place, n_words, matched from found"


def _again(rows: DataFrame, kind: str, **options) -> DataFrame:
    """Rows written as JSON arrays, one a batch, and read from them."""
    path = f"{shared_dir(rows.sparkSession)}/array-{uuid.uuid4().hex}"
    results.write_json_array(rows.withColumn("no", F.col("place")), path, **options)
    return results.read_json_array(rows.sparkSession, path, kind)


def ordered_audit(spark, sf_dir):
    """The audit of all pages in the order in which hits are met, written as one array a batch and read back."""
    given = _given(spark, sf_dir)
    found = redact.findings(*_pages(given), load_patterns(PRESETS))
    files = given.select("batch_id", "path", "ord").distinct()
    return _again(redact.audit_in_order(found, files), "no long, file string, page long, pattern string, match_count long", batches=files)


AUDIT_SQL = f"""with {FOUND_SQL}, entries as (
  select batch_id, ord, path, page_no, pattern, count(*) as match_count, min({{'a': a::bigint, 'b': b::bigint}}) as seq from found group by all
) select batch_id, row_number() over (partition by batch_id order by ord, path, page_no, seq, pattern) - 1 as no, path as file, page_no as page, pattern, match_count from entries"""


def review_payload(spark, sf_dir):
    """What a reviewer sees of each batch."""
    given = _given(spark, sf_dir)
    files = given.select("batch_id", "path").distinct()
    ranges = given.groupBy("batch_id").agg(F.format_string("A %08d", F.min("ord")).alias("first_bates"), F.format_string("A %08d", F.max("ord")).alias("last_bates"))
    return redact.review(_findings(spark, sf_dir), files, ranges)


REVIEW_SQL = f"""with {FOUND_SQL}, hit as (
  select batch_id, count(distinct path) as files_with_hits, count(*) as total_hits from found group by batch_id
), total as (
  select batch_id, count(distinct path) as total_files, 'A ' || lpad(min(ord)::varchar, 8, '0') as a, 'A ' || lpad(max(ord)::varchar, 8, '0') as b from given group by batch_id
) select batch_id, total_files, coalesce(files_with_hits, 0) as files_with_hits, coalesce(total_hits, 0) as total_hits, case when a = b then a else a || ' - ' || b end as bates_range from total left join hit using (batch_id)"""

# Masks --------------------------------------------------------------------------------------------------------------

MASK_PRESETS = ["Email,Phone", "8-digit number"]


def masked_pages(spark, sf_dir):
    """Pages with hits, all their literals covered."""
    pages = _given(spark, sf_dir).where("way = 1 and path like '%.pdf'").select("batch_id", "path", "page_no", "text")
    return redact.masked(pages, redact.hits(pages, load_patterns(MASK_PRESETS))).where("redacted <> text").select("batch_id", "path", "page_no", "redacted")


_MASK_HITS = " union ".join(f"select batch_id, path, page_no, unnest(regexp_extract_all(text, '(?i){_quoted(p.regex)}')) as literal from read where own" for p in load_patterns(MASK_PRESETS))
MASKED_SQL = f"""with {PAGES_SQL}, literals as ({_MASK_HITS}), met as (
  select batch_id, path, page_no, length(literal) as n, string_split(lower(text), lower(literal)) as g from literals join read using (batch_id, path, page_no)
), places as (
  select batch_id, path, page_no, n, list_sum(list_transform(g[1:j], lambda s: length(s))) + n * (j - 1) as start from (select *, unnest(range(1, len(g))) as j from met)
), gone as (
  select distinct batch_id, path, page_no, unnest(range(start::bigint, (start + n)::bigint)) + 1 as i from places
), letters as (
  select batch_id, path, page_no, unnest(range(1, length(text) + 1)) as i, text from read where own and (batch_id, path, page_no) in (select (batch_id, path, page_no) from gone)
) select batch_id, path, page_no, string_agg(case when g.i is null then substr(text, l.i, 1) else '█' end, '' order by l.i) as redacted
from letters l left join gone g using (batch_id, path, page_no, i) group by batch_id, path, page_no"""

# Numbers ------------------------------------------------------------------------------------------------------------

LEDGER_SQL = """
f as (
  select 'b' || (doc_id % 3) as batch_id, doc_id, doc_id % 5 = 3 as image, 'd' || (doc_id % 7) || '/f' || doc_id || case when doc_id % 5 = 3 then '.png' else '.pdf' end as path,
    case when doc_id % 5 = 3 then 1 else 1 + n_chars // 1000 end as pages, doc_id % 11 = 0 as failed, doc_id % 13 = 0 as kept from documents
), t as (
  select *, case when kept then 0 when failed then case when image then 0 else least(doc_id % 4, pages) end else pages end as take from f
), p as (
  select *, sum(take) over (partition by batch_id order by doc_id % 7, image, doc_id) as stop from t
), intervals as (
  select batch_id, path, case when failed then 'burnt' else 'used' end as kind, 'PLM' as prefix, (stop - take + 1)::bigint as first_no, stop::bigint as last_no from p where take > 0
  union all select batch_id, path, 'preserved', 'PLM', doc_id * 3, doc_id * 3 + 2 from p where kept and not failed and doc_id > 0
), judged as (
  select *, max(last_no) over (partition by batch_id, prefix order by first_no, last_no, path rows between unbounded preceding and 1 preceding) as top from intervals
)"""


def _ledger(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "concat('b', doc_id % 3) as batch_id", "doc_id as ord", "concat('d', doc_id % 7, '/f', doc_id, case when doc_id % 5 = 3 then '.png' else '.pdf' end) as path", "1 + n_chars div 1000 as page_count", "false as is_locked",
        "case when doc_id % 11 = 0 then doc_id % 4 end as failed_after", "'ValueError' as error",
    )
    label = lambda n: F.when(F.col("ord") > 0, F.format_string("PLM %07d", n)).otherwise("no label")
    skip = files.where("ord % 13 = 0").select("batch_id", "path", label(F.col("ord") * 3).alias("first_label"), label(F.col("ord") * 3 + 2).alias("last_label"))
    return labels.ledger(files, "PLM", 1, 7, skip)


def number_ledger(spark, sf_dir):
    """Where each number of a batch went: used, burnt by a file that broke, or kept from before; and which meet."""
    return _ledger(spark, sf_dir)[0]


NUMBER_LEDGER_SQL = f"with {LEDGER_SQL} select batch_id, path, kind, prefix, first_no, last_no, coalesce(first_no <= top, false) as overlaps from judged"


def number_totals(spark, sf_dir):
    """Numbers used and burnt of each batch, and the last one."""
    return _ledger(spark, sf_dir)[1]


NUMBER_TOTALS_SQL = f"""with {LEDGER_SQL} select batch_id, coalesce(sum(take) filter (where not failed), 0)::bigint as used, coalesce(sum(take) filter (where failed), 0)::bigint as burnt,
  count(*) filter (where kept and not failed) as preserved, sum(take)::bigint as last_used from p group by batch_id"""


def number_islands(spark, sf_dir):
    """Runs of numbers without a gap."""
    return labels.islands(_ledger(spark, sf_dir)[0])


NUMBER_ISLANDS_SQL = f"""with {LEDGER_SQL}, r as (
  select *, sum(case when first_no <= top + 1 then 0 else 1 end) over (partition by batch_id, prefix order by first_no, last_no, path) as run from judged
) select batch_id, prefix, min(first_no) as first_no, max(last_no) as last_no, count(*) as files, count(*) filter (where first_no <= top) as overlaps,
  coalesce(max(case when first_no > top + 1 then first_no - top - 1 end), 0)::bigint as missing from r group by batch_id, prefix, run"""


def sidecar_array(spark, sf_dir):
    """All documents' labels as one array over many files, and read from it."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("'b' as batch_id", "doc_id as ord", "concat(source, '/', doc_id, '.pdf') as path", "concat('ABC ', doc_id) as first_label", "1 as one")
    return _again(running_before(rows, "one", ["ord"], ["batch_id"], "place").drop("one", "ord"), "no long, path string, first_label string")


SIDECAR_ARRAY_SQL = "select 'b' as batch_id, row_number() over (order by doc_id) - 1 as no, source || '/' || doc_id || '.pdf' as path, 'ABC ' || doc_id as first_label from documents"

QUERIES = {
    "page_findings": (page_findings, FINDINGS_SQL),
    "ordered_audit": (ordered_audit, AUDIT_SQL),
    "review_payload": (review_payload, REVIEW_SQL),
    "masked_pages": (masked_pages, MASKED_SQL),
    "number_ledger": (number_ledger, NUMBER_LEDGER_SQL),
    "number_totals": (number_totals, NUMBER_TOTALS_SQL),
    "number_islands": (number_islands, NUMBER_ISLANDS_SQL),
    "sidecar_array": (sidecar_array, SIDECAR_ARRAY_SQL),
}
