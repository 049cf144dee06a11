"""Queries for the rules that the ones in ``queries`` do not reach, with their SQL: whole tables, a derived row for each row."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import paths as P
from paperloom.functions.patterns import load_patterns
from paperloom.operators.picks import last_by
from paperloom.operators.storage import shared_dir
from paperloom.plans import index, labels, organize, redact, report, scan
from paperloom.sources import intake, results


def _rows(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


def _pages(spark, sf_dir, text):
    return _rows(spark, sf_dir, "orders", "'b' as batch_id", "concat(o_orderkey, '.pdf') as path", "1 as page_no", f"{text} as text")


def _found(spark, sf_dir, y0, text, **options):
    blocks = _rows(spark, sf_dir, "orders", "'b' as batch_id", "concat(o_orderkey, '.pdf') as path", "1 as page_no", "0 as block_no", "0 as block_type", f"{y0} as y0", "792.0D as page_height", f"{text} as text")
    return labels.detect(blocks, blocks.select("batch_id", "path", F.lit(1).alias("page_count")), **options)


def detect_blacklist(spark, sf_dir):
    """Labels where the user says that a prefix is none: the bare number stays."""
    return _found(spark, sf_dir, "780.0D", "concat(case o_orderkey % 2 when 0 then 'Abc ' else 'Klm ' end, lpad(cast(o_orderkey as string), 9, '0'))", extra=(" abc",))


DETECT_BLACKLIST = """with l as (select o_orderkey, case when o_orderkey = 0 then '' when o_orderkey % 2 = 0 then lpad(o_orderkey::varchar, 9, '0') else 'KLM ' || lpad(o_orderkey::varchar, 9, '0') end as l from orders)
select 'b' as batch_id, o_orderkey || '.pdf' as path, l as first_label, l as last_label from l"""


def detect_browser(spark, sf_dir):
    """The browser's rule: anywhere on a page, prefixes of two letters at least, no bare numbers."""
    return _found(spark, sf_dir, "40.0D", "concat(case o_orderkey % 3 when 0 then 'Ab\\n' when 1 then 'Q ' else '' end, lpad(cast(o_orderkey as string), 9, '0'))", profile="browser")


DETECT_BROWSER = """select 'b' as batch_id, o_orderkey || '.pdf' as path, case o_orderkey % 3 when 0 then 'AB ' || lpad(o_orderkey::varchar, 9, '0') else '' end as first_label,
  case o_orderkey % 3 when 0 then 'AB ' || lpad(o_orderkey::varchar, 9, '0') else '' end as last_label from orders"""


def assign_again(spark, sf_dir):
    """Files that come twice, the later row counting, some of them labeled before."""
    twice = _rows(spark, sf_dir, "customer", "'b' as batch_id", "c_custkey", "explode(array(1L, 2L)) as page_count").selectExpr("batch_id", "c_custkey * 2 + page_count as ord", "concat('f', c_custkey, '.pdf') as path", "page_count", "false as is_locked")
    skip = _rows(spark, sf_dir, "customer", "'b' as batch_id", "c_custkey").where("c_custkey % 3 = 0").selectExpr("batch_id", "concat('f', c_custkey, '.pdf') as path", "concat('OLD ', c_custkey) as first_label", "concat('OLD ', c_custkey) as last_label")
    return labels.assign(twice, "PLM", 1, 6, skip)[0].select("path", "first_label", "last_label", "pages", "skipped")


ASSIGN_AGAIN = """with r as (select c_custkey, c_custkey % 3 = 0 as skipped, sum(case when c_custkey % 3 = 0 then 0 else 2 end) over (order by c_custkey) as stop from customer)
select 'f' || c_custkey || '.pdf' as path, case when skipped then 'OLD ' || c_custkey else 'PLM ' || case when stop > 1000000 then (stop - 1)::bigint::varchar else lpad((stop - 1)::bigint::varchar, 6, '0') end end as first_label,
  case when skipped then 'OLD ' || c_custkey else 'PLM ' || case when stop > 999999 then stop::bigint::varchar else lpad(stop::bigint::varchar, 6, '0') end end as last_label, 2::bigint as pages, skipped from r"""


def summary_labels(spark, sf_dir):
    """A run's counts with the least and greatest label as text, without those of skipped files."""
    events = _rows(spark, sf_dir, "events", "concat('r', user_id % 5) as run_id", "ts", "event_id as seq", "event_type as stage", "case when event_id % 7 = 0 then 'failed' else 'ok' end as event", "concat('f', user_id) as filename", "'why' as reason")
    given = events.select("run_id", "filename").distinct()
    given = given.selectExpr("*", "concat('L ', substring(filename, 2)) as first_label", "concat('M ', substring(filename, 2)) as last_label", "substring(filename, -1) = '9' as skipped")
    return report.summary(report.file_results(events, given))


SUMMARY_LABELS = """with f as (select 'r' || (user_id % 5) as run_id, user_id::varchar as u, bool_or(event_id % 7 = 0) as bad from events group by user_id)
select run_id, count(*) as total_files, count(*) filter (where not bad) as fully_succeeded, count(*) filter (where bad) as partially_failed,
  min('L ' || u) filter (where right(u, 1) <> '9') as first_bates, max('M ' || u) filter (where right(u, 1) <> '9') as last_bates from f group by run_id"""


def year_policies(spark, sf_dir):
    """Years of names with two, by each policy."""
    rows = _rows(spark, sf_dir, "orders", "o_orderkey", "concat('a ', 1990 + o_orderkey % 17, ' b ', 1980 + o_custkey % 23, '.pdf') as name")
    years = lambda policy, by_place=False: D.pick_year(D.year_candidates(F.col("name"), 1900, 2099), policy, by_place)["year"]
    return rows.select("o_orderkey", years("first").alias("first"), years("last").alias("last"), years("max").alias("most"), years("last", True).alias("last_by_place"), years("earliest").alias("other"))


YEAR_POLICIES = """with y as (select o_orderkey, (1990 + o_orderkey % 17)::int as a, (1980 + o_custkey % 23)::int as b from orders)
select o_orderkey, a as first, b as last, greatest(a, b) as most, b as last_by_place, a as other from y"""


def organize_content(spark, sf_dir):
    """Years of PDFs that only their first page tells."""
    files = _rows(spark, sf_dir, "orders", "'b' as batch_id", "o_orderkey as ord", "concat('d', o_orderkey, '/doc.pdf') as path", "cast(null as string) as mod_date", "cast(null as string) as creation_date")
    text = "case o_orderkey % 3 when 0 then concat('Signed in ', year(o_orderdate), '.') when 1 then 'No date.' else ' ' end"
    pages = _rows(spark, sf_dir, "orders", "'b' as batch_id", "concat('d', o_orderkey, '/doc.pdf') as path", "1 as page_no", f"{text} as text")
    return organize.with_year(files, pages).select("path", "year", "method", "reason")


ORGANIZE_CONTENT = """select 'd' || o_orderkey || '/doc.pdf' as path, case when o_orderkey % 3 = 0 then year(o_orderdate)::int end as year, case when o_orderkey % 3 = 0 then 'content' else 'none' end as method,
  case o_orderkey % 3 when 0 then 'content-pattern1@pos10' when 1 then 'all-methods-failed:content-content-no-year-found' else 'all-methods-failed:content-content-no-text-extracted' end as reason from orders"""


def password_fall_back(spark, sf_dir):
    """Passwords by name, and one for all others."""
    rows = _rows(spark, sf_dir, "customer", "'b' as batch_id", "c_custkey as ord", "concat('d/', c_name, '.pdf') as path")
    given = rows.where("ord % 2 = 0").select("batch_id", "ord", P.filename(F.col("path")).alias("filename"), F.concat(F.lit("pw"), "ord").alias("password"))
    return scan.passwords(rows, given, all_password="main", fall_back=True)


PASSWORD_FALL_BACK = """select 'b' as batch_id, 'd/' || c_name || '.pdf' as path, case when c_custkey % 2 = 0 then 'pw' || c_custkey else 'main' end as password,
  case when c_custkey % 2 = 0 then 'basename' else 'all' end as password_source from customer"""


def password_texts(spark, sf_dir):
    """Names with a password in a client's JSON."""
    rows = _rows(spark, sf_dir, "customer", "c_custkey", """case when c_custkey % 4 = 0 then '[bad' else concat('{"', c_name, '":"pw","blank":" "}') end as text""")
    return rows.select("c_custkey", F.array_join(F.map_keys(intake.password_map(F.col("text"))), ",").alias("names"))


PASSWORD_TEXTS = "select c_custkey, case when c_custkey % 4 <> 0 then c_name end as names from customer"


def browser_junk(spark, sf_dir):
    """Files that stay by the browser's rule."""
    rows = _rows(spark, sf_dir, "customer", "c_custkey", "case c_custkey % 4 when 0 then concat('__MACOSX/', c_name) when 1 then concat('d/.DS_Store', c_name) when 2 then concat('d/__MACOSX/', c_name) else c_name end as path")
    return rows.where(~P.is_browser_junk(F.col("path")))


BROWSER_JUNK = "select c_custkey, case c_custkey % 4 when 2 then 'd/__MACOSX/' || c_name else c_name end as path from customer where c_custkey % 4 >= 2"


def date_presets(spark, sf_dir):
    """Hits of the presets for dates and dates of birth."""
    text = "case o_orderkey % 3 when 0 then concat('DOB: ', date_format(o_orderdate, 'MM/dd/yyyy')) when 1 then concat('due ', date_format(o_orderdate, 'yyyy-MM-dd')) else 'no. 12-34' end"
    return redact.audit(redact.hits(_pages(spark, sf_dir, text), load_patterns(["Date, Date of Birth"]))).groupBy("file").agg(F.sum("match_count").alias("hits"), F.count(F.lit(1)).alias("patterns"))


DATE_PRESETS = "select o_orderkey || '.pdf' as file, case o_orderkey % 3 when 0 then 2 else 1 end as hits, case o_orderkey % 3 when 0 then 2 else 1 end as patterns from orders where o_orderkey % 3 < 2"


def literal_hits(spark, sf_dir):
    """Hits of a user's words, in any case of letters."""
    return redact.hits(_pages(spark, sf_dir, "o_orderpriority"), load_patterns(literals="urgent, 2-high\n")).select("path", "start", "matched")


LITERAL_HITS = """select o_orderkey || '.pdf' as path, case when o_orderpriority = '1-URGENT' then 2 else 0 end as start, case when o_orderpriority = '1-URGENT' then 'URGENT' else o_orderpriority end as matched
  from orders where o_orderpriority in ('1-URGENT', '2-HIGH')"""


def index_sources(spark, sf_dir):
    """Labels by a sidecar, a client's metadata, or detection: one source a batch."""
    items = _rows(spark, sf_dir, "orders", "concat('b', o_custkey % 3) as batch_id", "o_orderkey as ord", "concat('x/f', o_orderkey, '.pdf') as path")
    n = "lpad(cast(ord as string), 8, '0')"
    records = items.where("batch_id = 'b0'").selectExpr("batch_id", "ord", "path", "'' as rel_dir", "'' as filename", f"concat('S ', {n}) as first_label", "'' as last_label")
    meta = items.where("batch_id <> 'b2'").selectExpr("batch_id", "ord", "'' as name", "path", f"concat('M ', {n}, ' - M 9') as bates_range")
    found = items.selectExpr("batch_id", "path", f"concat('D ', {n}) as first_label", f"concat('D ', {n}) as last_label")
    return index.index_rows(items, records, meta, found).select("batch_id", "ord", "first_label", "last_label", "bates_range")


INDEX_SOURCES = """with i as (select o_custkey % 3 as k, o_orderkey as ord, lpad(o_orderkey::varchar, 8, '0') as n from orders), l as (
  select k, ord, case k when 0 then 'S ' when 1 then 'M ' else 'D ' end || n as a, case k when 1 then 'M 9' when 0 then 'S ' || n else 'D ' || n end as b from i)
select 'b' || k as batch_id, ord, a as first_label, b as last_label, case when a = b then a else a || ' - ' || b end as bates_range from l"""


def package_entries(spark, sf_dir):
    """What a batch's package holds, files that failed left out."""
    rows = _rows(spark, sf_dir, "orders", "concat('b', o_custkey % 9) as batch_id", "concat('f', o_orderkey, '.pdf') as path", "o_orderkey")
    good = report.without_failed(rows, rows.where("o_orderkey % 5 = 0"))
    return results.deliverable(good, index=rows.select("batch_id", F.lit("index.csv").alias("entry_name")), report=rows.select("batch_id", F.lit("report.json").alias("entry_name")))


PACKAGE_ENTRIES = """select 'b' || (o_custkey % 9) as batch_id, 'f' || o_orderkey || '.pdf' as entry_name, 'file' as kind from orders where o_orderkey % 5 <> 0
  union all select distinct 'b' || (o_custkey % 9), 'index.csv', 'index' from orders union all select distinct 'b' || (o_custkey % 9), 'report.json', 'report' from orders"""


def sidecar_anywhere(spark, sf_dir):
    """Records of the first sidecar in any folder that is a list; a batch is a customer's orders."""
    records = _rows(spark, sf_dir, "orders", "concat('c', o_custkey) as batch_id", "o_orderkey as ord", "concat('f', o_orderkey) as path", "concat('A ', o_orderkey) as first_label")
    good = results.sidecar_json(records).select("batch_id", F.lit(1).alias("ord"), F.lit("in/" + P.SIDECARS[0]).alias("path"), "content")
    bad = records.select("batch_id").distinct().select("batch_id", F.lit(0).alias("ord"), F.lit("x/" + P.SIDECARS[0]).alias("path"), F.lit('{"path": 1}').alias("content"))
    return intake.sidecar_records(good.unionByName(bad), anywhere=True).select("batch_id", "ord", "path", "first_label")


SIDECAR_ANYWHERE = """select 'c' || o_custkey as batch_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as ord, 'f' || o_orderkey as path, 'A ' || o_orderkey as first_label from orders"""


def utc_times(spark, sf_dir):
    """Times as text."""
    return _rows(spark, sf_dir, "events", "event_id", "cast(ts as timestamp) as ts").select("event_id", D.iso_utc(F.col("ts")).alias("at"))


UTC_TIMES = "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events"


def path_names(spark, sf_dir):
    """Paths from folder and name, names of outputs, and the last row of each part's name."""
    rows = _rows(spark, sf_dir, "part", "p_partkey", "case p_partkey % 4 when 0 then '.' when 1 then '' when 2 then '/a/b/' else 'c' end as folder", "concat('n', p_size, '.pdf') as name", "p_brand")
    rows = last_by(rows, ["p_brand", "folder", "name"], "p_partkey")
    return rows.select("p_partkey", P.norm_rel_path(F.col("folder"), F.col("name")).alias("path"), P.output_name(F.col("name"), "_done", ".zip").alias("output"), P.safe_zip_name(F.concat(F.lit(" my "), "name"), "files").alias("download"))


PATH_NAMES = """with r as (select p_partkey, p_partkey % 4 as k, 'n' || p_size as n, p_brand from part qualify row_number() over (partition by p_brand, p_partkey % 4, p_size order by p_partkey desc) = 1)
select p_partkey, case k when 2 then 'a/b/' when 3 then 'c/' else '' end || n || '.pdf' as path, n || '_done.zip' as output, 'my_' || n || '.pdf.zip' as download from r"""


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def archive_members(spark, sf_dir):
    """Members of an archive for each of 50 parts of a kind that is asked for; an archive that is none is a row with an error."""

    def pack(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, name in zip(pdf["p_partkey"], pdf["p_name"], strict=True):
                z.writestr(f"d/{i}{'.TXT' if i % 2 else '.doc'}", name)
        bad = pdf["p_partkey"].iloc[0] // 50 % 4 == 3
        return pd.DataFrame({"archive": [f"p{pdf['p_partkey'].iloc[0] // 50}.zip"], "content": [b"PK no" if bad else out.getvalue()]})

    parts = _rows(spark, sf_dir, "part", "p_partkey", "p_name", "p_partkey div 50 as k")
    zipped = parts.groupBy("k").applyInPandas(lambda pdf: pack(pdf.sort_values("p_partkey")), "archive string, content binary")
    return intake.expand(zipped, allowed=(".txt",)).select("archive", "path", "error", F.col("content").cast("string").alias("text"))


ARCHIVE_MEMBERS = """select 'p' || (p_partkey // 50) || '.zip' as archive, 'd/' || p_partkey || '.TXT' as path, null as error, p_name as text from part where p_partkey % 2 = 1 and p_partkey // 50 % 4 <> 3
union all select distinct 'p' || (p_partkey // 50) || '.zip', 'p' || (p_partkey // 50) || '.zip', 'Not a valid ZIP file', null from part where p_partkey // 50 % 4 = 3"""


def password_files(spark, sf_dir):
    """Passwords from lists with a header of these names in any order and case, and from lists without: the first two columns."""
    rows = _rows(spark, sf_dir, "customer", "c_custkey", "concat(' ', c_name, '.pdf') as name", "case when c_custkey % 9 = 0 then null else concat('pw', c_custkey) end as pw", "c_mktsegment as other")
    named, bare = _folder(spark), _folder(spark)
    rows.where("c_custkey % 2 = 0").selectExpr("other", "pw as PassWord", "name as FileName").write.option("header", True).csv(named)
    rows.where("c_custkey % 2 = 1").selectExpr("name as a", "pw as b", "other").write.option("header", True).csv(bare)
    return intake.read_password_list(spark, named).unionByName(intake.read_password_list(spark, bare))


PASSWORD_FILES = "select c_name || '.pdf' as filename, 'pw' || c_custkey as password from customer where c_custkey % 9 <> 0"


def client_lists(spark, sf_dir):
    """What clients say of their files in JSON, a list for each customer; what is no list says nothing."""
    one = F.to_json(F.struct(F.concat(F.lit("f"), "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("p/f"), "o_orderkey")).otherwise("").alias("path"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("q/f"), "o_orderkey")).alias("fullPath"), F.concat(F.lit("A "), "o_orderkey").alias("batesRange")))
    rows = _rows(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", one.alias("one"))
    texts = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "one"))).alias("l"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["one"]), ","), F.lit("]"))
    texts = texts.select(F.concat(F.lit("c"), "o_custkey").alias("batch_id"), F.when(F.col("o_custkey") % 8 == 0, F.get("l", F.lit(0))["one"]).when(F.col("o_custkey") % 8 == 1, "no json").otherwise(whole).alias("text"))
    return intake.client_metadata(texts)


CLIENT_LISTS = """select 'c' || o_custkey as batch_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as ord, 'f' || o_orderkey as name,
  case when o_orderkey % 2 = 0 then 'p/f' || o_orderkey when o_orderkey % 3 > 0 then 'q/f' || o_orderkey end as path, 'A ' || o_orderkey as bates_range from orders where o_custkey % 8 > 1"""


def index_file(spark, sf_dir):
    """The sheet written as CSV and read back; a batch is a month of orders."""
    files = _rows(spark, sf_dir, "orders", "date_format(o_orderdate, 'yyyyMM') as batch_id", "o_orderkey as ord", "concat('a/c', o_custkey % 3, '/f', o_orderkey, '.pdf') as path")
    path = _folder(spark)
    results.write_sheet(index.sheet(index.index_rows(files)), path)
    out = spark.read.option("header", True).schema("batch_id string, row_no long, row_type string, date_text string, text string, bates string").csv(path)
    return out.fillna("")


INDEX_FILE = """with r as (select strftime(o_orderdate, '%Y%m') as b, 'c' || (o_custkey % 3) as c, 'f' || o_orderkey || '.pdf' as f, o_orderkey from orders),
g as (select b, c, count(*) as n, sum(count(*) + 2) over (partition by b order by c) - count(*) - 2 + 4 as head from r group by b, c)
select b as batch_id, (head + row_number() over (partition by b, c order by f, o_orderkey))::bigint as row_no, 'document' as row_type, '2000-01-01' as date_text, f as text, '' as bates from r join g using (b, c)
union all select b, head::bigint, 'category', '', c, '' from g union all select b, (head + n + 1)::bigint, 'blank', '', '', '' from g
union all select distinct b, 3, 'header', 'Date Produced', 'Category & Documents provided', 'Bated labels' from r"""


def year_folders(spark, sf_dir):
    """Organized files written below a folder for each year, and read from these."""
    files = _rows(spark, sf_dir, "orders", "'b' as batch_id", "o_orderkey as ord", "concat('scan ', date_format(o_orderdate, 'yyyy-MM-dd'), case o_orderkey % 4 when 0 then '' else ' x' end, '.pdf') as path", "cast(null as string) as mod_date", "cast(null as string) as creation_date")
    path = _folder(spark)
    results.write_by_folder(organize.organized(files).select("ord", "folder", "placed"), path)
    return spark.read.schema("ord long, placed string, folder string").parquet(path)


YEAR_FOLDERS = """with n as (select o_orderkey as ord, strftime(o_orderdate, '%Y') as folder, 'scan ' || strftime(o_orderdate, '%Y-%m-%d') || case o_orderkey % 4 when 0 then '' else ' x' end as stem from orders)
select ord, folder, stem || case when row_number() over (partition by folder, stem order by ord) = 1 then '' else '__' || (row_number() over (partition by folder, stem order by ord) - 1) end || '.pdf' as placed from n"""


def stripped_names(spark, sf_dir):
    """Names without the label in front, and the year that is left in them."""
    rows = _rows(spark, sf_dir, "orders", "o_orderkey", "concat(case o_orderkey % 4 when 0 then concat('ABC', 100000 + o_custkey, ' - ') when 1 then 'Report' when 2 then 'A12 ' else '' end, year(o_orderdate), '.pdf') as name")
    bare = D.without_label(F.col("name"))
    return rows.select("o_orderkey", bare.alias("bare"), D.year_of(bare, 1900, 2099, "first")["year"].alias("year"))


STRIPPED_NAMES = """select o_orderkey, case o_orderkey % 4 when 1 then 'pdf' when 2 then 'A12 ' || year(o_orderdate) || '.pdf' else year(o_orderdate) || '.pdf' end as bare, case when o_orderkey % 4 <> 1 then year(o_orderdate)::int end as year from orders"""


def long_literals(spark, sf_dir):
    """Matches of blanks do not count; those of more than sixty characters count, but are not covered."""
    pages = _pages(spark, sf_dir, "concat('x    y ', repeat('L', 55 + o_orderkey % 10), ' z')")
    found = redact.hits(pages, load_patterns(regexes=r"[ ]{3,}|L+"))
    n = redact.hits_by_file(found).select("path", "hits")
    return redact.masked(pages, found).select("path", "redacted").join(n.hint("merge"), "path")


LONG_LITERALS = """select o_orderkey || '.pdf' as path, 'x    y ' || repeat(case when o_orderkey % 10 < 6 then '█' else 'L' end, (55 + o_orderkey % 10)::int) || ' z' as redacted, 1 as hits from orders"""


def password_modes(spark, sf_dir):
    """One password for all files, and none."""
    rows = _rows(spark, sf_dir, "customer", "'b' as batch_id", "c_custkey as ord", "c_name as path")
    given = rows.select("batch_id", "ord", F.col("path").alias("filename"), F.lit("own").alias("password"))
    out = scan.passwords(rows, given, "all", "main").withColumn("mode", F.lit("all"))
    return out.unionByName(scan.passwords(rows, given, "none", "main").withColumn("mode", F.lit("none"))).unionByName(scan.passwords(rows, given, "all", "").withColumn("mode", F.lit("empty")))


PASSWORD_MODES = """select 'b' as batch_id, c_name as path, case mode when 'all' then 'main' end as password, case mode when 'all' then 'all' else 'none' end as password_source, mode from customer, (select unnest(['all', 'none', 'empty']) as mode)"""

QUERIES = {
    "detect_blacklist": (detect_blacklist, DETECT_BLACKLIST),
    "detect_browser": (detect_browser, DETECT_BROWSER),
    "assign_again": (assign_again, ASSIGN_AGAIN),
    "summary_labels": (summary_labels, SUMMARY_LABELS),
    "year_policies": (year_policies, YEAR_POLICIES),
    "organize_content": (organize_content, ORGANIZE_CONTENT),
    "password_fall_back": (password_fall_back, PASSWORD_FALL_BACK),
    "password_texts": (password_texts, PASSWORD_TEXTS),
    "browser_junk": (browser_junk, BROWSER_JUNK),
    "date_presets": (date_presets, DATE_PRESETS),
    "literal_hits": (literal_hits, LITERAL_HITS),
    "index_sources": (index_sources, INDEX_SOURCES),
    "package_entries": (package_entries, PACKAGE_ENTRIES),
    "sidecar_anywhere": (sidecar_anywhere, SIDECAR_ANYWHERE),
    "utc_times": (utc_times, UTC_TIMES),
    "archive_members": (archive_members, ARCHIVE_MEMBERS),
    "password_files": (password_files, PASSWORD_FILES),
    "client_lists": (client_lists, CLIENT_LISTS),
    "index_file": (index_file, INDEX_FILE),
    "year_folders": (year_folders, YEAR_FOLDERS),
    "stripped_names": (stripped_names, STRIPPED_NAMES),
    "long_literals": (long_literals, LONG_LITERALS),
    "password_modes": (password_modes, PASSWORD_MODES),
    "path_names": (path_names, PATH_NAMES),
}
