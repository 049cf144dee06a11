"""Queries of whole batches, with their SQL: archives in archives, validation, passes of redaction, and the finished batch."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import paths as P
from paperloom.functions.patterns import load_patterns
from paperloom.operators.collisions import free_names
from paperloom.operators.storage import shared_dir
from paperloom.plans import finalize, passes, report, validate
from paperloom.sources import intake, results


def _zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Forty documents as an archive that holds others, one of them broken, and what a Mac leaves."""

    def pack(members) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in members:
                z.writestr(name, content)
        return out.getvalue()

    docs = [(f"d/{i}.txt", (t or "").encode()) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
    part = lambda k: [d for i, d in zip(pdf["doc_id"], docs, strict=True) if i % 4 == k]
    inner = pack([("deep.ZIP", pack(part(1))), *part(0)])
    whole = pack([*part(2), ("x/in.zip", inner), *part(3), ("bad.zip", b"no archive"), ("__MACOSX/._x", b"junk"), ("d/", b"")])
    return pd.DataFrame({"archive": [f"a{pdf['doc_id'].iloc[0] // 40}.zip"], "content": [whole]})


def _archives(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    return docs.withColumn("k", F.expr("doc_id div 40")).groupBy("k").applyInPandas(lambda pdf: _zipped(pdf.sort_values("doc_id")), "archive string, content binary")


def nested_archives(spark, sf_dir):
    """All documents from archives in archives in archives, and the archives that are none."""
    members, failures = intake.expand_all(_archives(spark, sf_dir))
    none = F.lit(None).cast("string")
    rows = members.select("batch_id", "within", "path", "size_bytes", F.sha2("content", 256).alias("sha256"), none.alias("reason"))
    return rows.unionByName(failures.select("batch_id", none.alias("within"), "path", F.lit(None).cast("long").alias("size_bytes"), none.alias("sha256"), "reason"))


NESTED_SQL = """with d as (select 'a' || (doc_id // 40) || '.zip' as a, doc_id, doc_id % 4 as k, coalesce(text, '') as text from documents where doc_id is not null)
select a as batch_id, a || case k when 0 then '!x/in.zip' when 1 then '!x/in.zip!deep.ZIP' else '' end as within, 'd/' || doc_id || '.txt' as path, strlen(text) as size_bytes, sha256(text) as sha256, null as reason from d
union all select distinct a, null, 'bad.zip', null, null, 'Not a valid ZIP file' from d"""


def batch_validation(spark, sf_dir):
    """What is wrong with each batch, and how many files the others bring."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = orders.where("o_custkey % 10 <> 9").selectExpr(
        "concat('c', o_custkey) as batch_id", "o_orderkey as ord", "case when o_orderkey % 40 = 0 then concat(o_orderkey, '.doc') when o_orderkey % 60 = 1 then concat(o_orderkey, '.zip') else concat(o_orderkey, '.pdf') end as path",
        "cast(null as string) as within", "case when o_orderkey % 60 = 1 then 'Not a valid ZIP file' end as error",
    )
    of = F.col("o_custkey")
    settings = orders.select(F.concat(F.lit("c"), "o_custkey").alias("batch_id"), "o_custkey").distinct().select(
        "batch_id", F.when(of % 7 == 0, " , Nothing").otherwise("SSN, Email").alias("presets"),
        F.when((of % 7 == 0) & (of % 2 == 0), "# none\n\n").when(of % 11 == 0, "ok\\d+\n(open").alias("regexes"), F.lit(None).cast("string").alias("literals"),
    )
    accepted, failures = validate.judged(files, validate.violations(files, settings, validate.upload_rules()))
    good = accepted.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"))
    none = F.lit(None).cast("string")
    out = good.select("batch_id", "files", none.alias("path"), none.alias("reason"), F.lit(0).cast("long").alias("violations"))
    return out.unionByName(failures.select("batch_id", F.lit(0).cast("long").alias("files"), "path", "reason", "violations"))


VALIDATION_SQL = """with v as (
  select o_custkey, o_orderkey as ord, case when o_orderkey % 60 = 1 then o_orderkey || '.zip' else o_orderkey || '.doc' end as path,
    case when o_orderkey % 60 = 1 then '''' || o_orderkey || '.zip'' is not a valid ZIP.' else '''' || o_orderkey || '.doc'' is not supported. Upload PDF or ZIP files only.' end as reason, 'k' as rule
  from orders where o_custkey % 10 <> 9 and (o_orderkey % 40 = 0 or o_orderkey % 60 = 1)
  union all select distinct o_custkey, -1, null, 'No PDF files found in the upload.', 'empty' from orders where o_custkey % 10 = 9
  union all select distinct o_custkey, -1, null, 'give at least one preset, regex or literal', 'patterns' from orders where o_custkey % 7 = 0 and (o_custkey % 2 = 0 or o_custkey % 11 <> 0)
  union all select distinct o_custkey, -1, null, 'not a pattern: (open', 'regex' from orders where o_custkey % 11 = 0 and not (o_custkey % 7 = 0 and o_custkey % 2 = 0)
), first as (
  select *, count(*) over (partition by o_custkey) as n from v qualify row_number() over (partition by o_custkey order by ord, rule) = 1
)
select 'c' || o_custkey as batch_id, 0 as files, path, reason, n as violations from first
union all select 'c' || o_custkey, count(*), null, null, 0 from orders where o_custkey % 10 <> 9 and o_custkey not in (select o_custkey from v) group by o_custkey"""

def free_file_names(spark, sf_dir):
    """Names of files in customers' folders, where names bring numbers of their own, before and after these are given."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "'b' as batch_id", "o_orderkey as ord", "concat('c', o_custkey) as folder",
        "case o_orderkey % 4 when 2 then concat('doc__', 1 + o_orderkey div 4 % 3, '.pdf') when 3 then 'doc__1__1.pdf' else 'doc.pdf' end as name",
    )
    return free_names(rows).select("ord", "folder", "placed")


NAMES_SQL = """with recursive f as (
  select 'c' || o_custkey as folder, o_orderkey as ord, case o_orderkey % 4 when 2 then 'doc__' || (1 + o_orderkey // 4 % 3) when 3 then 'doc__1__1' else 'doc' end as stem,
    row_number() over (partition by o_custkey order by o_orderkey) as k from orders
), step as (
  select folder, ord, k, stem as placed, [stem] as taken from f where k = 1
  union all select folder, ord, k, placed, list_append(taken, placed) from (
    select f.folder, f.ord, f.k, s.taken, list_filter(list_concat([f.stem], list_transform(range(1, len(s.taken) + 2), lambda i: f.stem || '__' || i)), lambda n: not list_contains(s.taken, n))[1] as placed
    from step s join f on f.folder = s.folder and f.k = s.k + 1)
) select ord, folder, placed || '.pdf' as placed from step"""

# Passes of redaction ------------------------------------------------------------------------------------------------

LINES = """concat('tel. 555-', lpad(cast(o_orderkey % 999 as string), 3, '0'), '-', lpad(cast(o_custkey % 9999 as string), 4, '0'), ' mail m', o_custkey, '@x.org no. ', lpad(cast(o_orderkey % 99999999 as string), 8, '0'))"""


def _run(spark, sf_dir) -> str:
    """A run in three passes, the last one done twice: by text for two of three orders, by words for the third."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("concat('b', o_custkey % 5) as batch_id", "o_orderkey as ord", "concat(o_orderkey, '.pdf') as path", "1L as page_no", f"{LINES} as text")
    store, by_words = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", F.col("ord") % 3 == 0
    words = rows.where(by_words).select("batch_id", "path", "page_no", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    passes.begin(store, "r", rows.withColumn("text", F.when(~by_words, F.col("text"))), words, rows)
    for k, preset in ((1, "Phone"), (2, "Email"), (2, "Email"), (3, "8-digit number,Phone"), (3, "8-digit number,Email")):
        passes.redact_pass(spark, store, "r", k, load_patterns([preset]), keep_last=4 if k == 1 else 0)
    return store


def redact_passes(spark, sf_dir):
    """Texts after three passes."""
    return passes.pages_of(spark, _run(spark, sf_dir), "r", 3).where("text is not null").select("batch_id", "path", "text")


_LINE_SQL = """lines as (
  select 'b' || (o_custkey % 5) as batch_id, o_orderkey, o_orderkey || '.pdf' as path, 'm' || o_custkey || '@x.org' as mail, lpad((o_custkey % 9999)::varchar, 4, '0') as last from orders
)"""
PASSES_SQL = f"""with {_LINE_SQL} select batch_id, path, 'tel. ' || repeat('█', 8) || last || ' mail ' || repeat('█', length(mail)) || ' no. ' || repeat('█', 8) as text from lines where o_orderkey % 3 <> 0"""


def pass_hits(spark, sf_dir):
    """Hits of each pass and batch, and the entries of the audit, which is the last pass's."""
    store = _run(spark, sf_dir)
    found = passes.hits_of(spark, store, "r").groupBy("batch_id", F.col("pass_no").cast("string").alias("pass"), "source").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(passes.audit_of(spark, store, "r").groupBy("batch_id").agg(F.sum("match_count").alias("n")).select("batch_id", F.lit("audit").alias("pass"), F.lit("").alias("source"), "n"))


PASS_HITS_SQL = f"""with {_LINE_SQL} select batch_id, pass, case when o_orderkey % 3 = 0 then 'words' else 'text' end as source, count(*) as n from lines, (select unnest(['1', '2', '3']) as pass) group by all
union all select batch_id, 'audit', '', count(*) from lines group by batch_id"""

# The finished batch -------------------------------------------------------------------------------------------------

FINISHED_SQL = """
f as (
  select 'b' || (o_custkey % 4) as batch_id, o_custkey % 4 as b, o_orderkey as ord, strftime(o_orderdate, '%Y-%m-%d') || '/c' || (o_custkey % 3) || '/f' || o_orderkey || '.pdf' as path, o_orderkey,
    o_orderdate::date as day, 'c' || (o_custkey % 3) as category, o_orderkey % 9 = 4 as lost from orders
), rows as (
  select *, case when b = 0 then 'R ' || lpad(o_orderkey::varchar, 7, '0') when b = 1 then 'M ' || lpad(o_orderkey::varchar, 7, '0') when b = 2 then 'D ' || lpad(o_orderkey::varchar, 7, '0') else '' end as first_label from f where not lost
)"""


def _batch(spark, sf_dir):
    """Files, records of the first batch, metadata of the second, detection of the others but the last, events and failures."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = orders.selectExpr(
        "concat('b', o_custkey % 4) as batch_id", "o_orderkey as ord", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), '/c', o_custkey % 3, '/f', o_orderkey, '.pdf') as path", "concat('in/', o_orderkey) as source_path", "o_orderkey", "o_custkey % 4 as b", "o_orderdate"
    )
    label = lambda p: F.concat(F.lit(p), F.lpad(F.col("o_orderkey").cast("string"), 7, F.lit("0")))
    records = files.where("b = 0").select("batch_id", "ord", P.rel_dir(F.col("path")).alias("rel_dir"), P.filename(F.col("path")).alias("filename"), label("R ").alias("first_label"), F.lit("").alias("last_label"))
    meta = files.where("b < 2").select("batch_id", "ord", F.lit(None).cast("string").alias("name"), "path", label("M ").alias("bates_range"))
    found = files.where("b < 3").select("batch_id", "path", label("D ").alias("first_label"), label("D ").alias("last_label"))
    events = files.select(F.col("batch_id").alias("run_id"), F.col("o_orderdate").alias("ts"), F.col("ord").alias("seq"), F.explode(F.array(F.lit("unlock"), F.lit("redact"))).alias("stage"), F.col("source_path").alias("filename"), "o_orderkey")
    events = events.select("run_id", "ts", "seq", "stage", F.when((F.col("stage") == "redact") & (F.col("o_orderkey") % 5 == 0), "failed").otherwise("ok").alias("event"), "filename", F.lit("why").alias("reason"))
    spans = orders.groupBy(F.expr("concat('b', o_custkey % 4)").alias("run_id")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    ends = spans.select("run_id", F.explode(F.array(F.struct(F.col("start").alias("ts"), F.lit("start").alias("event")), F.struct(F.col("end").alias("ts"), F.lit("end").alias("event")))).alias("e")).select("run_id", "e.ts", F.lit(0).cast("long").alias("seq"), F.lit("redact").alias("stage"), "e.event", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("reason"))
    lost = files.where("o_orderkey % 9 = 4").select("batch_id", "path")
    return finalize.finished(files.select("batch_id", "ord", "path", "source_path"), records, events.unionByName(ends), lost, meta, found), lost, events.unionByName(ends)


def finished_index(spark, sf_dir):
    """The index of the finished batches: labels by the batch's source, dates by folders, and the stages of each file."""
    rows, _, _ = _batch(spark, sf_dir)
    failed = F.array_join(F.map_keys("stages_failed"), ",")
    return rows.select("batch_id", "path", "category", "bates_range", "date_produced", F.array_join("stages_ok", ",").alias("ok"), failed.alias("failed"))


FINISHED_INDEX_SQL = f"""with {FINISHED_SQL} select batch_id, path, category, first_label as bates_range, day as date_produced,
  case when o_orderkey % 5 = 0 then 'unlock' else 'redact,unlock' end as ok, case when o_orderkey % 5 = 0 then 'redact' else '' end as failed from rows"""


def finished_totals(spark, sf_dir):
    """What the report of each finished batch says."""
    rows, lost, events = _batch(spark, sf_dir)
    return finalize.totals(rows, lost, events)


FINISHED_TOTALS_SQL = f"""with {FINISHED_SQL}, t as (select batch_id, count(*) as n, count(*) filter (where lost) as gone, max(day) - min(day) as days from f group by batch_id),
g as (select batch_id, count(*) filter (where o_orderkey % 5 <> 0) as ok, min(nullif(first_label, '')) as a, max(nullif(first_label, '')) as b from rows group by batch_id)
select batch_id, n as total_files, ok as fully_succeeded, n - ok as partially_failed, a as first_bates, b as last_bates, 1 as stages, days * 86400.0 as seconds from t join g using (batch_id)"""


def finished_package(spark, sf_dir):
    """What the packages hold; only the first batches have an audit."""
    rows, _, _ = _batch(spark, sf_dir)
    return finalize.manifest(rows, rows.where("batch_id < 'b2'").select("batch_id"))


FINISHED_PACKAGE_SQL = f"""with {FINISHED_SQL} select batch_id, path as entry_name, 'file' as kind from rows union all select distinct batch_id, 'discovery_index.xlsx', 'index' from rows
union all select distinct batch_id, '_redaction_audit.json', 'audit' from rows where b < 2 union all select distinct batch_id, '_pipeline_report.json', 'report' from rows"""

def report_entries(spark, sf_dir):
    """Reports of all users' runs, each an array over many files, read back: stages in the order of their starts, then files by name."""
    kind = "case event_id % 4 when 0 then 'start' when 1 then 'end' when 2 then 'ok' else case when event_id % 3 = 0 then 'failed' else 'ok' end end"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('r', user_id % 40) as run_id", "ts", "event_id as seq", "event_type as stage", f"{kind} as event", "case when event_id % 4 >= 2 then concat('f', user_id) end as filename", "concat('why ', event_id) as reason")
    rows, path = report.in_order(report.file_results(events), report.stage_elapsed(events)), f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    results.write_json_array(rows.withColumn("no", F.col("place")), path)
    out = results.read_json_array(spark, path, "no long, kind string, name string, stages_ok array<string>, stages_failed map<string,string>, elapsed_s double")
    failed = F.array_join(F.array_sort(F.transform(F.map_entries("stages_failed"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("batch_id", "no", "kind", "name", F.array_join("stages_ok", ",").alias("ok"), failed.alias("failed"), "elapsed_s")


REPORT_ENTRIES_SQL = """with ev as (
  select 'r' || (user_id % 40) as run_id, ts, event_id as seq, event_type as stage, case event_id % 4 when 0 then 'start' when 1 then 'end' when 2 then 'ok' else case when event_id % 3 = 0 then 'failed' else 'ok' end end as event,
    case when event_id % 4 >= 2 then 'f' || user_id end as filename, 'why ' || event_id as reason from events
), f as (
  select run_id, filename, stage, min(seq) filter (where event = 'ok') as ok, max_by(reason, seq) filter (where event = 'failed') as why from ev where filename is not null group by all
), files as (
  select run_id, 1 as last, null::timestamp as started, 'file' as kind, filename as name, coalesce(string_agg(stage, ',' order by ok) filter (where ok is not null), '') as ok,
    coalesce(string_agg(stage || '=' || why, ';' order by stage || '=' || why) filter (where why is not null), '') as failed, null::double as elapsed_s from f group by run_id, filename
), s as (
  select run_id, stage, min(ts) filter (where event = 'start') as started, max(ts) filter (where event = 'start') as a, max(ts) filter (where event = 'end') as b from ev where event in ('start', 'end') group by all
), rows as (
  select * from files union all select run_id, 0, started, 'stage', stage, null, null, case when b >= a then round((epoch_us(b) - epoch_us(a)) / 1e6, 3) end from s
) select run_id as batch_id, row_number() over (partition by run_id order by last, started nulls first, name) - 1 as no, kind, name, ok, failed, elapsed_s from rows"""

QUERIES = {
    "nested_archives": (nested_archives, NESTED_SQL),
    "batch_validation": (batch_validation, VALIDATION_SQL),
    "free_file_names": (free_file_names, NAMES_SQL),
    "report_entries": (report_entries, REPORT_ENTRIES_SQL),
    "redact_passes": (redact_passes, PASSES_SQL),
    "pass_hits": (pass_hits, PASS_HITS_SQL),
    "finished_index": (finished_index, FINISHED_INDEX_SQL),
    "finished_totals": (finished_totals, FINISHED_TOTALS_SQL),
    "finished_package": (finished_package, FINISHED_PACKAGE_SQL),
}
