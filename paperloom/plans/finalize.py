"""The finished batch: index, report and manifest from one table of its files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import paths as P
from paperloom.operators.storage import joined_small, written
from paperloom.plans import index, report
from paperloom.sources import results

# Names of what a package holds beside the files.
INDEX_NAME, AUDIT_NAME, REPORT_NAME = "discovery_index.xlsx", "_redaction_audit.json", "_pipeline_report.json"


def records_by_path(records: DataFrame) -> DataFrame:
    """A run's label records (batch_id, ord, rel_dir, filename, first_label, last_label) as ``index.sidecar_table`` takes them: the path is folder and name."""
    folder = F.trim(F.replace(F.coalesce("rel_dir", F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    path = F.when(folder.isin("", "."), F.coalesce("filename", F.lit(""))).otherwise(F.concat(folder, F.lit("/"), F.coalesce("filename", F.lit(""))))
    return records.select("batch_id", "ord", P.norm_key(path).alias("path"), folder.alias("rel_dir"), "filename", "first_label", "last_label")


def finished(files: DataFrame, records: DataFrame, events: DataFrame, failures: DataFrame, meta: DataFrame | None = None, detected: DataFrame | None = None, default_date: dt.date = dt.date(2000, 1, 1)) -> DataFrame:
    """A row a file that no stage has failed, once: labels, range, date, and the stages it went through. A written table.

    ``files``: batch_id, ord, path, source_path (its path when it came in; stages know it by that). A batch takes its labels from its records if it has any,
    else from the client's metadata, else from detection. ``events``: see ``report.stage_elapsed``, a run being a batch; ``failures``: batch_id, path. Files
    that share a path each stay.
    """
    good = report.without_failed(files, failures)
    rows = index.index_rows(good, records_by_path(records), meta, detected, default_date, also=("source_path",))
    stages = report.file_results(events).select(F.col("run_id").alias("batch_id"), F.col("filename").alias("source_path"), "stages_ok", "stages_failed")
    return written(rows.join(stages.hint("merge"), ["batch_id", "source_path"], "left"), "finished")


def totals(rows: DataFrame, failures: DataFrame, events: DataFrame) -> DataFrame:
    """(batch_id, total_files, fully_succeeded, partially_failed, first_bates, last_bates, stages, seconds) of ``finished`` rows and what failed.

    A file is whole if no stage failed it; those in ``failures`` are not. The least and greatest label are by text.
    """
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    whole = F.coalesce(F.size("stages_failed"), F.lit(0)) <= 0
    out = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("ok"), F.min(own("first_label")).alias("first_bates"), F.max(own("last_label")).alias("last_bates"))
    lost = failures.select("batch_id", "path").distinct().groupBy("batch_id").agg(F.count(F.lit(1)).alias("lost"))
    took = report.stage_elapsed(events).groupBy(F.col("run_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("stages"), F.round(F.sum("elapsed_s"), 3).alias("seconds"))
    both = out.join(lost.hint("merge"), "batch_id", "full").join(took.hint("merge"), "batch_id", "left")
    n, ok, gone = (F.coalesce(c, F.lit(0)) for c in ("n", "ok", "lost"))
    return both.select("batch_id", (n + gone).alias("total_files"), ok.alias("fully_succeeded"), (n + gone - ok).alias("partially_failed"), "first_bates", "last_bates", F.coalesce("stages", F.lit(0)).alias("stages"), "seconds")


def manifest(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(batch_id, entry_name, kind) of each batch's package: its files, the index, the audit if there is one, the report."""
    batches = written(rows.select("batch_id").distinct(), "batches")
    named = lambda df, name: df.select("batch_id", F.lit(name).alias("entry_name"))
    audited = joined_small(audit.select("batch_id").distinct(), batches, ["batch_id"], "left_semi")
    return results.deliverable(rows, index=named(batches, INDEX_NAME), audit=named(audited, AUDIT_NAME), report=named(batches, REPORT_NAME))
