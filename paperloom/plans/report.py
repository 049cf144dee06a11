"""Run report from the events of a run's stages. Files keep the name they came with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.numbering import running_before

RUN = ["run_id"]


def stage_elapsed(events: DataFrame) -> DataFrame:
    """(run_id, stage, started, elapsed_s): from a stage's latest start to its latest end after it, in order of first starts.

    ``events``: run_id, ts, seq, stage, event (start, end, ok, failed), filename, reason.
    """
    ends = events.where("event in ('start', 'end')")
    at = lambda kind, f: f(F.when(F.col("event") == kind, F.col("ts")))
    out = ends.groupBy(*RUN, "stage").agg(at("start", F.min).alias("started"), at("start", F.max).alias("_start"), at("end", F.max).alias("_end"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = F.round((micros("_end") - micros("_start")) / 1e6, 3)
    return out.select(*RUN, "stage", "started", F.when(F.col("_end") >= F.col("_start"), seconds).alias("elapsed_s"))


def file_results(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per file: stages that went well, in order; failed ones with their last reason; labels if given (run_id, filename, ...)."""
    rows = events.where("filename is not null and event in ('ok', 'failed')")
    last = rows.groupBy(*RUN, "filename", "stage").agg(F.min(F.when(F.col("event") == "ok", F.col("seq"))).alias("_ok"), F.max_by(F.when(F.col("event") == "failed", F.coalesce("reason", F.lit(""))), F.when(F.col("event") == "failed", F.col("seq"))).alias("_why"))
    ok = F.sort_array(F.collect_list(F.when(F.col("_ok").isNotNull(), F.struct("_ok", "stage"))))
    failed = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_why").isNotNull(), F.struct("stage", "_why")))))
    out = last.groupBy(*RUN, "filename").agg(F.transform(ok, lambda x: x["stage"]).alias("stages_ok"), failed.alias("stages_failed"))
    return out if labels is None else out.join(labels.hint("merge"), [*RUN, "filename"], "left")


def summary(results: DataFrame) -> DataFrame:
    """Counts of a run's files, and the least and greatest label as text."""
    failed = F.size("stages_failed") > 0
    columns = [F.count(F.lit(1)).alias("total_files"), F.count_if(~failed).alias("fully_succeeded"), F.count_if(failed).alias("partially_failed")]
    if "first_label" in results.columns:
        own = lambda c: F.when(~F.coalesce("skipped", F.lit(False)), F.nullif(F.col(c), F.lit("")))
        columns += [F.min(own("first_label")).alias("first_bates"), F.max(own("last_label")).alias("last_bates")]
    return results.groupBy(*RUN).agg(*columns)


def report_json(results: DataFrame, elapsed: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """(run_id, report): one JSON text a run."""
    by_name = lambda a, b: F.when(a["filename"] < b["filename"], -1).when(a["filename"] > b["filename"], 1).otherwise(0)
    files = results.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("filename", "stages_ok", "stages_failed")), by_name).alias("files"))
    times = F.transform(F.sort_array(F.collect_list(F.struct("started", "stage", "elapsed_s"))), lambda x: F.struct(x["stage"], x["elapsed_s"]))
    times = elapsed.groupBy(*RUN).agg(F.map_from_entries(times).alias("stage_elapsed_s"))  # in the order of first starts
    given = F.create_map(*[F.lit(x) for kv in (settings or {}).items() for x in map(str, kv)]) if settings else F.expr("cast(map() as map<string,string>)")
    out = summary(results).join(files.hint("merge"), RUN).join(times.hint("merge"), RUN, "left")
    return out.select("run_id", F.to_json(F.struct(*[c for c in out.columns], given.alias("settings"))).alias("report"))


def in_order(results: DataFrame, elapsed: DataFrame) -> DataFrame:
    """(batch_id, place, kind, name, stages_ok, stages_failed, elapsed_s): a run's report as entries, a run of any size, for ``write_json_array``.

    First its stages in the order of their first starts, then its files by name; ``report_json`` has the same in one row.
    """
    none = lambda kind: F.lit(None).cast(kind)
    files = results.select("run_id", F.lit("file").alias("kind"), F.col("filename").alias("name"), "stages_ok", "stages_failed", none("double").alias("elapsed_s"), none("timestamp").alias("_at"))
    stages = elapsed.select("run_id", F.lit("stage").alias("kind"), F.col("stage").alias("name"), none("array<string>").alias("stages_ok"), none("map<string,string>").alias("stages_failed"), "elapsed_s", F.col("started").cast("timestamp").alias("_at"))
    rows = stages.unionByName(files).withColumn("_last", (F.col("kind") == "file").cast("int")).withColumn("_one", F.lit(1))
    out = running_before(rows, "_one", ["_last", "_at", "name"], RUN, "place")
    return out.select(F.col("run_id").alias("batch_id"), "place", "kind", "name", "stages_ok", "stages_failed", "elapsed_s")


def delivery(entries: DataFrame) -> DataFrame:
    """(batch_id, files, single): the file to hand out bare, if a batch has one file alone and it is a PDF or image."""
    from paperloom.functions import paths as P

    own = entries.where(~P.is_sidecar(F.col("path")))
    count = own.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.max("path").alias("_one"))
    alone = (F.col("files") == 1) & P.ext(F.col("_one")).isin(*P.PDF, *P.LABEL_IMAGES)
    return count.select("batch_id", "files", F.when(alone, F.col("_one")).alias("single"))


def without_failed(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows of files that no stage has failed."""
    return rows.join(failures.select("batch_id", "path").distinct().hint("merge"), ["batch_id", "path"], "left_anti")


def merged_failures(stages: list[DataFrame]) -> DataFrame:
    """Failures (batch_id, path, reason) of stages in order: a file's first reason stays."""
    rows = None
    for k, df in enumerate(stages):
        part = df.select("batch_id", "path", "reason").withColumn("_k", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("batch_id", "path").agg(F.min_by("reason", F.struct("_k", "reason")).alias("reason"))


def failures_header(failures: DataFrame) -> DataFrame:
    """(batch_id, header): path to reason as one ASCII JSON text."""
    one = failures.groupBy("batch_id", "path").agg(F.min("reason").alias("reason"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "reason"))))
    return one.groupBy("batch_id").agg(F.to_json(pairs, {"writeNonAsciiCharacterAsCodePoint": "true"}).alias("header"))
