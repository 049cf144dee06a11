"""Validation of batches before any work: rules as rows, all violations at once, and the veto of one on its whole batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import paths as P
from paperloom.functions.patterns import PRESETS
from paperloom.operators.storage import joined_small, written
from paperloom.sources.intake import BAD_ARCHIVE

# What users are told, with the file's name in the place of {}.
NOT_SUPPORTED = "'{}' is not supported. Upload PDF or ZIP files only."
NO_ARCHIVE = "'{}' is not a valid ZIP."
EMPTY = "No PDF files found in the upload."


@dataclass(frozen=True)
class Rule:
    """A file of a batch breaks a rule where ``broken`` holds; ``reason`` has {} for its path."""

    name: str
    reason: str
    broken: Column

    def told(self) -> Column:
        head, _, tail = self.reason.partition("{}")
        said = F.concat(F.lit(head), "path", F.lit(tail)) if "{}" in self.reason else F.lit(self.reason)
        return F.when(F.coalesce(self.broken, F.lit(False)), F.struct(F.lit(self.name).alias("rule"), said.alias("reason")))


def upload_rules(allowed: tuple[str, ...] = (*P.PDF, ".zip")) -> list[Rule]:
    """The rules for files of an upload: archives that are none, and kinds that are not ``allowed``. A file breaks the first that applies."""
    bad = F.col("error") == BAD_ARCHIVE
    return [Rule("archive", NO_ARCHIVE, bad), Rule("kind", NOT_SUPPORTED, F.col("within").isNull() & ~bad.eqNullSafe(F.lit(True)) & ~P.ext(F.col("path")).isin(*allowed))]


def bad_regexes(block: Column) -> Column:
    """The first line of a block of patterns that Python cannot compile, null if all are good; blank and ``#`` lines are ignored."""
    import re

    def first(text):
        for line in (text or "").splitlines():
            line = line.strip()
            if line and line[0] != "#":
                try:
                    re.compile(line)
                except re.error:
                    return line
        return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(first).astype(object)

    return run(block)


def violations(files: DataFrame, settings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(batch_id, ord, path, rule, reason): all that is wrong, in one pass over the files and one over the settings.

    ``files``: batch_id, ord, path, within (null for what was uploaded by itself), error. ``settings``: a row a batch: batch_id, presets, regexes, literals, where
    null is none. A batch without files but junk breaks ``empty``, one without a pattern ``patterns``, one with a bad expression ``regex``;
    these come first and have no path. Files of batches without settings are judged by the rules alone.
    """
    rows = files.where(~P.is_junk(F.col("path"))).select("batch_id", "ord", "path", "within", "error")
    each = rows.withColumn("v", F.coalesce(*[r.told() for r in rules])).where("v is not null").select("batch_id", "ord", "path", "v.*")
    preset = F.exists(F.split("presets", ","), lambda x: F.trim(x).isin(*PRESETS))
    regex = F.exists(F.split("regexes", r"\R"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    literal = F.regexp_replace("literals", r"[,\s]", "") != ""
    nothing = ~F.coalesce(preset, F.lit(False)) & ~F.coalesce(regex, F.lit(False)) & ~F.coalesce(literal, F.lit(False))
    there = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    own = settings.join(there.hint("merge"), "batch_id", "left").withColumn("bad", bad_regexes(F.col("regexes")))
    said = lambda cond, rule, text: F.when(cond, F.struct(F.lit(rule).alias("rule"), text.alias("reason")))
    found = F.array(
        said(F.col("n").isNull(), "empty", F.lit(EMPTY)), said(nothing, "patterns", F.lit("give at least one preset, regex or literal")),
        said(F.col("bad").isNotNull(), "regex", F.concat(F.lit("not a pattern: "), "bad")),
    )
    whole = own.select("batch_id", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v"))
    return each.unionByName(whole.select("batch_id", F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("path"), "v.*"))


def judged(files: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, failures): files of batches without violations, and for each batch with some a row (batch_id, path, stage, reason, violations), the first by ord."""
    found = written(found, "violations")
    vetoed = written(found.select("batch_id").distinct(), "vetoed")
    first = F.min_by(F.struct("path", "reason"), F.struct("ord", "rule"))
    failures = found.groupBy("batch_id").agg(first.alias("x"), F.count(F.lit(1)).alias("violations"))
    return joined_small(files, vetoed, ["batch_id"], "left_anti"), failures.select("batch_id", "x.path", F.lit("validate").alias("stage"), "x.reason", "violations")
