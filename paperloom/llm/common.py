"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.tokens import forget
from paperloom.operators.storage import discard, joined_small, shared_dir, written

__all__ = ["BLANKS", "BLANK_RUN", "WORD", "discard", "fresh", "give_back", "joined_small", "partitions", "rested", "shared_dir", "table", "word_count", "words", "written"]

#: Characters that separate words in every contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same set for Java and Python regular expressions.
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; empty for null or blank text."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def give_back() -> None:
    """Return this worker's free memory to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rested(over_batches):
    """A function for ``mapInArrow`` whose worker holds no more than it must, before and after.

    Idle workers stay beside an executor until they are used again, so what one keeps adds to the memory of later stages.
    """

    @wraps(over_batches)
    def run(batches):
        forget()
        try:
            yield from over_batches(batches)
        finally:
            give_back()

    return run


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name
