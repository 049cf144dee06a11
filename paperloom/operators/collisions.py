"""Names of files that meet in one folder.

A name that is taken gets the least number that is free: ``stem__i.ext``. Whether a number is free hangs on the first file that
brings such a name itself, and on the numbers given before; a name with a number may in turn be taken and get another one. So names are
placed level by level, by how many numbers they end in, and within a level for all folders at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.numbering import running_before
from paperloom.operators.storage import discard, joined_small, written

KEYS = ["batch_id", "folder"]
NUMBER = r"__([1-9]\d{0,17})$"
NAME = [*KEYS, "name"]


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_stem``, ``_suffix`` and ``_depth``, the numbers at the end of the stem."""
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]+$", "")
    suffix = F.regexp_extract("name", r"(?<=.)(\.[^.]+)$", 1)
    run = F.regexp_extract(stem, r"(?<=.)((?:__[1-9]\d{0,17})+)$", 1)
    return rows.withColumn("_stem", stem).withColumn("_suffix", suffix).withColumn("_depth", F.size(F.regexp_extract_all(run, F.lit("__"), F.lit(0))))


def _skipped(need: DataFrame, blocked: DataFrame) -> DataFrame:
    """(name, b): numbers that files with such names have taken before they could be given.

    ``need``: name, k, ord, the k-th file of a name that needs a number; ``blocked``: name, b, f, the first file that brings number b itself. Number b would
    go to the file k = b less those skipped below it, and is skipped if f is before that file. Each round takes the skipped ones from the round before:
    in turn too many and too few, and right as soon as two rounds agree; a round settles one more number of each name at least.
    """
    now = written(blocked.withColumn("skip", F.lit(0)), "skips")
    while True:
        before = running_before(now, "skip", ["b"], NAME)
        at = need.select(*NAME, "k", F.col("ord").alias("t"))
        met = before.withColumn("k", F.col("b") - F.col("before")).join(at.hint("merge"), [*NAME, "k"], "left")
        last = now
        now = written(met.select(*NAME, "b", "f", F.coalesce(F.col("f") < F.col("t"), F.lit(False)).cast("int").alias("skip"), (F.col("skip") != F.coalesce(F.col("f") < F.col("t"), F.lit(False)).cast("int")).alias("moved")), "skips")
        discard(last)
        if now.where("moved").limit(1).count() == 0:
            return now.where("skip = 1").select(*NAME, "b")
        now = written(now.drop("moved"), "skips")


def _numbered(need: DataFrame, blocked: DataFrame) -> DataFrame:
    """``need`` with ``number``: the k-th number that is not skipped, by counting skipped ones below it."""
    gone = running_before(_skipped(need, blocked).withColumn("one", F.lit(1)), "one", ["b"], NAME)
    # With j numbers skipped before b, those from the (b - j)-th free one on are behind it.
    marks = gone.select(*NAME, (F.col("b") - F.col("before")).alias("k"), F.lit(0).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast(need.schema["ord"].dataType).alias("ord"))
    both = need.select(*NAME, "k", F.lit(1).alias("kind"), F.lit(0).alias("one"), "ord").unionByName(marks)
    out = running_before(both, "one", ["k", "kind"], NAME).where("kind = 1")
    return out.select(*NAME, "ord", (F.col("k") + F.col("before")).alias("number"))


def free_names(files: DataFrame) -> DataFrame:
    """``files`` (batch_id, ord, folder, name) with ``placed``: the name, or ``stem__i.ext`` with the first free i.

    Files of a folder take names in the order of ``ord``, which no two of them share. Only names that are alike but for numbers at the end of
    the stem can meet; they are a family. In a family without such numbers a name's number is the count of its rows
    before. In the other families a number may be taken, and their files are placed level by level.
    """
    # Families are counted only if a name has such a number at all.
    some = files.where(F.col("name").rlike(r"__\d")).limit(1).count() > 0
    if some:
        rows = _parts(files).withColumn("_family", F.concat(F.regexp_replace("_stem", r"(__\d+)+$", ""), F.lit("/"), "_suffix"))
        keys = [*KEYS, "_family"]
        with_number = rows.groupBy(*keys).agg(F.bool_or(F.col("_stem").rlike(r"__\d+$")).alias("_odd"), F.count(F.lit(1)).alias("_n")).where("_odd and _n > 1")
        odd = written(with_number.select(*keys, "_odd"), "odd-families")
        some = odd.limit(1).count() > 0
    marked = joined_small(rows, odd, keys, "left") if some else None
    # A number before the names in the order of sorting: names of a folder begin alike, so comparing them is slow.
    n = F.row_number().over(Window.partitionBy(F.xxhash64(*NAME), *NAME).orderBy("ord")) - 1
    plain = (marked.where("_odd is null").select(*files.columns) if some else files).withColumn("_n", n)
    plain = _parts(plain).withColumn("placed", F.when(F.col("_n") == 0, F.col("name")).otherwise(F.concat("_stem", F.lit("__"), F.col("_n").cast("string"), "_suffix")))
    plain = plain.select(*files.columns, "placed")
    if not some:
        return plain
    met = written(marked.where("_odd").select(*NAME, "ord", "_stem", "_suffix", "_depth"), "families")
    deepest = met.agg(F.max("_depth")).first()[0]
    first = met.groupBy(*NAME, "_stem", "_suffix", "_depth").agg(F.min("ord").alias("f"))
    bare, number = F.regexp_replace("_stem", NUMBER, ""), F.regexp_extract("_stem", NUMBER, 1)
    child = first.where("_depth > 0").select(*KEYS, F.concat(bare, "_suffix").alias("name"), number.cast("long").alias("b"), "f", "_depth")
    child = written(child, "numbered-names")
    made, parts = None, []
    for depth in range(deepest + 1):
        level = running_before(met.where(F.col("_depth") == depth).withColumn("_one", F.lit(1)), "_one", ["ord"], NAME)
        if made is None:
            level = level.withColumn("k", F.col("before"))
        else:  # the first file's name may have been given away before
            tops = first.where(F.col("_depth") == depth).select(*NAME, "f").join(made.hint("merge"), NAME).where("g < f").select(*NAME, F.lit(1).alias("_gone"))
            level = level.join(tops.hint("merge"), NAME, "left").withColumn("k", F.col("before") + F.coalesce("_gone", F.lit(0)))
        level = written(level.select(*NAME, "ord", "_stem", "_suffix", "k"), "level")
        need = level.where("k > 0")
        given = _numbered(need, child.where(F.col("_depth") == depth + 1).select(*NAME, "b", "f"))
        out = level.join(given.hint("merge"), [*NAME, "ord"], "left")
        out = out.withColumn("placed", F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("_stem", F.lit("__"), F.col("number").cast("string"), "_suffix")))
        out = written(out.select(*NAME, "ord", "k", "placed"), "placed")
        made = out.where("k > 0").select(*KEYS, F.col("placed").alias("name"), F.col("ord").alias("g"))
        parts.append(out.select(*NAME, "ord", "placed"))
        discard(level)
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    numbered = marked.where("_odd").select(*files.columns).join(placed.hint("merge"), [*NAME, "ord"])
    return plain.unionByName(numbered.select(*files.columns, "placed"))
