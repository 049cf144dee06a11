"""Quality rules by distribution divergence, in SQL functions only.

A document's histogram of character classes and of common words is compared with the typical
histogram of its language by Jensen-Shannon distance (the root of the divergence in bits, 0 to 1).
A histogram of too short a text is not judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import BLANK_RUN, table, words, written
from paperloom.operators.numbering import running_before

# Common words of each language.
COMMON = {
    "en": "the of and to in is that for was on with as are be at by this from or an",
    "fr": "de la le et les des en un une du est que qui dans pour par sur pas au avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}
#: Minimum lengths: characters for the classes, words for the common words.
MIN_CHARS = 200
MIN_WORDS = 100
#: Largest distances of a kept document.
MAX_CLASS = 0.18
MAX_COMMON = 0.28
CLASSES = {
    "lower": "[^a-z]+",
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "blank": r"[^\x20\x09-\x0D]+",
    "symbol": "[^#*$%&|<>]+",
    "beyond": r"[\x00-\x7F]+",
}


def left(text: Column, drop: str) -> Column:
    """Characters that stay when a pattern is dropped."""
    return F.char_length(F.regexp_replace(text, drop, ""))


def three_words(ws: Column) -> Column:
    """Array of the 3-word windows of an array of words, each joined by blanks."""
    later = lambda k: F.slice(ws, k, F.greatest(F.size(ws), F.lit(1)))
    join = lambda a, b: F.concat(a, F.lit(" "), b)
    return F.filter(F.zip_with(F.zip_with(ws, later(2), join), later(3), join), lambda x: x.isNotNull())


def sorted_windows(windows: Column) -> Column:
    """Sorted array of (window, place) for a text with a window twice or more, else null.

    Neighbours of the sorted array are compared next: no lambda looks into an array at a place, so the work is n log n.
    """
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and histograms; null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("ws", words(text)).withColumn("n_words", F.size("ws").cast("long"))
    out = out.withColumn("n_chars_all", F.char_length(text).cast("long"))
    out = out.withColumns({f"c_{k}": left(text, p).cast("long") for k, p in CLASSES.items()})
    out = out.withColumn("word_chars", F.col("n_chars_all") - F.col("c_blank")).withColumn("n_symbols", F.col("c_symbol"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = out.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    out = out.withColumn("windows", three_words(F.col("ws"))).withColumn("sorted", sorted_windows(F.col("windows"))).drop("windows")
    n = F.size("sorted")
    same = F.zip_with(F.col("sorted"), F.slice("sorted", 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False)))
    out = out.withColumn("same", same)
    before = F.slice(F.concat(F.array(F.lit(False)), F.col("same")), 1, F.greatest(F.size("same"), F.lit(0)))
    twice = F.zip_with("same", before, lambda a, b: a | b)
    hit = F.filter(F.zip_with("sorted", twice, lambda s, t: F.when(t, s["i"])), lambda x: x.isNotNull())
    out = out.withColumn("starts", F.array_sort(hit))
    later = F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1)))
    covered = F.aggregate(F.zip_with("starts", later, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("sorted", "same", "starts")
    other = F.col("n_chars_all") - reduce(lambda a, b: a + b, [F.col(f"c_{k}") for k in CLASSES])
    out = out.withColumn("classes", F.array(*[F.col(f"c_{k}") for k in CLASSES], other).cast("array<double>"))
    return out.drop(*[f"c_{k}" for k in CLASSES])


def word_histogram(low: Column, lang: str) -> Column:
    """Counts of a language's common words, then of all other words, from an array of lower-case words."""
    listed = COMMON[lang].split()
    hits = F.filter(low, lambda w: w.isin(*listed))
    start = F.struct(hits.alias("rest"), F.array().cast("array<double>").alias("counts"))

    def count(acc, word):
        rest = F.array_remove(acc["rest"], word)
        return F.struct(rest.alias("rest"), F.array_append(acc["counts"], (F.size(acc["rest"]) - F.size(rest)).cast("double")).alias("counts"))

    counted = F.aggregate(F.array(*map(F.lit, listed)), start, count, lambda acc: acc["counts"])
    return F.array_append(counted, (F.size(low) - F.size(hits)).cast("double"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, each scaled to sum 1; null where one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def part(a, b):
        m = (a + b) / 2
        one = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (one(a) + one(b)) / 2

    np_, nq = total(p), total(q)
    divergence = total(F.zip_with(scaled(p), scaled(q), part))
    return F.when((np_ > 0) & (nq > 0), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def scaled(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(total, F.size(x)).alias("n")), lambda z: z["v"] / z["n"])


def references(counted: DataFrame) -> DataFrame:
    """(lang, classes, common): each language's exact median shares (the lower of two middles) over its documents of full length, scaled to sum 1 when compared.

    Medians, as junk documents would pull means towards themselves. One row a language. Languages without a list of common words have null in ``common``.
    """
    long_ = counted.where("lang is not null and judged_classes")
    n = len(CLASSES) + 1
    common = F.when(F.col("judged_common"), scaled(F.col("common"))).otherwise(F.array().cast("array<double>"))
    shares = long_.select("lang", F.posexplode(F.concat(scaled(F.col("classes")), common)).alias("k", "share")).where("share is not null")  # null where too few words were counted
    counts = written(shares.groupBy("lang", "k", "share").agg(F.count(F.lit(1)).alias("n")), "share-counts")
    totals = counts.groupBy("lang", "k").agg(F.sum("n").alias("total"))  # a row a language and place
    met = running_before(counts, "n", ["share"], ["lang", "k"]).join(totals.hint("merge"), ["lang", "k"])
    middle = met.where((2 * F.col("before") < F.col("total")) & (2 * (F.col("before") + F.col("n")) >= F.col("total")))
    found = middle.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "share"))).alias("found"))
    found = found.select("lang", F.transform("found", lambda x: x["share"]).alias("found"))
    common = F.slice("found", n + 1, F.greatest(F.size("found"), F.lit(1)))
    return found.select("lang", F.slice("found", 1, n).alias("classes"), F.when(F.size("found") > n, common).alias("common"))


def judge(docs: DataFrame, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """``doc_id, lang`` of each row, with the base counts, ``class_distance``, ``common_distance``, ``base_failed`` and ``kept``.

    A distance is null, and does not reject, where the text is shorter than the guard or its language has no reference:
    rows with a null language have none, languages without a list of common words are judged by characters alone.
    Null and empty texts fail the base rule. Repeated rows each get the same verdict.
    """
    counted = features(docs.select("doc_id", "text", "lang"))
    low = F.transform("ws", lambda w: F.lower(w))
    counted = counted.withColumn("low", F.when(F.size("ws") >= MIN_WORDS, low))
    own = reduce(lambda acc, k: F.when(F.col("lang") == k, word_histogram(F.col("low"), k)).otherwise(acc), COMMON, F.lit(None).cast("array<double>"))
    counted = counted.withColumn("common", own)
    counted = counted.withColumn("judged_classes", F.col("n_chars_all") >= MIN_CHARS).withColumn("judged_common", F.col("common").isNotNull())
    counted = written(counted.drop("ws", "low", "text"), "quality-counts")
    found = {r["lang"]: r for r in references(counted).collect()}  # one row a language
    as_array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    by_lang = {k: distance(F.col("classes"), as_array(r["classes"])) for k, r in found.items()}
    none = F.lit(None).cast("double")
    class_distance = reduce(lambda acc, k: F.when(F.col("lang") == k, by_lang[k]).otherwise(acc), by_lang, none)
    listed = {k: r["common"] for k, r in found.items() if r["common"] and k in COMMON}
    common_distance = reduce(lambda acc, k: F.when(F.col("lang") == k, distance(F.col("common"), as_array(listed[k]))).otherwise(acc), listed, none)
    out = counted.withColumn("class_distance", F.when(F.col("judged_classes"), class_distance)).withColumn("common_distance", common_distance)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("common_distance", F.lit(0.0)) <= max_common)
    out = out.withColumn("kept", ~F.col("base_failed") & near)
    return out.drop("classes", "common", "judged_classes", "judged_common", "n_chars_all")


def op2_divergence(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))


def op2_sql() -> str:
    """The query in SQL: each language's list of common words, class patterns and limits are the same values."""
    lists = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v.split())}])" for k, v in COMMON.items())
    drops = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in CLASSES.values())
    half = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: case when {x}[i] > 0 then {x}[i] * log2({x}[i] / (({x}[i] + {y}[i]) / 2)) else 0 end)) / 2"
    return f"""
with lists as (select * from (values {lists}) v(lang, listed)),
d as (
  select doc_id, lang, coalesce(text, '') as t, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as ws from documents
), lines as (
  select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls, [{drops}] as c from d
), win as (
  select doc_id, i, array_to_string(ws[i:i + 2], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)
), twice as (
  select doc_id, i from win qualify count(*) over (partition by doc_id, w) > 1
), covered as (
  select doc_id, count(*) as n from (select distinct doc_id, unnest([i, i + 1, i + 2]) as k from twice) group by doc_id
), counted as (
  select l.doc_id, l.lang, len(ws)::bigint as n_words, (length(t) - c[4])::bigint as word_chars, c[5]::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, length(t) >= {MIN_CHARS} as judged,
    list_transform(list_append(c, length(t) - list_sum(c)), lambda x: x / length(t)) as cs,
    case when len(ws) >= {MIN_WORDS} and listed is not null then list_transform(list_append(list_transform(listed, lambda w: len(list_filter(ws, lambda x: lower(x) = w))),
      len(list_filter(ws, lambda x: not list_contains(listed, lower(x))))), lambda x: x / len(ws)) end as hs
  from lines l left join lists using (lang) left join covered using (doc_id)
), places as (
  select lang, k, quantile_disc(cs[k], 0.5) as a, quantile_disc(hs[k], 0.5) as b from counted, range(1, 60) r(k) where judged and lang is not null group by lang, k
), refs as (
  select lang, list(a / sa order by k) filter (where a is not null) as ra, list(b / sb order by k) filter (where b is not null) as rb
  from (select *, sum(a) over (partition by lang) as sa, sum(b) over (partition by lang) as sb from places) group by lang
), far as (
  select c.*, case when judged then round(sqrt(greatest(0, {half("cs", "ra")} + {half("ra", "cs")})), 6) end as class_distance,
    case when hs is not null then round(sqrt(greatest(0, {half("hs", "rb")} + {half("rb", "hs")})), 6) end as common_distance,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from counted c left join refs using (lang)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(class_distance, 0) <= {MAX_CLASS} and coalesce(common_distance, 0) <= {MAX_COMMON} as kept, class_distance, common_distance
from far
"""
