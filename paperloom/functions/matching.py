"""Pattern matches with their places, in SQL functions; patterns of users in a pandas function."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,text:string>>"


#: Matches whose places are added up in one go.
CHUNK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body has it, inside of lambdas as well."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches from left to right; places count characters from 0.

    ``pattern`` is in Java's dialect and must not match the empty string. Null text has no matches. Places are sums of the
    lengths before, over chunks of matches and then inside each, so the work does not grow with their square.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    grown = lambda at, out, kind: F.struct(at.cast("int").alias("at"), out.cast(kind).alias("out"))

    def base(acc, chunk):
        length = F.aggregate(chunk, F.lit(0), lambda n, p: n + p["g"] + F.coalesce(F.char_length(p["m"]), F.lit(0)))
        return grown(acc["at"] + length, F.array_append(acc["out"], acc["at"]), "array<int>")

    def step(acc, p):
        a = acc["at"] + p["g"]
        b = a + F.char_length(p["m"])
        one = F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), p["m"].alias("text"))
        return F.when(p["m"].isNull(), acc).otherwise(grown(b, F.array_append(acc["out"], one), MATCHES))

    def placed(chunk, at):
        return F.aggregate(chunk, grown(at, F.array(), MATCHES), step, lambda acc: acc["out"])

    def chunks(p):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK)))

    def located(parts):
        bases = F.aggregate(parts, grown(F.lit(0), F.array(), "array<int>"), base, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, bases, placed))

    def single(m):
        start = F.char_length(F.get(F.split(text, pattern, 2), F.lit(0)))
        return let(start, lambda a: F.array(F.struct(a.alias("start"), (a + F.char_length(F.get(m, F.lit(0)))).alias("end"), F.get(m, F.lit(0)).alias("text"))).cast(MATCHES))

    def several(m):
        return let(F.arrays_zip(m.alias("m"), gaps.alias("g")), lambda p: let(chunks(p), located))

    # One match, the most frequent case, needs no sums.
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 1, single(m)).otherwise(several(m)))
    # Without a match nothing is split.
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(F.array().cast(MATCHES))


def find_all_custom(pattern: str, case_sensitive: bool = False):
    """A pandas function like ``find_all`` for a pattern in Python's dialect."""
    import re

    flags = 0 if case_sensitive else re.IGNORECASE
    re.compile(pattern, flags)  # a wrong pattern fails here, not in a task

    @F.pandas_udf(MATCHES)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = re.compile(pattern, flags)
        for batch in texts:
            yield batch.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m.group(0)} for m in compiled.finditer(t or "")])

    return found


def whole_words_custom(pattern: str, case_sensitive: bool = False):
    """A pandas function: the places, from 0, of the words of an array that a pattern in Python's dialect matches as a whole."""
    import re

    flags = 0 if case_sensitive else re.IGNORECASE
    re.compile(pattern, flags)

    @F.pandas_udf("array<int>")
    def found(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = re.compile(pattern, flags)
        for batch in lists:
            yield batch.map(lambda ws: [i for i, w in enumerate(ws) if w and compiled.fullmatch(w)] if ws is not None else [])

    return found


def near(text: Column, start: Column, end: Column, context: str, reach: int = 60) -> Column:
    """Whether a context pattern occurs within ``reach`` characters of a match."""
    a = F.greatest(start - reach, F.lit(0))
    return F.substring(text, a + 1, end + reach - a).rlike(context)


def without_last_digits(text: Column, n: int) -> Column:
    """Text before the n-th digit from the end; empty if there are fewer, all of it for n = 0."""
    if n <= 0:
        return text
    return F.regexp_extract(text, rf"(?s)^(.*?)\d(?:\D*\d){{{n - 1}}}\D*$", 1)


# Characters that stand for one another in a search.
HYPHENS = ("-", "\u2010", "\u2011", "\u2012", "\u2013", "\u2212")
NO_BREAK, BROKEN_BAR, ZERO_WIDTH, THIN = "\u00a0", "\u00a6", "\u200b", "\u2009"


def search_variants(text: Column) -> Column:
    """Spellings of a literal with other separators, longest first; of equal length its own one first."""
    # Without a separator there is nothing to swap.
    plain = F.coalesce(~text.rlike("[" + "".join(("-", " ", NO_BREAK, "|", ZERO_WIDTH, THIN)) + "]"), F.lit(True))
    s = F.replace(F.replace(text, F.lit(ZERO_WIDTH), F.lit("")), F.lit(THIN), F.lit(""))
    swap = lambda a, b: F.replace(s, F.lit(a), F.lit(b))
    spellings = [s, *(swap("-", h) for h in HYPHENS), swap(" ", ""), swap(NO_BREAK, " "), swap(NO_BREAK, ""), swap("|", BROKEN_BAR), swap("|", " "), swap("|", "")]
    keyed = F.transform(F.array_distinct(F.array(*spellings)), lambda x, i: F.struct((-F.char_length(x)).alias("k"), i.alias("i"), x.alias("x")))
    return F.when(plain, F.array(text)).otherwise(F.transform(F.array_sort(keyed), lambda k: k["x"]))


def covered(text: Column, literals: Column) -> Column:
    """A text with the literals of an array covered; ``literals`` is an array of arrays of spellings.

    Of each literal's spellings the first one that is in the text is covered wherever it is. One pass over the text finds all
    places of all spellings; places may overlap. The case of letters is ignored, for those whose other case is one character.
    """

    def cover(text, literals):
        search = ahocorasick.Automaton()
        keys = [[fold(s) for s in spellings if s] for spellings in literals]
        for key in {k for spellings in keys for k in spellings}:
            search.add_word(key, key)
        places: dict[str, list[int]] = {}
        if len(search):
            search.make_automaton()
            for end, key in search.iter(fold(text)):
                places.setdefault(key, []).append(end + 1)
        edge: dict[int, int] = {}
        for key in {next((k for k in spellings if k in places), None) for spellings in keys} - {None}:
            for end in places[key]:
                edge[end - len(key)] = edge.get(end - len(key), 0) + 1
                edge[end] = edge.get(end, 0) - 1
        out, at, depth = [], 0, 0
        for place in sorted(edge):
            out.append("\u2588" * (place - at) if depth else text[at:place])
            at, depth = place, depth + edge[place]
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([t if t is None or x is None else cover(t, x) for t, x in zip(texts, lists, strict=True)], dtype=object)

    return run(text, literals)


def fold(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    if text.isascii():
        return text.lower()
    return "".join(k if len(k := c.lower()) == 1 else c for c in text)


def loose(context: str) -> str:
    """What must be in a text for a context pattern to match any part of it."""
    return context.replace(r"\b", "").replace(r"(?!\w)", "")
