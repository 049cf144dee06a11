"""Sequential page labels: a prefix, a blank, a zero-padded number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that look like prefixes of labels and are none.
NO_PREFIXES = ("MONTHLY", "BOX", "ID", "TARGET", "REQUESTED", "MISC", "PAGE", "LOREM", "IPSUM")
# A label candidate in upper-case text (on a page, in the browser), a number without prefix, a label by itself.
CANDIDATE = r"(?U)\b([A-Z][A-Z0-9.]{0,20})[ \t\-–—]+([0-9]{6,10})\b"
BROWSER_CANDIDATE = r"(?U)\b([A-Z][A-Z0-9.]{0,20})[\s\-–—]+([0-9]{6,10})\b"
BARE = r"(?U)\b(0\d{5,9})\b"
TOKEN = r"(?U)^\s*([A-Z][A-Z0-9.]*)?\s*(\d{4,10})\s*$"


def format_label(prefix: Column, number: Column, digits: Column) -> Column:
    """``ABC 000012``; an empty prefix leaves the blank, a longer number keeps its digits."""
    n = number.cast("string")
    return F.concat(prefix, F.lit(" "), F.when(F.length(n) >= digits, n).otherwise(F.lpad(n, digits, F.lit("0"))))


def parse_token(token: Column) -> Column:
    """Struct (prefix, number, width) of a label, null if it is none."""
    fits = F.coalesce(token.rlike(TOKEN), F.lit(False))
    digits = F.regexp_extract(token, TOKEN, 2)
    return F.when(fits, F.struct(F.regexp_extract(token, TOKEN, 1).alias("prefix"), digits.try_cast("long").alias("number"), F.length(digits).alias("width")))


def normalize_prefix(prefix: Column) -> Column:
    """One blank for each run of them, no blanks, dashes or dots at the ends, upper case."""
    one = F.regexp_replace(prefix, r"(?U)\s+", " ")
    return F.upper(F.regexp_replace(one, r"^[ \-–—.]+|[ \-–—.]+$", ""))


def is_zero_padded(number: Column) -> Column:
    return (F.length(number) >= 6) & F.startswith(number, F.lit("0"))


def bates_range(first: Column, last: Column) -> Column:
    """``first - last`` where both are there and differ, else the one there is; empty for none."""
    a, b = F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit(" - "), b)).when(a != "", a).otherwise(b)


def split_range(text: Column) -> Column:
    """Struct (first, last) of a range; a single label is both."""
    parts = F.split(F.coalesce(text, F.lit("")), " - ", 2)
    first = F.trim(F.get(parts, F.lit(0)))
    return F.struct(first.alias("first"), F.coalesce(F.trim(F.get(parts, F.lit(1))), first).alias("last"))


def order_number(text: Column) -> Column:
    """First number of 6 to 10 digits in a range, for ordering; null without one."""
    return F.nullif(F.regexp_extract(text, r"(\d{6,10})", 1), F.lit("")).try_cast("long")
