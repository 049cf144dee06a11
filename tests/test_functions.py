"""Column functions on small tables of cases."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import labels as L
from paperloom.functions import matching as M
from paperloom.functions import paths as P
from paperloom.functions.patterns import PRESETS, java, load_patterns


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select(column(F.col("t")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_walk_order(spark):
    want = "a2.pdf a10.pdf b.pdf a2.png c.jpg sub1/k.pdf Sub2/a.PDF Sub2/x.pdf Sub2/in/q1.jpg sub2b/z.pdf sub10/y.pdf".split()
    rows = spark.createDataFrame([(p,) for p in reversed(want)], "p string")
    assert [r.p for r in rows.orderBy(P.walk_key(F.col("p")), "p").collect()] == want


def test_paths(spark):
    cases = ["a/b/c.PDF", ".hidden", "x", "a.b/.DS_Store", "./../.hid/x", "d\\e.png", "q/__MACOSX/f", "__MACOSX/f", "", None]
    assert values(spark, P.ext, cases) == [".pdf", "", "", "", "", ".png", "", "", "", None]
    assert values(spark, P.norm_key, cases)[4:6] == ["hid/x", "d/e.png"]
    assert values(spark, P.is_junk, cases[:8]) == [False, False, False, True, False, False, True, False]
    assert values(spark, P.category, ["a/b/c", "x"]) == ["b", ""]
    assert values(spark, P.rel_dir, ["a/b/c", "x"]) == ["a/b", ""]
    assert values(spark, lambda c: P.safe_zip_name(c, "out"), [" my file?.zip", "._", None, "a"]) == ["my_file.zip", "out.zip", "out.zip", "a.zip"]
    assert values(spark, P.is_sidecar, ["./__bates_records.json", "a/__bates_records.json"]) == [True, False]


def test_labels(spark):
    made = spark.range(1).select(L.format_label(F.lit("P"), F.lit(1234567), F.lit(6)).alias("a"), L.format_label(F.lit(""), F.lit(1), F.lit(8)).alias("b")).first()
    assert (made.a, made.b) == ("P 1234567", " 00000001")
    got = values(spark, L.parse_token, ["QRS 000185", "000185", "x 1", "", None, "A.B 0012345678"])
    assert [tuple(g) if g else None for g in got] == [("QRS", 185, 6), ("", 185, 6), None, None, None, ("A.B", 12345678, 10)]
    rows = spark.createDataFrame([("A 1", "A 3"), ("A 1", "A 1"), ("", "A 3"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(L.bates_range(F.col("a"), F.col("b"))).collect()] == ["A 1 - A 3", "A 1", "A 3", ""]
    assert [tuple(x) for x in values(spark, L.split_range, ["A 1 - A 3", "A 1", ""])] == [("A 1", "A 3"), ("A 1", "A 1"), ("", "")]


def test_dates(spark):
    cases = ["2021.13.40 20210105 01-02-2020", "x 2020-2-3 y", "_2021-01-02", "31.12.2020 12.31.2020", "", None]
    assert values(spark, D.parse_date, cases) == [dt.date(2021, 1, 5), dt.date(2020, 2, 3), None, dt.date(2020, 12, 31), None, None]
    rows = spark.createDataFrame([("2019-01-01/2020-02-02/x", "n"), ("a/b", "2018-03-04.pdf"), ("", "z")], "d string, n string")
    got = rows.select(D.date_produced(F.col("d"), F.col("n"), dt.date(2000, 1, 1))).collect()
    assert [g[0] for g in got] == [dt.date(2020, 2, 2), dt.date(2018, 3, 4), dt.date(2000, 1, 1)]
    year = lambda policy: lambda c: D.pick_year(D.year_candidates(D.without_label(c), 1900, 2099), policy)["year"]
    names = ["ledger_2021.pdf", "Report2021.pdf", "scan_20210105.pdf", "a 2001 b 1999.pdf", "none"]
    assert values(spark, year("first"), names) == [2021, None, 2021, 2001, None]
    assert values(spark, year("max"), names)[3] == 2001
    assert values(spark, D.pdf_date_year, ["D:20210105", "2019", "x", None]) == [2021, 2019, None, None]


TEXTS = ["SSN: 123-45-6789 and 123 45 6789", "ssn# 123456789 é 000-12-3456", "mail a.b@c.org, x@y.co!", "4111 1111 1111 1111 or (555) 123-4567", "Date of Birth: 01/15/1980", "", "none", None, "a\n12-3456789\n1-800-555-1234"]


@pytest.mark.parametrize("pattern", [p for ps in PRESETS.values() for p in ps])
def test_matches_equal_python(spark, pattern):
    got = values(spark, lambda c: M.find_all(c, java(pattern)), TEXTS)
    want = [[(m.start(), m.end(), m.group(0)) for m in re.finditer(pattern, t or "", re.IGNORECASE)] for t in TEXTS]
    assert [[tuple(x) for x in g] for g in got] == want


def test_helpers(spark):
    assert values(spark, lambda c: M.without_last_digits(c, 4), ["123-45-6789", "12", "ab1234"]) == ["123-45-", "", "ab"]
    assert values(spark, M.search_variants, ["1|2-3"])[0][0] == "1|2-3" and values(spark, M.search_variants, ["1|2-3"])[0][-1] == "12-3"
    assert len(load_patterns(["SSN,EIN", "nothing"], "x+\n# no\n\n", "a.b, c")) == 7
    with pytest.raises(ValueError):
        load_patterns([])
