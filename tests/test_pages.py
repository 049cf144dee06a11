"""Combined findings, masks, ordered audits, JSON arrays and the ledger of numbers, at their edges."""

import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.functions import matching as M
from paperloom.functions.patterns import load_patterns
from paperloom.operators.numbering import greatest_before
from paperloom.plans import labels, redact
from paperloom.sources import results

PAGE = "batch_id string, path string, page_no int, text string"
WORD = "batch_id string, path string, page_no int, word_idx int, text string"
BOX = WORD + ", xmin double, ymin double, xmax double, ymax double, page_width double, page_height double"


@pytest.mark.parametrize("pattern,text", [("[0-9]+", "a1bb22 333"), (r"a\|b", "a|ba|b"), ("[0-9]", "1" * 300), ("x", ""), ("x", "yyy"), ("é", "éÉé\U0001f600é")])
def test_places(spark, pattern, text):
    got = spark.createDataFrame([(text,)], "t string").select(M.find_all(F.col("t"), pattern).alias("m")).first().m
    assert [(m.start, m.end, m.text) for m in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]
    assert spark.createDataFrame([(None,)], "t string").select(M.find_all(F.col("t"), pattern).alias("m")).first().m == []


def test_places_in_linear_time(spark):
    def seconds(n):
        page = spark.createDataFrame([("b", "f.pdf", 1, n)], "batch_id string, path string, page_no int, n int").withColumn("text", F.expr("array_join(transform(sequence(1, n), i -> concat('m', i, '@x.org')), ' ')"))
        start = time.time()
        assert redact.hits(page, load_patterns(["Email"])).agg(F.count_distinct("start")).first()[0] == n
        return time.time() - start

    seconds(100)
    assert seconds(64_000) < 10  # with a list that grows by copies this took minutes


def findings(spark, pages, words, patterns, boxes=False, **options):
    out = redact.findings(spark.createDataFrame(pages, PAGE), spark.createDataFrame(words, BOX if boxes else WORD), load_patterns(**patterns), **options)
    return sorted(out.collect(), key=lambda r: (r.path, r.page_no, r.seq.a, r.seq.b))


def test_pages_go_one_way(spark):
    words = [("b", p, n, i, w) for p, n in (("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("i.PNG", 1), ("t.txt", 1), ("new.pdf", 7)) for i, w in enumerate(["SSN", "123-45-6789"])]
    pages = [("b", "a.pdf", 1, "SSN 123-45-6789"), ("b", "a.pdf", 2, " \n "), ("b", "a.pdf", 3, None), ("b", "a.pdf", 4, None), ("b", "i.PNG", 1, "SSN 123-45-6789"), ("b", "t.txt", 1, "SSN 123-45-6789")]
    got = [(r.path, r.page_no, r.source, r.pattern_no) for r in findings(spark, pages, words, {"presets": ["SSN"]})]
    # Each way both of the overlapping patterns match; a page without text and words, and a text file, give nothing.
    want = [("a.pdf", 1, "text"), ("a.pdf", 2, "words"), ("a.pdf", 3, "words"), ("i.PNG", 1, "words"), ("new.pdf", 7, "words")]
    assert got == [(*w, k) for w in want for k in (0, 1)]
    assert findings(spark, pages[:0], words[:0], {"presets": ["SSN"]}) == []


def test_words_of_a_page(spark):
    texts = ["SSN", "123", "-", "45", "", "6789", None, "CODE-7", "12-3456789", "code-8"]
    words = [("b", "w.pdf", 1, i, w, i / 10, 0.5, (i + 1) / 10, 0.6 - i / 100, 600.0, 100.0) for i, w in enumerate(texts)]
    got = findings(spark, [], words, {"presets": ["EIN"], "regexes": r"CODE-\d"}, boxes=True, keep_last=4)
    # The guard finds no word for the EIN; a user's pattern is asked for in any case; the number in five words comes last.
    assert [(r.pattern, r.matched, r.word_idx, r.n_words, r.partial) for r in got] == [(r"CODE-\d", "CODE-7", 7, 1, False), (r"CODE-\d", "code-8", 9, 1, False), ("OCR_SSN_SPLIT", "123-45-6789", 1, 5, False)]
    assert (got[2].x0, got[2].y0, got[2].x1, got[2].y1) == pytest.approx((60.0, 50.0, 360.0, 59.0))
    part = findings(spark, [], words, {"presets": ["EIN"]}, boxes=True, keep_last=4, require_context=False)[0]
    assert part.partial and part.share == pytest.approx(5 / 9) and part.x1 == pytest.approx(480 + 60 * 5 / 9)
    five = [("b", "w.pdf", 1, i, w) for i, w in enumerate("123 - 45 - 6789".split())]
    assert len(findings(spark, [], five, {"presets": ["EIN"]}, require_context=False)) == 1 and findings(spark, [], five, {"presets": ["EIN"]}) == []
    assert len(findings(spark, [], five[:4], {"presets": ["EIN"]}, require_context=False)) == 0


def test_masks(spark):
    pages = spark.createDataFrame([("b", "f.pdf", 1, "abcd ABCD xbcdey 1‑23 1-23 İx"), ("b", "f.pdf", 2, "none"), ("b", "f.pdf", 3, None)], PAGE)
    found = spark.createDataFrame([("b", "f.pdf", 1, x) for x in ("abcd", "bcde", "zz", "1-23", "", "q" * 61, "y 1")] + [("b", "f.pdf", 3, "abcd")], "batch_id string, path string, page_no int, literal string")
    got = {r.page_no: r.redacted for r in redact.masked(pages, found).collect()}
    # Places that overlap are covered whole; of 1-23 the spelling with its own hyphen is there, so the other stays.
    assert got[1] == "████ ████ x███████‑23 ████ İx"
    assert got[2] == "none" and got[3] is None
    many = spark.createDataFrame([("b", "f.pdf", 1, " ".join(f"id{i}." for i in range(4000)))], PAGE)
    all_ = spark.createDataFrame([("b", "f.pdf", 1, f"id{i}.") for i in range(4000)], "batch_id string, path string, page_no int, literal string")
    assert set(redact.masked(many, all_).first().redacted) == {"█", " "}


def test_audit_order_and_arrays(spark, tmp_path):
    words = [("b", "z.pdf", 1, i, w) for i, w in enumerate(["12345678", "x@y.org", "87654321"])]
    pages = [("b", "a.pdf", 2, "x@y.org then 12345678"), ("b", "a.pdf", 1, "12345678 x@y.org 12345679")]
    found = redact.findings(spark.createDataFrame(pages, PAGE), spark.createDataFrame(words, WORD), load_patterns(["Email", "8-digit number"]))
    files = spark.createDataFrame([("b", "z.pdf", 0), ("b", "a.pdf", 1), ("empty", "k.pdf", 0)], "batch_id string, path string, ord int")
    audit = redact.audit_in_order(found, files)
    results.write_json_array(audit, str(tmp_path / "audit"), batches=files)
    email, number = (p.regex for p in load_patterns(["Email", "8-digit number"]))
    # By words the number comes first, in texts the first pattern.
    want = [("z.pdf", 1, number, 2), ("z.pdf", 1, email, 1), ("a.pdf", 1, email, 1), ("a.pdf", 1, number, 2), ("a.pdf", 2, email, 1), ("a.pdf", 2, number, 1)]
    read = lambda b: json.loads("".join(p.read_text() for p in sorted(Path(tmp_path / "audit" / f"batch_id={b}").glob("part-*"))))
    assert [tuple(e.values()) for e in read("b")] == want and list(read("b")[0]) == ["file", "page", "pattern", "match_count"] and read("empty") == []
    back = results.read_json_array(spark, str(tmp_path / "audit"), "file string, page int, pattern string, match_count int").collect()
    assert sorted((r.file, r.page, r.pattern, r.match_count) for r in back) == sorted(want)


def test_review(spark):
    pages = spark.createDataFrame([("b", "a.pdf", 1, "x@y.org")], PAGE)
    files = spark.createDataFrame([("b", "a.pdf"), ("b", "c.pdf"), ("d", "k.pdf")], "batch_id string, path string")
    ranges = spark.createDataFrame([("b", "A 1", "A 9")], "batch_id string, first_bates string, last_bates string")
    got = sorted(map(tuple, redact.review(redact.hits(pages, load_patterns(["Email"])), files, ranges).collect()))
    assert got == [("b", 2, 1, 1, "A 1 - A 9"), ("d", 1, 0, 0, "")]


FILES = "batch_id string, ord int, path string, page_count int, is_locked boolean, failed_after int, error string"


def test_ledger(spark):
    rows = [
        ("b", 0, "a1.pdf", 3, False, None, None), ("b", 1, "a2.pdf", 5, False, 2, "ValueError"), ("b", 2, "a3.pdf", 2, True, None, None), ("b", 3, "a4.pdf", 4, False, 0, "OSError"), ("b", 4, "a5.pdf", 2, False, 9, "E"),
        ("b", 5, "a6.pdf", 1, False, None, None), ("b", 6, "i.png", 1, False, 1, "E"), ("b", 7, "j.png", 1, False, None, None), ("b", 8, "k.pdf", 9, False, None, None), ("b", 9, "l.pdf", 1, False, 3, "E"), ("c", 0, "z.pdf", 1, False, 0, None),
    ]
    files = spark.createDataFrame(rows, FILES)
    skip = spark.createDataFrame([("b", "k.pdf", "P 000008", "P 000012"), ("b", "l.pdf", "P 000001", "P 000002")], "batch_id string, path string, first_label string, last_label string")
    records, failures = labels.assign(files, "P", 1, 6, skip)
    assert [(r.path, r.first_label, r.last_label) for r in records.orderBy("first_no").collect()] == [("k.pdf", "P 000008", "P 000012"), ("a1.pdf", "P 000001", "P 000003"), ("a6.pdf", "P 000008", "P 000008"), ("j.pdf", "P 000009", "P 000009")]
    assert {r.path: r.reason for r in failures.collect()} == {
        "a2.pdf": "Failed to label PDF: ValueError", "a3.pdf": labels.LOCKED, "a4.pdf": "Failed to label PDF: OSError", "a5.pdf": "Failed to label PDF: E", "i.png": "Failed to label image: E",
        "l.pdf": "Failed to preserve PDF: E", "z.pdf": "Failed to label PDF: Exception",
    }
    intervals, totals = labels.ledger(files, "P", 1, 6, skip)
    got = [(r.path, r.kind, r.first_no, r.last_no, r.overlaps) for r in intervals.orderBy("first_no", "last_no").collect()]
    assert got == [("a1.pdf", "used", 1, 3, False), ("a2.pdf", "burnt", 4, 5, False), ("a5.pdf", "burnt", 6, 7, False), ("a6.pdf", "used", 8, 8, False), ("k.pdf", "preserved", 8, 12, True), ("j.png", "used", 9, 9, True)]
    assert sorted(map(tuple, totals.collect())) == [("b", 5, 4, 1, 9), ("c", 0, 0, 0, 0)]
    assert [tuple(r) for r in labels.islands(intervals).collect()] == [("b", "P", 1, 12, 6, 2, 0)]


def test_greatest_before(spark):
    rows = [("g", i, v) for i, v in enumerate([5, 1, None, 9, 2, 9, 3])] + [("h", 0, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    assert [r.before for r in greatest_before(df, "v", ["i"], ["k"]).orderBy("k", "i").collect()] == [None, 5, 5, 5, 9, 9, 9, None]


def test_hits_are_worked_out_once(spark):
    """No filter in front of the explode repeats the patterns' work."""
    pages = spark.createDataFrame([("b", "a.pdf", 1, "tel. 555-123-4567")], "batch_id string, path string, page_no int, text string")
    words = spark.createDataFrame([("b", "w.pdf", 1, 0, "555-123-4567")], "batch_id string, path string, page_no int, word_idx int, text string")
    patterns = load_patterns(["Phone,Email"])
    for rows in (redact.hits(pages, patterns), redact.findings(pages, words, patterns)):
        lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in lines if "Filter" in x and "regexp_extract_all" in x]
        assert {r.matched for r in rows.collect()} == {"555-123-4567"}


def test_detection_reads_blocks_once(spark):
    """Labels with a prefix, and numbers by themselves where there is none, come from one pass over the blocks."""
    rows = [("b", "a.pdf", 1, 0, "Abc 000001 Abc 000002 Klm 000009"), ("b", "a.pdf", 3, 0, "Abc 000007"), ("b", "a.pdf", 2, 0, "Klm 000003 Klm 000004 Klm 000005"), ("b", "p.pdf", 1, 0, "Page 000012"), ("b", "x.pdf", 1, 0, "none")]
    blocks = spark.createDataFrame(rows, "batch_id string, path string, page_no int, block_no int, text string").selectExpr("*", "0 as block_type", "780.0D as y0", "792.0D as page_height")
    files = spark.createDataFrame([("b", "a.pdf", 3), ("b", "p.pdf", 1), ("b", "x.pdf", 1), ("b", "x.pdf", 1)], "batch_id string, path string, page_count int")
    out = labels.detect(blocks, files)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    assert sorted(tuple(r)[1:] for r in out.collect()) == [("a.pdf", "ABC 000001", "ABC 000007"), ("p.pdf", "000012", "000012"), ("x.pdf", "", ""), ("x.pdf", "", "")]
