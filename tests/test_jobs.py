"""Jobs on small batches."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions.patterns import load_patterns
from paperloom.operators.collisions import free_names
from paperloom.operators.storage import written
from paperloom.plans import index, labels, organize, redact, report, scan
from paperloom.sources import intake, results
from paperloom.streaming.pages import scan_stream

PAGE = "batch_id string, path string, page_no long, text string"


def one_page(spark, *texts):
    return spark.createDataFrame([("b", f"f{i}.pdf", 1, t) for i, t in enumerate(texts)], PAGE)


@pytest.mark.parametrize(
    "text,presets,context,hits",
    [
        ("SSN: 123-45-6789 SSN 222-33-4444\nEIN: 12-3456789\nCard 4111 1111 1111 1111\nDOB: 01/15/1980", ["SSN", "EIN", "Credit Card", "Date of Birth"], True, 7),
        ("SSN: 123-45-6789\nss# 411-62-7730", ["SSN"], True, 4),
        ("My number is 123-45-6789 (no label)", ["SSN"], True, 0),
        ("My number is 123-45-6789 (no label)", ["SSN"], False, 2),
        ("Reference 12-3456789 in the contract", ["EIN"], True, 0),
        ("EIN: 12-3456789", ["EIN"], True, 1),
        ("Document filed on 01/15/1980 at court", ["Date of Birth"], True, 0),
        ("Card 4111 1111 1111 1111\nOrder 1234 5678 9012 3456 (not a card)", ["Credit Card"], True, 1),
    ],
)
def test_redaction_cases(spark, text, presets, context, hits):
    assert redact.hits(one_page(spark, text), load_patterns(presets), context).count() == hits


def test_redaction_custom_masks_and_stream(spark, tmp_path):
    pages = one_page(spark, "Matter GREEN-FOLDER-7781 here", "SSN: 123-45-6789 again 123-45-6789", None, "")
    found = redact.hits(pages, load_patterns(["SSN"], r"GREEN-FOLDER-\d+"), keep_last=4)
    assert found.where("path = 'f0.pdf'").count() == 1
    text = {r.path: r.redacted for r in redact.masked(pages, found).collect()}
    assert text["f1.pdf"] == "SSN: ███████6789 again ███████6789" and text["f2.pdf"] is None and text["f3.pdf"] == ""
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    scan_stream(stream, load_patterns(["SSN"]), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == redact.hits(pages, load_patterns(["SSN"])).count()


def test_split_numbers(spark):
    w = lambda words: spark.createDataFrame([("b", "p", 1, i, x) for i, x in enumerate(words)], "batch_id string, path string, page_no int, word_idx int, text string")
    assert [(r.word_idx, r.matched) for r in redact.split_numbers(w("SSN 123 - 45 - 6789".split())).collect()] == [(1, "123-45-6789")]
    assert redact.split_numbers(w("123 - 45 - 6789".split()), False).count() == 1
    assert redact.split_numbers(w("123 - 45 - 6789".split())).count() == 0
    assert [r.share for r in redact.word_hits(w(["SSN", "123-45-6789"]), load_patterns(["SSN"])[:1], keep_last=4).collect()] == [pytest.approx(5 / 9)]


FILES = "batch_id string, ord long, path string, page_count long, is_locked boolean"


def test_assign(spark):
    files = spark.createDataFrame([("b", 0, "doc2.pdf", 1, False), ("b", 1, "doc1.pdf", 2, False), ("b", 2, "sub/l.pdf", None, True), ("b", 3, "x/__MACOSX/y.pdf", 1, False), ("b", 4, "n.txt", None, False), ("b", 5, "i.png", None, False)], FILES)
    records, failed = labels.assign(files, "PLM", 1, 6)
    assert [tuple(r) for r in records.orderBy("first_no").select("path", "first_label", "last_label").collect()] == [("doc1.pdf", "PLM 000001", "PLM 000002"), ("doc2.pdf", "PLM 000003", "PLM 000003"), ("i.pdf", "PLM 000004", "PLM 000004")]
    assert [r.path for r in failed.collect()] == ["sub/l.pdf"]
    skip = spark.createDataFrame([("b", "doc1.pdf", "OLD 1", "OLD 2")], "batch_id string, path string, first_label string, last_label string")
    kept = {r.path: r.first_label for r in labels.assign(files, "PLM", 1, 6, skip)[0].collect()}
    assert kept == {"doc1.pdf": "OLD 1", "doc2.pdf": "PLM 000001", "i.pdf": "PLM 000002"}


def detect(spark, texts, pages=1):
    blocks = spark.createDataFrame([("b", "f.pdf", p, i, 0, 750.0, 792.0, t) for i, (p, t) in enumerate(texts)], "batch_id string, path string, page_no int, block_no int, block_type int, y0 double, page_height double, text string")
    files = spark.createDataFrame([("b", "f.pdf", pages)], "batch_id string, path string, page_count int")
    r = labels.detect(blocks, files).first()
    return r.first_label, r.last_label


def test_detect(spark):
    assert detect(spark, [(1, "ABC 000001 XYZ 000002")]) == ("ABC 000001", "ABC 000001")
    assert detect(spark, [(1, "PAGE 000123")]) == ("000123", "000123")
    assert detect(spark, [(1, "000000")]) == ("", "")
    assert detect(spark, [(1, "abc 000009"), (3, "abc 000002"), (2, "abc 000001")], 3) == ("ABC 000002", "ABC 000009")


def test_fill_gaps(spark):
    files = spark.createDataFrame([("b", "a10.pdf", 1), ("b", "a2.pdf", 3), ("b", "k.pdf", 1), ("b", "z.txt", 1)], "batch_id string, path string, page_count int")
    records = spark.createDataFrame([("b", 0, "./k.pdf", "QRS 000007", "QRS 000007")], "batch_id string, ord int, path string, first_label string, last_label string")
    got = {r.path: (r.first_label, r.last_label) for r in labels.fill_gaps(files, records).collect()}
    assert got == {"k.pdf": ("QRS 000007", "QRS 000007"), "a2.pdf": ("QRS 000008", "QRS 000010"), "a10.pdf": ("QRS 000011", "QRS 000011"), "z.txt": (None, None)}
    none = labels.infer_numbering(records.withColumn("first_label", F.lit("")).withColumn("last_label", F.lit(""))).first()
    assert (none.prefix, none.digits, none.next_number) == ("", 8, 1)


def test_names_and_years(spark):
    rows = spark.createDataFrame([("b", i, "x", n) for i, n in enumerate(["a.pdf", "a.pdf", "a__1.pdf", "c.pdf", "c.pdf"])], "batch_id string, ord int, folder string, name string")
    assert [r.placed for r in free_names(rows).orderBy("ord").collect()] == ["a.pdf", "a__1.pdf", "a__1__1.pdf", "c.pdf", "c__1.pdf"]
    files = spark.createDataFrame([("b", 0, "ledger_2021.pdf", None, None), ("b", 1, "noyear.pdf", "D:20190101", None), ("b", 2, "t.pdf", None, None), ("b", 3, "file.pdf", None, None), ("b", 4, "x.txt", None, None)], "batch_id string, ord int, path string, mod_date string, creation_date string")
    pages = spark.createDataFrame([("b", "t.pdf", 1, "signed 3-4-2015 and 1999")], PAGE)
    got = {r.path: (r.folder, r.method) for r in organize.organized(files, pages).collect()}
    assert got == {"ledger_2021.pdf": ("2021", "filename"), "noyear.pdf": ("2019", "metadata"), "t.pdf": ("2015", "content"), "file.pdf": ("Unknown", "none"), "x.txt": ("Unknown", "none")}


def test_index_sources(spark):
    files = spark.createDataFrame([("b", 0, "p/a.pdf"), ("b", 1, "q/a.pdf"), ("m", 0, "a.pdf"), ("d", 0, "a.pdf"), ("d", 1, "__bates_records.json")], "batch_id string, ord int, path string")
    recs = spark.createDataFrame([("b", 0, "", "p", "a.pdf", "N 1", "N 2"), ("b", 1, "q/a.pdf", "", "a.pdf", "N 3", ""), ("b", 2, "q/a.pdf", "", "a.pdf", "N 5", "N 6")], "batch_id string, ord int, path string, rel_dir string, filename string, first_label string, last_label string")
    meta = spark.createDataFrame([("m", 0, "a.pdf", None, "M 1 - M 2"), ("b", 0, "a.pdf", None, "M 9")], "batch_id string, ord int, name string, path string, bates_range string")
    found = spark.createDataFrame([("d", "a.pdf", "D 1", "D 1")], "batch_id string, path string, first_label string, last_label string")
    rows = index.index_rows(files, recs, meta, found)
    assert {(r.batch_id, r.path): r.bates_range for r in rows.collect()} == {("b", "p/a.pdf"): "N 1 - N 2", ("b", "q/a.pdf"): "N 5 - N 6", ("m", "a.pdf"): "M 1 - M 2", ("d", "a.pdf"): "D 1"}
    lines = index.sheet(rows).where("batch_id = 'b'").orderBy("row_no").collect()
    assert [(r.row_no, r.row_type, r.text) for r in lines] == [(3, "header", "Category & Documents provided"), (4, "category", "p"), (5, "document", "a.pdf"), (6, "blank", ""), (7, "category", "q"), (8, "document", "a.pdf"), (9, "blank", "")]


def test_ranks_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(i):
        made.add(1)
        return f"A {i // 2:07d}" if i % 3 else ""

    rows = spark.range(60).select(F.lit("b").alias("batch_id"), F.lit("c").alias("category"), F.col("id").alias("ord"), label("id").alias("bates_range"))
    ranks = index.range_ranks(index.range_ranks(rows, ["batch_id", "category"]).withColumnRenamed("rank", "up"), ["batch_id", "category"], descending=True)
    got = {r.ord: (r.up, r["rank"]) for r in ranks.collect()}
    assert made.value == 60
    no = lambda i: i // 2 if i % 3 else 1 << 40
    up, down = sorted(range(60), key=lambda i: (no(i), i)), sorted(range(60), key=lambda i: (-no(i), i))
    assert got == {i: (up.index(i) + 1, down.index(i) + 1) for i in range(60)}


def test_years_of_names(spark):
    """The quick way to the first year is the first of all candidates; names without numbers are read once."""
    from paperloom.functions import dates as D

    names = ["a 1899 b 1999.pdf", "12001 2001", "x\n20200103", "\U0001f600 Jan 3, 2020x", "3-4-2015", "19951995", "May 5 1850 2150", "\u0662\u0660 2030", "20\u0661\u0662 1912", "", None, "none"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for low, high in ((1900, 2099), (2000, 2020), (1990, 1999)):
        for a, b in rows.select(D.year_of(F.col("n"), low, high, "first"), D.pick_year(D.year_candidates(F.col("n"), low, high), "first")).collect():
            assert a == b


def test_names_without_numbers_are_not_counted(spark, monkeypatch):
    from paperloom.operators import collisions

    tables = []
    monkeypatch.setattr(collisions, "written", lambda df, name: (tables.append(name), written(df, name))[1])
    rows = spark.createDataFrame([("b", i, "x", "a.pdf") for i in range(3)], "batch_id string, ord int, folder string, name string")
    assert sorted(r.placed for r in free_names(rows).collect()) == ["a.pdf", "a__1.pdf", "a__2.pdf"] and tables == []


def test_scan_samples(spark):
    files = spark.createDataFrame([("b", "f", 25), ("b", "g", 2), ("b", "h", None)], "batch_id string, path string, page_count int")
    rows = scan.sample_pages(files).collect()
    assert sorted(r.page_no - 1 for r in rows if r.path == "f") == [0, 2, 5, 7, 10, 12, 15, 17, 20, 22]
    assert sorted(r.page_no for r in rows if r.path == "g") == [1, 2]


def test_intake_and_results(spark, tmp_path):
    def packed(**members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return b.getvalue()

    good = packed(**{"a/x.pdf": "1", "__bates_records.json": '[{"path":"a/x.pdf","first_label":"A 1","pages":2}]', "q/__MACOSX/._x": "j", "d/": ""})
    (tmp_path / "one.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"no")
    members = intake.expand(intake.read_archives(spark, str(tmp_path)))
    got = {(r.archive, r.path): r.error for r in members.collect()}
    assert got == {("one.zip", "a/x.pdf"): None, ("one.zip", "__bates_records.json"): None, ("bad.zip", "bad.zip"): "Not a valid ZIP file"}
    records = intake.sidecar_records(members)
    assert [(r.path, r.first_label, r.pages) for r in records.collect()] == [("a/x.pdf", "A 1", 2)]
    assert '"path":"a/x.pdf"' in results.sidecar_json(records).first().content
    texts = spark.createDataFrame([("b", '[{"name":"n","fullPath":"p/n","batesRange":"A 1 - A 2"}]'), ("c", '{"name":"n"}'), ("d", "no"), ("e", None)], "batch_id string, text string")
    assert [(r.batch_id, r.path) for r in intake.client_metadata(texts).collect()] == [("b", "p/n")]
    (tmp_path / "pw.csv").write_text("Password,Filename\ns3,a.pdf\n,b.pdf\n")
    assert [tuple(r) for r in intake.read_password_list(spark, str(tmp_path / "pw.csv")).collect()] == [("a.pdf", "s3")]


def test_failures_and_delivery(spark):
    rows = spark.createDataFrame([("b", "café.pdf", "x"), ("b", "a", "y")], "batch_id string, path string, reason string")
    assert report.failures_header(report.merged_failures([rows, rows.withColumn("reason", F.lit("later"))])).first().header == '{"a":"y","caf\\u00E9.pdf":"x"}'
    entries = spark.createDataFrame([("b", "x.pdf"), ("b", "_redaction_audit.json"), ("c", "x.txt"), ("d", "x.pdf"), ("d", "y.pdf")], "batch_id string, path string")
    assert {r.batch_id: r.single for r in report.delivery(entries).collect()} == {"b": "x.pdf", "c": None, "d": None}


def test_kinds_of_files(spark):
    text = "mail a@b.example.org"
    pages = spark.createDataFrame([("b", p, 1, text) for p in ("x.pdf", "x.JPG", "x.txt", "x", "x.tif")], PAGE)
    assert sorted(r.path for r in redact.hits(pages, load_patterns(["Email"])).collect()) == ["x.JPG", "x.pdf"]
    # At the head of a page only an image has a label, and one only.
    rows = [("b", p, 1, 0, 0, 10.0, 792.0, "KLM 000005 KLM 000009") for p in ("h.pdf", "h.png", "h.txt")] + [("b", "g.pdf", 1, 0, 0, 780.0, 792.0, "KLM 000005 KLM 000009")]
    blocks = spark.createDataFrame(rows, "batch_id string, path string, page_no int, block_no int, block_type int, y0 double, page_height double, text string")
    files = blocks.selectExpr("batch_id", "path", "1 as page_count")
    got = {r.path: (r.first_label, r.last_label) for r in labels.detect(blocks, files).collect()}
    assert got["h.pdf"] == got["h.txt"] == ("", "") and got["h.png"] == ("KLM 000005", "KLM 000005") and got["g.pdf"][0] == "KLM 000005"


def test_utc_in_any_zone(spark):
    from paperloom.functions.dates import iso_utc

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert spark.range(1).select(iso_utc(F.timestamp_seconds("id"))).first()[0] == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
