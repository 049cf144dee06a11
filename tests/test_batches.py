"""Archives in archives, validation, passes of redaction and the finished batch, at their edges."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions.patterns import load_patterns
from paperloom.plans import finalize, passes, redact, validate
from paperloom.sources import intake


def packed(method=zipfile.ZIP_DEFLATED, **members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def expanded(spark, archives, **options):
    members, failures = intake.expand_all(spark.createDataFrame(archives, "archive string, content binary"), **options)
    return sorted((r.batch_id, r.within, list(r.place), r.path, None if r.content is None else bytes(r.content)) for r in members.collect()), sorted((r.batch_id, r.path, r.stage, r.reason) for r in failures.collect())


def test_archives_in_archives(spark):
    inner = packed(zipfile.ZIP_STORED, **{"k.pdf": b"kk", "é.pdf": b"", "deep.zip": packed(**{"z.pdf": b"z" * 100_000})})
    good = packed(**{"a.pdf": b"a", "d/": b"", "in.zip": inner, "__MACOSX/._a": b"j", "x/bad.ZIP": b"no", "n.txt": b"t", "__MACOSX/._b.zip": b"junk"})
    spoiled = bytearray(packed(zipfile.ZIP_STORED, **{"s.pdf": b"0123456789", "t.pdf": b"fine"}))
    spoiled[spoiled.index(b"0123456789")] = ord("x")
    rows = [("g.zip", bytearray(good)), ("loose.pdf", bytearray(b"p")), ("broken.zip", bytearray(b"PK")), ("none.zip", None), ("s.zip", spoiled)]
    members, failures = expanded(spark, rows)
    assert [m[0:2] + m[3:] for m in members] == [
        ("g.zip", "g.zip", "a.pdf", b"a"), ("g.zip", "g.zip", "n.txt", b"t"), ("g.zip", "g.zip!in.zip", "k.pdf", b"kk"), ("g.zip", "g.zip!in.zip", "é.pdf", b""),
        ("g.zip", "g.zip!in.zip!deep.zip", "z.pdf", b"z" * 100_000), ("loose.pdf", None, "loose.pdf", b"p"), ("s.zip", "s.zip", "t.pdf", b"fine"),
    ]
    assert failures == [("broken.zip", "broken.zip", "intake", intake.BAD_ARCHIVE), ("g.zip", "x/bad.ZIP", "intake", intake.BAD_ARCHIVE), ("none.zip", "none.zip", "intake", intake.BAD_ARCHIVE), ("s.zip", "s.pdf", "intake", "Damaged archive member")]
    assert expanded(spark, []) == ([], [])
    few, deep = expanded(spark, rows[:1], allowed=(".pdf",), deepest=1)
    assert [m[3] for m in few] == ["a.pdf"] and [f[1] for f in deep] == ["in.zip", "x/bad.ZIP"] and "inside" in deep[0][3]


SETTINGS = "batch_id string, presets string, regexes string, literals string"
FILES = "batch_id string, ord int, path string, within string, error string"


def test_validation(spark):
    files = spark.createDataFrame(
        [
            ("ok", 0, "a.PDF", None, None), ("ok", 1, "z.txt", "z.zip", None), ("two", 0, "b.doc", None, None), ("two", 1, "c.zip", None, intake.BAD_ARCHIVE), ("two", 2, "d.pdf", None, None), ("junk", 0, "x/__MACOSX/y.doc", None, None),
            ("bare", 0, "a.pdf", None, None), ("regex", 0, "a.pdf", None, None), ("lit", 0, "a.pdf", None, None), ("free", 0, "q.pdf", None, None),
        ],
        FILES,
    )
    settings = spark.createDataFrame([("ok", "SSN", None, None), ("two", "SSN", None, None), ("junk", "SSN", None, None), ("bare", "what", "  # only this\n\n", " , \n"), ("regex", None, "fine\n[bad", None), ("lit", "", "", "#1")], SETTINGS)
    found = validate.violations(files, settings, validate.upload_rules())
    assert sorted((r.batch_id, r.ord, r.rule) for r in found.collect()) == [("bare", -1, "patterns"), ("junk", -1, "empty"), ("regex", -1, "regex"), ("two", 0, "kind"), ("two", 1, "archive")]
    accepted, failures = validate.judged(files, found)
    assert {r.batch_id for r in accepted.collect()} == {"ok", "lit", "free"}
    said = {r.batch_id: (r.path, r.reason, r.violations) for r in failures.collect()}
    assert said["two"] == ("b.doc", "'b.doc' is not supported. Upload PDF or ZIP files only.", 2) and said["junk"] == (None, validate.EMPTY, 1) and "[bad" in said["regex"][1]
    assert validate.judged(files, found.limit(0))[0].count() == 10


PAGE = "batch_id string, path string, page_no int, text string"
WORD = "batch_id string, path string, page_no int, word_idx int, text string"


def test_passes(spark, tmp_path):
    store = str(tmp_path / "runs")
    pages = spark.createDataFrame([("b", "a.pdf", 1, "SSN 123-45-6789 mail x@y.org"), ("b", "w.pdf", 1, None)], PAGE)
    words = spark.createDataFrame([("b", "w.pdf", 1, i, w) for i, w in enumerate("SSN 123 - 45 - 6789 ssn 123-45-6789 x@y.org".split())], WORD)
    files = spark.createDataFrame([("b", "a.pdf", 0), ("b", "w.pdf", 1)], "batch_id string, path string, ord int")
    for run in ("r", "other"):
        passes.begin(store, run, pages, words, files)
    first = lambda: passes.redact_pass(spark, store, "r", 1, load_patterns(["SSN"])[:1], keep_last=4)
    text = lambda k, run="r": {r.path: r.text for r in passes.pages_of(spark, store, run, k).collect()}["a.pdf"]
    assert first().count() == 3 and text(1) == "SSN ███████6789 mail x@y.org"
    left = [r.text for r in spark.read.parquet(f"{store}/words").where("run_id = 'r' and pass_no = 1").orderBy("word_idx").collect()]
    assert left == ["SSN", "███", "█", "██", "█", "████", "ssn", "███████6789", "x@y.org"]
    passes.redact_pass(spark, store, "r", 2, load_patterns(["Email"]))
    assert text(2) == "SSN ███████6789 mail ███████" and {r.file for r in passes.audit_of(spark, store, "r").collect()} == {"a.pdf", "w.pdf"}
    again = lambda: sorted(map(str, passes.hits_of(spark, store, "r").collect()))
    before = again()
    passes.redact_pass(spark, store, "r", 2, load_patterns(["Email"]))
    assert again() == before
    passes.redact_pass(spark, store, "r", 2, load_patterns(["EIN"]))  # other patterns: its hits are replaced, by none
    assert passes.hits_of(spark, store, "r").where("pass_no = 2").count() == 0 and passes.audit_of(spark, store, "r").count() == 0 and text(2) == text(1)
    assert passes.hits_of(spark, store, "r").where("pass_no = 1").count() == 3 and text(0, "other") == text(0)
    with pytest.raises(ValueError):
        passes.redact_pass(spark, store, "r", 4, load_patterns(["EIN"]))


def test_finished(spark):
    files = spark.createDataFrame([("b", 0, "2020/2021-02-03/k.pdf", "k.pdf"), ("b", 1, "k.pdf", "k2.pdf"), ("b", 2, "lost.pdf", "lost.pdf"), ("c", 0, "z.pdf", "z.pdf")], "batch_id string, ord int, path string, source_path string")
    records = spark.createDataFrame([("b", 0, "./2020\\2021-02-03/", "k.pdf", "P 1", ""), ("b", 1, ".", "k.pdf", "P 2", "P 3"), ("b", 2, "", "k.pdf", "P 4", "P 5")], "batch_id string, ord int, rel_dir string, filename string, first_label string, last_label string")
    events = spark.createDataFrame([("b", 1, "redact", "failed", "k2.pdf", "why"), ("b", 2, "redact", "ok", "k.pdf", None)], "run_id string, seq long, stage string, event string, filename string, reason string").withColumn("ts", F.timestamp_seconds("seq"))
    lost = spark.createDataFrame([("b", "lost.pdf"), ("b", "lost.pdf")], "batch_id string, path string")
    rows = finalize.finished(files, records, events, lost)
    got = {(r.batch_id, r.ord): (r.bates_range, str(r.date_produced), r.stages_ok) for r in rows.collect()}
    # By path the last record counts; a batch without any source has empty labels.
    assert got == {("b", 0): ("P 1", "2021-02-03", ["redact"]), ("b", 1): ("P 4 - P 5", "2000-01-01", []), ("c", 0): ("", "2000-01-01", None)}
    told = {r.batch_id: tuple(r)[1:6] for r in finalize.totals(rows, lost, events).collect()}
    assert told == {"b": (3, 1, 2, "P 1", "P 5"), "c": (1, 1, 0, None, None)}
    names = sorted((r.batch_id, r.entry_name) for r in finalize.manifest(rows, lost.limit(0)).collect())
    assert ("c", finalize.INDEX_NAME) in names and ("b", finalize.AUDIT_NAME) not in names and len(names) == 7


def test_finished_keeps_each_file_once(spark):
    """Files alike but for where they came from stay as many as they are; a batch's rows meet one source."""
    files = spark.createDataFrame([("b", 0, "k.pdf", "in1"), ("b", 0, "k.pdf", "in2"), ("b", None, "z.pdf", "in3")], "batch_id string, ord int, path string, source_path string")
    records = spark.createDataFrame([("b", 0, "", "k.pdf", "P 1", "P 2")], "batch_id string, ord int, rel_dir string, filename string, first_label string, last_label string")
    events = spark.createDataFrame([("b", 1, "redact", "ok", "in2", None)], "run_id string, seq long, stage string, event string, filename string, reason string").withColumn("ts", F.timestamp_seconds("seq"))
    rows = finalize.finished(files, records, events, files.select("batch_id", "path").limit(0), meta=records.limit(0).select("batch_id", "ord", F.col("filename").alias("name"), F.col("filename").alias("path"), F.col("first_label").alias("bates_range")))
    assert sorted((r.source_path, r.bates_range, r.stages_ok) for r in rows.collect()) == [("in1", "P 1 - P 2", None), ("in2", "P 1 - P 2", ["redact"]), ("in3", "", None)]


def test_a_pass_moves_no_rows(spark):
    """What a pass finds on pages that have met their words needs no shuffle."""
    pages = spark.createDataFrame([("b", "a.pdf", 1, "x@y.org", None)], PAGE + ", words array<struct<i:int,t:string,x0:double,y0:double,x1:double,y1:double>>")
    met = redact.with_hits(pages, load_patterns(["Email"]))
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and [r.matched for r in redact.hit_rows(met).collect()] == ["x@y.org"]


def test_unpacked_batches_are_small():
    """Members that unpack to much more than is stored go on in batches of their own."""
    import zlib

    import pandas as pd

    content = bytes(1 << 21)
    packer = zlib.compressobj(wbits=-15)
    raw = packer.compress(content) + packer.flush()
    n = 9
    rows = pd.DataFrame({"path": [f"{i}.txt" for i in range(n)], "method": [8] * n, "crc": [zlib.crc32(content)] * n, "raw": [raw] * (n - 1) + [b"bad"], "error": [None] * n})
    out = list(intake.unpacked(iter([rows])))
    assert [len(x) for x in out] == [2, 2, 2, 2, 1] and [p for x in out for p in x["path"]] == list(rows["path"])
    assert max(sum(len(c or b"") for c in x["content"]) for x in out) <= intake.BATCH_BYTES and out[-1]["error"].tolist() == ["Damaged archive member"]
