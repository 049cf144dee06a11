"""Divergence rules, line dedup, language identification, mixing."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import divergence, language, line_dedup, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)})


def test_base_counts(spark, odd, none, sf_dir):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)):
        want = sorted((str(r.doc_id), *base(r.text)) for r in docs.collect())
        got = divergence.judge(docs).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert divergence.judge(none).count() == 0


def test_divergence_separates_labels(spark, sf_dir):
    out = divergence.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    met = out.where("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in met}
    assert kept[1] > 0.97 and kept[0] < 0.05


def test_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in rows.select(divergence.distance(F.col("p"), F.col("q"))).collect()] == [1.0, 0.0, None]


def test_references_are_exact_medians(spark):
    n = 300_001
    # Every value from 0 to n - 1 once, in no order; then a language of two documents.
    x = (F.col("id") * 7919 % n).cast("double")
    zeros = F.array_repeat(F.lit(0.0), len(divergence.CLASSES) - 1)
    row = lambda lang, x: [F.lit(lang).alias("lang"), F.concat(F.array(x, F.lit(float(n)) - x), zeros).alias("classes"), F.array(F.lit(float(n)) - x, x).alias("common")]
    many, two = spark.range(n).select(*row("en", x)), spark.range(2).select(*row("xx", F.col("id").cast("double"))).withColumn("common", F.lit(None).cast("array<double>"))
    counted = many.union(two).withColumn("judged_classes", F.lit(True)).withColumn("judged_common", F.col("common").isNotNull())
    got = {r.lang: r for r in divergence.references(counted).collect()}
    middle = n // 2
    assert got["en"].classes[:3] == [middle / n, (n - middle) / n, 0.0] and got["en"].common == [(n - middle) / n, middle / n]
    assert got["xx"].classes[:2] == [0.0, (n - 1) / n] and got["xx"].common is None and len(got["xx"].classes) == len(divergence.CLASSES) + 1


def test_line_dedup(spark, odd, none):
    got = line_dedup.drop_boilerplate(odd, max_ratio=0.5, min_pages=3)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[12].text == "x\nown 1" and rows[13].text == "own 2" and rows[12].n_lines == 3 and rows[12].n_removed == 1
    assert rows[4].text is None and rows[4].n_lines == 0 and rows[6].text == " \t\n " and rows[11].text == "x\ny\nx\n\nx"
    assert got.count() == odd.count() and line_dedup.drop_boilerplate(none).count() == 0


def test_language(spark, odd, none, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    out = language.identify(docs.where(language.held_out()), model)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {4, 5, 6, 9}
    one = {r.lang: r.text for r in docs.where("length(text) between 1500 and 3000").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, one["en"] + " " + one["fr"]), (2, one["en"])], "doc_id long, text string")
    found = {r.doc_id: r.languages for r in language.identify(mixed, model).collect()}
    assert "en:" in found[1] and "fr:" in found[1] and found[2] == "en:1.000"
    # Numerals of any kind are no letters; a single letter of any script is one.
    signs = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² Ⅷ", "①②", "12 _ ٣", "½ a", "漢", "²ß"])], "doc_id long, text string")
    assert sorted(r.doc_id for r in language.identify(signs, model).where("lang_pred = 'und'").collect()) == [0, 1, 2]
    empty = language.fit(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"} and language.identify(none, model).count() == 0


def test_targets():
    sizes = [("a", 100), ("b", 1000), ("c", 1000), ("d", 0)]
    goal = mixing.targets(sizes, [1, 2, 3, 1], 2100)
    assert goal[0] == 300 and goal[3] == 0 and sum(goal) == pytest.approx(2100) and goal[2] == pytest.approx(1.5 * goal[1])
    assert mixing.targets([("a", 10)], [1], 10) == [10.0] and mixing.targets([("a", 10), ("b", 0)], [1, 5], 100) == [30.0, 0.0]


def test_mix(spark, odd, none):
    rows = mixing.mix(odd, block=16).collect()
    assert len(rows) == odd.count()
    assert [r for r in rows if r.taken > 3 * r["size"] or r.taken < 0] == []
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.taken
    big = [x for x in by.values() if x[2] > 500]
    assert all(abs(t - goal) <= 0.06 * goal for t, goal, _ in big)
    again = mixing.mix(odd.repartition(3), block=16).collect()
    key = lambda r: (str(r.doc_id), r.source or "", r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0 and mixing.repeat_rows(none).count() == 0
    assert mixing.repeat_rows(odd).columns == odd.columns


@pytest.mark.parametrize("few", [5, 10_000])
def test_many_sources(spark, monkeypatch, few):
    # More sources than are sent to tasks: the same targets as on the driver, each met, and the same mix either way.
    monkeypatch.setattr(mixing, "SOURCES", few)
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 1200 = 7 then null else concat('s', id % 1200) end as source", "case when id % 3 = 0 then null else repeat('w ', cast(id % 50 as int)) end as text")
    facts = mixing.source_facts(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    rows = sorted(facts.collect(), key=lambda r: r.source_no)
    names = sorted((r.source for r in rows if r.source is not None), key=lambda x: x.encode()) + [None]
    assert [r.source for r in rows] == names and len(rows) == 1200
    goal = mixing.targets([(r.source, r.source_size) for r in rows], [1 + k % 3 for k in range(1200)], sum(r.source_size for r in rows))
    assert [r.target for r in rows] == pytest.approx(goal)
    taken = {r.source: (r.t, r.target, r.most) for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("most")).collect()}
    assert all(abs(t - g) <= max(4, 0.2 * m) for t, g, m in taken.values())


def test_clashing_columns(spark, odd):
    import corpus_pipeline as cp

    names = ["_host", "_boilerplate", "_kept", "_page", "_family", "_mixed", "_times", "_copy", "_kept_id", "kept_id", "_predicted", "lang_pred", "languages", "n_lines", "n_removed", "_Host"]
    docs = odd.drop("host", "score")
    for n in names[:-1]:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names[:-1])


def test_divergence_of_languages_without_reference(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr'").select("doc_id", "text").limit(60)
    out = divergence.judge(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "it")))
    rows = out.collect()
    assert all(r.common_distance is None for r in rows) and all(r.class_distance is None for r in rows if r.lang is None)
    assert all(r.kept != r.base_failed for r in rows if r.lang is None)


def test_mixture_equals_plain_expectation_maximisation():
    import numpy as np

    g = np.random.default_rng(3)
    p = g.dirichlet(np.full(60, 0.2), 4).T + 1e-4
    p /= p.sum(axis=0)
    for shares in ([1.0, 0, 0, 0], [0.6, 0.4, 0, 0], [0.3, 0.3, 0.2, 0.2]):
        counts = g.multinomial(6000, p @ np.array(shares))
        place = np.flatnonzero(counts)
        got = language.infer(p, np.tile(place, 2), np.tile(counts[place], 2).astype(float), np.array([0, len(place)]))
        assert np.allclose(got[0], got[1]) and np.abs(got[0] - shares).max() < 0.06 and ((got[0] > 0) == (np.array(shares) > 0)).all()  # four languages too
        share, value = language.mixture(p[place], counts[place].astype(float), np.array([0]))
        plain = np.full(4, 0.25)
        for _ in range(3000):
            part = p[place] * plain
            plain = (part * (counts[place] / part.sum(axis=1))[:, None]).sum(axis=0) / counts.sum()
        best = (np.log(p[place] @ plain) * counts[place]).sum()
        assert np.abs(share[0] - plain).max() < 0.02 and best - 5 <= value[0] <= best + 1e-6


def test_unknown_languages_score_low(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(1, "Это русский текст о погоде и природе, который никто не учил раньше."), (2, "これは日本語の文章です。天気と自然について。")]
    rows = language.identify(spark.createDataFrame(texts, "doc_id long, text string"), language.fit(docs)).collect()
    assert all(r.score < 0.1 for r in rows)
