"""Decontamination against SQL and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate as D
from paperloom.operators.storage import written
from tests.conftest import same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        ws, hit, named = words(text), set(), set()
        for item_id, other in items:
            phrase = words(other)
            n = min(window, len(phrase))
            if item_id is None or not n:
                continue
            asked = {tuple(phrase[s : s + n]) for s in range(len(phrase) - n + 1)}
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in asked:
                    hit.update(range(i, i + n))
                    named.add(str(item_id))
        out.append((doc_id, len(ws), len(hit), sorted(named)))
    return sorted(out, key=repr)


def check(spark, docs, items, window):
    got = D.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=repr) == brute(docs, items, window)


@pytest.mark.parametrize("seed", range(3))
def test_few_words(spark, seed):
    # Few different words, so that phrases recur, overlap and repeat themselves.
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(["a", "B", "c,", "É"]) for _ in range(n))
    docs = [(i, some(r.randrange(60))) for i in range(30)] + [(3, some(20)), (4, None), (4, None), (None, some(30)), (90, "")]
    items = [(i, some(r.randrange(12))) for i in range(12)] + [(2, some(6)), (50, None), (51, " "), (None, some(3)), (7, "a B c"), (8, "A b C")]
    check(spark, docs, items, 5)


def test_edges(spark, odd, none):
    long_ = " ".join(f"w{i}" for i in range(50_000))
    check(spark, [(1, long_), (2, long_ + " x"), (3, "w7 w8 w9")], [(1, " ".join(f"W{i}" for i in range(100, 400))), (2, "w8"), (3, "nowhere w8")], 10)
    items = spark.createDataFrame([(1, "word1 the word2 the word3")], ITEMS)
    assert D.contamination(odd, items).count() == odd.count() and D.contamination(none, items).count() == 0
    assert D.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert D.contamination(odd, items).where("n_hit = 5 and doc_id in (1, 2)").count() == 3


def test_hot_passage(spark):
    # One passage in a third of the documents, and in several items.
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, f"x{i} {passage if i % 3 == 0 else 'none'} y") for i in range(300)]
    check(spark, docs, [(k, f"{passage} z{k}") for k in range(5)], 10)


def test_proximity(spark):
    docs = written(spark.createDataFrame([(1, "far one near two x three y"), (2, "one two " + "z " * 9 + "three"), (3, "three three two one one")], DOCS).withColumnRenamed("doc_id", "doc"), "t")
    items = D.item_texts(spark.createDataFrame([(1, "one two three")], ITEMS))
    vocabulary = written(items.select(F.explode("ws").alias("word")).select("word", F.xxhash64("word").alias("term")), "t")
    index = written(D.postings(docs, vocabulary), "t")
    known = D.with_frequency(index, vocabulary, items)
    assert {r.doc for r in D.proximity_matches(index, known, 10, 4).collect()} == {1, 3}
    assert {r.doc for r in D.proximity_matches(index, known, 10, 12).collect()} == {1, 2, 3}
    assert {r.doc for r in D.proximity_matches(index, known, 10, 1).collect()} == {3}


def test_query(spark, sf_dir, duck):
    same_rows(D.op11_decontaminate(spark, sf_dir).toPandas(), duck.sql(D.OP11_SQL).df())
