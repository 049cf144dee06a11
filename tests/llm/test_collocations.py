"""Collocations and the bidirectional index against brute force and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import collocations as C
from paperloom.llm.bidirectional import Index
from tests.conftest import same_rows

DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("seed", range(8))
def test_index(seed):
    r = random.Random(seed)
    text = np.array([0, *[r.randrange(r.choice([2, 6])) if r.random() < 0.8 else 0 for _ in range(r.choice([1, 3, 50, 400]))], 0], np.int64)
    count = lambda m: Counter(tuple(text[i : i + m].tolist()) for i in range(len(text) - m + 1) if all(text[i : i + m]))
    index = Index(text)
    found = index.single()
    grams = np.arange(1, index.top)[:, None]
    for step in (index.right, index.right, index.left):
        of, word, found = step(found)
        grams = np.concatenate([grams[of], word[:, None]] if step == index.right else [word[:, None], grams[of]], axis=1)
        assert {tuple(g): n for g, n in zip(grams.tolist(), found.count.tolist(), strict=True)} == count(grams.shape[1])
    first = np.searchsorted(np.sort(text), grams[:, 0])
    assert (found.forward >= first).all()


def brute(docs, least, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, 5) for i in range(len(ws) - m + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    rows = []
    for (lang, p), a in cand.items():
        inside = any(q != p and len(q) > len(p) and other == lang and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in cand.items())
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not inside:
            rows.append((lang, -score, -a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out = []
    for lang in n:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (r[1], r[2], r[3].encode()))[:top]
        out += [(lang, i, r[3], -r[2], r[4], r[5], r[6], -r[1]) for i, r in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [5, 40, 10_000])
def test_against_brute_force(spark, size):
    # Small shards, so that counts come from many; ties in score, count and cut.
    r = random.Random(size)
    some = lambda: "".join(r.choice(["red ", "RED  fox", " fox", "\tÉté ", ". ", "\n", ", red fox jumps ", "\x0bx\x1fy "]) for _ in range(30))
    docs = [(i, some(), r.choice(["en", "und", None])) for i in range(40)] + [(1, "red fox " * 50, "fr"), (1, "red fox " * 50, "fr"), (2, None, "xx"), (3, "", "yy"), (4, " .", None)]
    table = spark.createDataFrame(docs, DOCS)
    got = sorted(tuple(x) for x in C.collocations(table, 5, 80, 12, size).drop("left", "right").collect())
    assert got == brute(docs, 5, 80, 12)


def test_extensions_and_shards(spark):
    docs = spark.createDataFrame([(1, "a b c. a b d. x a b c", "en")], DOCS)
    found = {x.phrase: (x.a, x.left, x.right) for x in C.collocations(docs, 1, 101, 100).collect()}
    assert found["a b"] == (3, 1, 2) and found["x a b c"] == (1, 0, 0) and found["b c"] == (2, 2, 0)
    long_ = spark.createDataFrame([(1, "w " * 3000, "en"), (2, "w. " * 3000, "en")], DOCS)
    parts = C.shards(long_.coalesce(1), 500).collect()
    sizes = [len(p.tokens) // 4 for p in parts]
    assert sum(sizes) == 9002 and max(sizes) == 3001 and sum(s <= 502 for s in sizes) >= 11  # a passage is never cut


def test_frequent_pairs_meet_no_shards_again(spark):
    """Pairs are summed over shards and kept in each of them, without a join or lists of them."""
    local = spark.createDataFrame([(1, 7, 2), (2, 7, 3), (1, 8, 4), (3, 9, 5)], "shard long, pair long, n long")
    got = C.frequent(local, 5)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 5), (2, 7, 5), (3, 9, 5)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_odd(spark, odd, none):
    assert C.collocations(none).count() == 0
    got = sorted(tuple(x) for x in C.collocations(odd, 2).drop("left", "right").collect())
    assert got == brute([(r.doc_id, r.text, r.lang) for r in odd.collect()], 2, 80, 2000)


def test_query(spark, duck, sf_dir):
    same_rows(C.op13_collocations(spark, sf_dir).toPandas(), duck.sql(C.OP13_SQL).df())
