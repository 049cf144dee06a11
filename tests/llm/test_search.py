"""Near duplicates, substring dedup, top-k, archives, components, the pipeline: against brute force or SQL."""

import math
import random
import re

import numpy as np
import pytest

from paperloom.llm import components, fm_index, near_dedup, substring_dedup, topk, warc
from paperloom.llm.queries import QUERIES, SQL
from tests.conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def check_near(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(docs.collect())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates(spark, odd, none, monkeypatch):
    check_near(odd.where("doc_id is not null"))
    assert near_dedup.near_duplicates(odd).count() == odd.count() and near_dedup.near_duplicates(none).count() == 0
    # Families of copies with more and more changes; small limits, so that hot keys and several blocks occur.
    r = random.Random(3)
    rows = []
    for f in range(4):
        head = [f"f{f}w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            w = list(head)
            for _ in range(r.randrange(12)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(docs)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    keep = near_dedup.hot_keys
    monkeypatch.setattr(near_dedup, "hot_keys", lambda reps: keep(reps, 5))
    check_near(docs)


def test_rarest_shingles(spark, monkeypatch):
    # Short texts of few patterns, so that sets are small, links are near the limit, and cells have many documents.
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a b c d e f g h", "b c d e f g h i", "x"]).split()[: r.randrange(1, 9)] + [f"t{r.randrange(40)}"] * r.randrange(3))) for i in range(300)]
    rows += [(1000 + i, f"page not found on server x{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for many in (0, 30):
        monkeypatch.setattr(near_dedup, "MANY", many)
        keep = near_dedup.hot_keys
        with monkeypatch.context() as m:
            m.setattr(near_dedup, "hot_keys", lambda reps, keep=keep: keep(reps, 5))
            check_near(docs)
            m.setattr(near_dedup, "BLOCK_SHINGLES", 150)
            check_near(docs)


def test_join_path_of_hot_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    reps = near_dedup.signed(docs).where("sig is not null").select("doc_id", "sig", "n_shingles")
    hot = near_dedup.hot_keys(reps, 3)
    a, b = (sorted(map(tuple, near_dedup.postings(reps, hot, m).select("key", "is_hot", "doc_id").collect())) for m in (500_000, 0))
    assert a == b


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {row.node: row.component for row in components.components(df, few).collect()}
    assert all(got.get(n, n) == find(n) for n in root) and set(got) <= set(root)
    assert components.components(df.limit(0), few).count() == 0


def test_fm_index():
    r = np.random.default_rng(4)
    for sigma in (1, 2, 5, 300):
        text = r.integers(1, sigma + 1, 400)
        text[[0, 100, 399]] = 0
        index = fm_index.Index(text, np.arange(400))
        ends = np.arange(1, 401)
        length, lo, hi = fm_index.matching_statistics(index, text, ends, 13)
        for e in range(1, 401, 7):
            best = 0
            while best < 13 and e - best - 1 >= 0 and text[e - best - 1] > 0:
                best += 1
            assert length[e - 1] == best  # each pattern is in the text itself
            if best:
                p = text[e - best : e]
                at = [i for i in range(400 - best + 1) if (text[i : i + best] == p).all()]
                assert hi[e - 1] - lo[e - 1] == len(at) and index.least_owner(lo[e - 1 : e], hi[e - 1 : e])[0] == at[0]


def test_statistics_of_text_that_is_not_indexed():
    r = np.random.default_rng(8)
    held, text = r.integers(1, 30, 600), r.integers(1, 40, 300)
    text[50:75], held[::97] = held[110:135], 0
    index = fm_index.Index(held, np.arange(600) // 50, 13)
    length, lo, hi = fm_index.matching_statistics(index, text, np.arange(1, 301), 13)
    for e in range(1, 301):
        best, at = 0, []
        for k in range(1, 14):
            if e < k or (text[e - k : e] == 0).any():
                break
            found = [i for i in range(600 - k + 1) if (held[i : i + k] == text[e - k : e]).all()]
            if not found:
                break
            best, at = k, found
        assert length[e - 1] == best and (not best or hi[e - 1] - lo[e - 1] == len(at))
        if best:
            assert index.least_owner(lo[e - 1 : e], hi[e - 1 : e])[0] == at[0] // 50
    assert (length == 13).any() and (length < 3).any()


def removed(rows, n=13):
    seen, out = {}, []
    for r in rows:
        w = WORD.findall(r.text or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            seen[k] = min(seen.get(k, math.inf), r.doc_id)
    for r in rows:
        w = WORD.findall(r.text or "")
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] < r.doc_id for j in range(i, i + n)}
        out.append((r.doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(spark, odd, none, hot):
    r = random.Random(9)
    lines = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(10, 60))) for _ in range(12)]
    rows = [(i, " ".join(r.choice(lines) for _ in range(3))) for i in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (odd.where("doc_id is not null"), made):
        got = substring_dedup.drop_repeats(docs, hot=hot).collect()
        assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == removed(docs.collect())
    assert substring_dedup.drop_repeats(odd).count() == odd.count() and substring_dedup.drop_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup_of_two_texts_of_a_doc_id(spark, hot):
    import hashlib

    import duckdb

    w = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(w[60:90])), (2, " ".join(w)), (2, " ".join(["a", *w[:20]])), (2, " ".join(f"s{i}" for i in range(70))), (3, " ".join(w)), (4, " ".join(["b", *w[:20]])), (5, None)]
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    want = c.sql(f"select doc_id, n_words, kept_sha256 from ({substring_dedup.OP3_SQL})").fetchall()
    assert sorted((r.doc_id, r.n_words, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == sorted(want)
    assert all(r.n_words - r.n_removed == len(r.kept_text.split()) for r in got)


def test_top_k(spark):
    r = random.Random(2)
    vec = lambda: [r.uniform(-1, 1) for _ in range(7)]
    rows = [(i, vec()) for i in range(150)] + [(200 + i, [0.5] * 7) for i in range(60)] + [(400, None), (420, [1.0, None]), (440, [float("nan")] * 7), (460, [float("inf")] * 7), (None, [1.0] * 7), (480, [1.0, 2.0]), (500, [1e30] * 7)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, embedding array<double>, score string")
    v = {i: [math.floor(64 * c) for c in x] for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)}
    q = topk.quantized(df)
    got = {}
    for row in topk.top_k(q.where("vec_id % 20 = 0"), q).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    for i in [k for k in v if k % 20 == 0]:
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        best = sorted((-clip(sum(a * b for a, b in zip(v[i], v[j], strict=True))), j) for j in v if j != i and len(v[j]) == len(v[i]))[:20]
        if i != 500:
            assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert topk.top_k(q.limit(0), q).count() == 0


FAKE = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


def test_warc(spark):
    import base64
    import hashlib

    rows = [(1, "u", "a"), (2, None, "a"), (3, "v\r\nX: y", None), (4, "w", ""), (5, "z", FAKE), (6, "q", FAKE), (7, "é", "é€\U0001f600" * 3000), (8, "WARC/1.0\r\n", "WARC/1.0\r\n"), (9, "r", "\r\n\r\n"), (None, None, "b"), (10, "s", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    for files in (1, 3):
        got = warc.read_archives(spark, warc.write_archives(df.coalesce(files), per_archive=4)).collect()
        want = []
        for i, _, html in rows:
            same = [j for j, _, h in rows if (h or "") == (html or "")]
            top = max((j for j in same if j is not None), default=None)
            body = (html or "").encode()
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            want.append((i, len(body), digest, *(("response", None) if i == top else ("revisit", top))))
        assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    same_rows(got[list(want.columns)], want)


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[5] >= counts[4] > 0
    left = spark.read.parquet(str(tmp_path / "2"))
    assert near_dedup.near_duplicates(left).where("not kept").count() == 0
    run = cp.run(spark, sf_dir)
    assert run.columns == docs.columns and run.count() == counts[5]


def test_pipeline_keeps_one_of_large_groups_of_copies(spark, sf_dir):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sources = [r[0] for r in docs.select("source").distinct().orderBy("source").collect()]
    r = random.Random(6)
    text = lambda f: [[f"{f}{r.randrange(10**6)}" for _ in range(9)] for _ in range(20)]
    spelt = lambda lines: "\n".join(" ".join(x) for x in lines)
    exact, near = text("e"), text("n")
    rows = [(10**6 + i, spelt(exact)) for i in range(100)]
    for i in range(100):
        lines = [list(x) for x in near]
        lines[i % 20][4] = f"changed{i}"
        rows.append((2 * 10**6 + i, spelt(lines)))
    made = spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t)) for i, t in rows], docs.schema)
    # On every page of a source, and still boilerplate.
    made = docs.unionByName(made).withColumn("text", F.concat(F.lit("home | about | contact\n"), "text"))
    out = cp.drop_boilerplate_lines(spark, made, sf_dir)
    left = {x.doc_id: x.text for x in cp.drop_near_duplicates(spark, out, sf_dir).collect()}
    assert left[10**6] == spelt(exact) and left[2 * 10**6] == rows[100][1]
    assert not any(10**6 < i < 2 * 10**6 or i > 2 * 10**6 for i in left)
    assert not any("home | about | contact" in (t or "") for t in left.values())
