"""Each stage of the pipeline against a plain version on its own input, and the choice of the packing."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from paperloom.llm import language, line_dedup, mixing, packing
from tests.llm.test_search import groups



@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows that go into each stage, and those that come out of the last."""
    docs, out, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(docs)
        stage(spark, docs, sf_dir).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
    return [*out, docs]


def test_language_stage(stages):
    docs = stages[0]
    names, p = language.fit(docs.select("text", "lang"))
    kept = set()
    for r in docs.collect():
        place = language.places(r.text)
        if not any(c.isalpha() for c in r.text or ""):
            continue
        where, count = np.unique(place, return_counts=True)
        shares = language.infer(p, where, count, np.array([0]))[0]
        own = shares[: len(names)]
        if own.sum() >= cp.MIN_SCORE and own.max() >= cp.MIN_SHARE * own.sum():
            kept.add(r.doc_id)
    assert {r.doc_id for r in stages[1].collect()} == kept


def test_line_stage(stages):
    rows = stages[1].collect()
    family = {i: c for i, _, c in groups(rows)}
    pages, holding = defaultdict(set), defaultdict(set)
    trimmed = lambda line: line.strip(" \t\r")
    for r in rows:
        pages[r.source].add(family[r.doc_id])
        for line in {trimmed(x) for x in r.text.split("\n")} - {""}:
            holding[r.source, line].add(family[r.doc_id])
    boiler = {k for k, v in holding.items() if len(v) >= line_dedup.MIN_PAGES and len(v) / len(pages[k[0]]) > line_dedup.MAX_RATIO}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, trimmed(x)) not in boiler) for r in rows}
    assert {r.doc_id: r.text for r in stages[2].collect()} == want and boiler


def test_near_duplicates_stage(stages):
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i, _, c in groups(stages[2].collect()) if i == c)


def test_mixing_stage(stages, duck):
    rows = stages[3].toPandas()
    duck.register("kept", rows)
    taken = duck.sql(mixing.OP8_SQL.replace("from documents", "from kept")).df()
    times = {int(i): int(np.floor(t / n + 0.5)) for i, n, t in zip(taken["doc_id"], taken["size"], taken["taken"], strict=True) if n}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({i: n for i, n in times.items() if n})


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for r in stages[4].collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END]
        want.update((r.doc_id, k, tuple(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096)))
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 4096
    total = sum(r.length for r in rows)
    assert len(held) <= 1.1 * total / 4096 + 2


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_choice_of_a_sequence(seed, choose):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.integers(1, 60, 150))[::-1]
    full, weights = (100, 5, 4500.0), (1.0, 0.3, 0.5)
    open_, want = [], []
    for n in lengths.tolist():
        need = (n, 1, float(n * n))
        rate = {
            "norm": lambda room, need=need: -sum(w * ((a - b) / f) ** 2 for w, a, b, f in zip(weights, room, need, full, strict=True)),
            "dot": lambda room, need=need: sum(w * b / f * a / f for w, a, b, f in zip(weights, room, need, full, strict=True)),
        }[choose]
        fits = [k for k, room in enumerate(open_) if all(a >= b for a, b in zip(room, need, strict=True))]
        best = max(fits, key=lambda k: (round(rate(open_[k]), 12), -k)) if fits else len(open_)
        if not fits:
            open_.append(full)
        want.append((best, full[0] - open_[best][0]))
        open_[best] = tuple(a - b for a, b in zip(open_[best], need, strict=True))
    seq, off = packing.best_fit(lengths, *full, weights=weights, choose=choose)
    assert list(zip(seq.tolist(), off.tolist(), strict=True)) == want
    assert len(open_) >= -(-int(lengths.sum()) // 100)
