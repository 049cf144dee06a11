"""Tokenizing, token files, packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import ans, packing, token_files
from paperloom.llm.tokens import Vocabulary

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "a  b", "x\ny z", "don't we're 'S", "ÉCOLE İ ΣΑΣ", "é", "<|endoftext|> a<|endoftext|>b", "a\tb\r\nc", "1a x_y ² \x1c q", "日本 語", "　x", " lead", "trail ", "a.\nB,\n\nC"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encode_equals_library(path):
    v, whole = Vocabulary(path), Tokenizer.from_file(path)
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("aB éÉ.,'s\n\t 1²_Σİ<|>́\x1c ") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    for t in texts * 2:
        assert np.frombuffer(v.encode(t), v.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300), st.integers(1, 5))
def test_range_coder_round_trip(ids, repeat):
    tokens = np.array(ids * repeat, np.uint32)
    f = ans.File(ans.encode_file([1, None], [len(tokens), 0], tokens))
    assert (f.tokens() == tokens).all() and f.doc_ids == [1, None] and f.counts.tolist() == [len(tokens), 0]


def test_range_coder_blocks_checkpoints_and_damage():
    tokens = np.random.default_rng(1).zipf(1.3, ans.BLOCK_TOKENS + 70_000).clip(0, 50_000).astype(np.uint32)
    data = ans.encode_file([1], [len(tokens)], tokens)
    f = ans.File(data)
    assert (f.block(1) == tokens[ans.BLOCK_TOKENS :]).all()  # alone
    block = f.data[f.at[0] : f.at[1]]
    parts = [ans.decode_block(block, ans.BLOCK_TOKENS, f.freq, f.bias, f.symbol, k, k + 1) for k in range(2)]
    assert (np.concatenate(parts) == tokens[: ans.BLOCK_TOKENS]).all()  # from each checkpoint
    bad = bytearray(data)
    bad[f.at[0] + 1000] ^= 1
    with pytest.raises(ValueError):
        ans.File(bytes(bad)).tokens()


def expected(rows, path, end):
    t = Tokenizer.from_file(path)
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, none):
    want = sorted(expected(odd.collect(), BYTE, 2), key=lambda x: (x[0] is not None, x[0] or 0))
    got = token_files.read_files(token_files.write_files(odd, BYTE, file_tokens=2000), with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in got] == want
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [(sum(len(w[1]) for w in want[:k]), len(w[1]), crc(w[1])) for k, w in enumerate(want)]
    assert token_files.read_files(token_files.write_files(none, BYTE)).count() == 0


def test_packing(spark, odd, none):
    want = sorted((str(i), a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for i, ids in expected(odd.collect(), WORD, 1) for a in range(0, len(ids), 4096))
    got = packing.pack(packing.pieces(odd, WORD, with_ids=True)).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(crc(r.ids) == r.ids_crc32 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
    assert packing.pack(packing.pieces(none, WORD)).count() == 0


def test_tokens_stay_with_their_piece(spark, odd):
    cut = packing.pieces(odd, WORD, with_ids=True).withColumn("_at", F.lit("a")).withColumn("_dealt", F.lit("d"))
    got = packing.pack(cut).collect()  # one group
    assert all(crc(r.ids) == r.ids_crc32 and (r["_at"], r["_dealt"]) == ("a", "d") for r in got)
    lengths = np.array(sorted((r.length for r in got), reverse=True))
    seq, off = packing.best_fit(lengths, 4096, 4096, 4096.0**2)
    assert sorted((r.length, r.sequence_id, r.offset) for r in got) == sorted(zip(lengths.tolist(), seq.tolist(), off.tolist(), strict=True))


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(choose):
    r = np.random.default_rng(2)
    lengths = np.sort(r.integers(1, 100, 500))[::-1]
    seq, off = packing.best_fit(lengths, 100, 4, 5000.0, choose=choose)
    for s in np.unique(seq):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 4 and ((own.astype(float) ** 2).sum() <= 5000 or len(own) == 1)
        assert sorted(off[seq == s].tolist()) == sorted(np.concatenate([[0], np.cumsum(own[np.argsort(off[seq == s])])[:-1]]).tolist())
