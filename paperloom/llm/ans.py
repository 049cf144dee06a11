"""Static range asymmetric numeral coding of token ids.

File format, one file for a run of documents in ascending order (numbers little-endian)::

    magic 4 bytes | header length uint32 | header (JSON, zlib)
    document ids int64[n_docs] | their null marks uint8[n_docs] | their token counts uint32[n_docs]
    shared frequency table: ids uint32[n] and frequencies uint32[n], zlib
    blocks, one after the other

The header lists each section's length and, for each block, its first token, token count, length and
the CRC-32 of its bytes and of its tokens. The table is shared by all blocks of the file; a block is
coded with ``LANES`` interleaved states and decodes on its own. In a block stand: checkpoints (the states
and the stream position before every ``STRIDE``-th step, so a reader can start there) and the stream of
32-bit words.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"PLA1"
SCALE = 18
TOTAL = 1 << SCALE
LOW = np.uint64(1 << 32)
LANES = 4096
STRIDE = 64
BLOCK_TOKENS = 1 << 19
U32 = np.uint64(32)


def table_of(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**18, at least 1 for each id that occurs. At most 2**17 different ids may occur."""
    used = np.flatnonzero(counts)
    freq = np.zeros(len(counts) + (len(used) == 1 and used[0] == len(counts) - 1), np.int64)
    if not len(used):
        return freq
    if len(used) > TOTAL // 2:
        raise ValueError(f"more than {TOTAL // 2} different ids")
    freq[used] = np.maximum(1, counts[used] * TOTAL // counts.sum())
    over = int(freq.sum()) - TOTAL
    order = used[np.argsort(-freq[used], kind="stable")]
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # ids rounded up to 1: the frequent ones give way, in turn
        for k in order:
            if over and freq[k] > 1:
                cut = min(over, max(1, int(freq[k] - 1) // 8))
                freq[k] -= cut
                over -= cut
    if len(used) == 1:  # a state needs a frequency below the total
        freq[used[0]] -= 1
        freq[0 if used[0] else 1] += 1
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    steps = -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words, marks = [], []
    fs, cs = freq[ids], cum[ids]
    limits = fs << np.uint64(64 - SCALE)
    spare = np.uint64(TOTAL) - fs
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min((t + 1) * LANES, len(ids))
        y = x[: b - a]
        full = np.flatnonzero(y >= limits[a:b])
        over = y[full]
        words.append(over.astype("<u4"))
        y[full] = over >> U32
        # (y div f) * 2**18 + y mod f + c, as y + (y div f) * (2**18 - f) + c
        y += (y // fs[a:b]) * spare[a:b] + cs[a:b]
        if t % STRIDE == 0:
            marks.append((t, len(words), x.copy()))
    words.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    points = b"".join(struct.pack("<II", t, int(at[len(words) - k])) + v.astype("<u8").tobytes() for t, k, v in reversed([(t, k, v) for t, k, v in marks]))
    # After k steps from the end, the words of the steps before come first: position at[steps - k].
    return struct.pack("<II", steps, len(marks)) + points + b"".join(w.tobytes() for w in words)


def decode_block(data: bytes, n: int, freq: np.ndarray, bias: np.ndarray, symbol: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens of a block, or of its part from checkpoint ``start`` up to checkpoint ``stop``.

    ``freq``, ``bias`` (place less the start of its id) and ``symbol`` are tables by place in the range 2**18.
    """
    steps, n_marks = struct.unpack_from("<II", data)
    size = 8 + 8 * LANES
    stop = n_marks if stop is None else stop
    if start >= stop:
        return np.zeros(0, np.uint32)
    t0, at = struct.unpack_from("<II", data, 8 + start * size)
    t1 = steps if stop >= n_marks else struct.unpack_from("<I", data, 8 + stop * size)[0]
    x = np.frombuffer(data, "<u8", LANES, 8 + start * size + 8).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", offset=8 + n_marks * size).astype(np.uint64)
    out = np.empty(min(n, t1 * LANES) - t0 * LANES, np.uint32)
    mask = np.uint64(TOTAL - 1)
    for t in range(t0, t1):
        k = min(LANES, n - t * LANES)
        slot = (x[:k] & mask).astype(np.int64)
        out[(t - t0) * LANES : (t - t0) * LANES + k] = symbol[slot]
        y = freq[slot] * (x[:k] >> np.uint64(SCALE)) + bias[slot]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << U32) | stream[at : at + len(low)]
        at += len(low)
        x[:k] = y
    return out


def _spread(ids: np.ndarray, freqs: np.ndarray):
    n = int(ids.max()) + 1 if len(ids) else 1
    freq = np.zeros(n, np.uint64)
    freq[ids] = freqs
    return freq, np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)


def encode_file(doc_ids: list, counts: list[int], tokens: np.ndarray) -> bytes:
    """A file of documents: their ids (ints or None), token counts and all their tokens in a row."""
    raw = table_of(np.bincount(tokens, minlength=2)) if len(tokens) else np.zeros(2, np.int64)
    used = np.flatnonzero(raw)
    freq, cum = _spread(used, raw[used])
    blocks, notes = [], []
    for a in range(0, len(tokens), BLOCK_TOKENS):
        part = tokens[a : a + BLOCK_TOKENS]
        data = encode_block(part, freq, cum)
        blocks.append(data)
        notes.append([a, len(part), len(data), zlib.crc32(data), zlib.crc32(part.astype("<u4").tobytes())])
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(counts, "<u4").tobytes()
    table = zlib.compress(used.astype("<u4").tobytes() + raw[used].astype("<u4").tobytes())
    header = zlib.compress(json.dumps({"docs": len(doc_ids), "tokens": len(tokens), "symbols": len(used), "table": len(table), "docs_crc": zlib.crc32(docs), "table_crc": zlib.crc32(table), "blocks": notes}).encode())
    return MAGIC + struct.pack("<I", len(header)) + header + docs + table + b"".join(blocks)


class File:
    """Reads a file; every part is checked against its checksum before it is used."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<I", data, 4)
        self.head = json.loads(zlib.decompress(data[8 : 8 + n]))
        at, k = 8 + n, self.head["docs"]
        docs = data[at : at + 13 * k]
        table = data[at + 13 * k : at + 13 * k + self.head["table"]]
        if zlib.crc32(docs) != self.head["docs_crc"] or zlib.crc32(table) != self.head["table_crc"]:
            raise ValueError("checksum of the index or the table differs")
        ids, null = np.frombuffer(docs, "<i8", k), np.frombuffer(docs, np.uint8, k, 8 * k)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(docs, "<u4", k, 9 * k).astype(np.int64)
        m = self.head["symbols"]
        table = np.frombuffer(zlib.decompress(table), "<u4")
        freq, cum = _spread(table[:m].astype(np.int64), table[m:])
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.freq = freq[self.symbol]
        self.bias = np.arange(len(self.symbol), dtype=np.uint64) - cum[self.symbol]
        at += 13 * k + self.head["table"]
        self.data, self.at = data, [at]
        for note in self.head["blocks"]:
            self.at.append(self.at[-1] + note[2])

    def block(self, k: int) -> np.ndarray:
        """Tokens of block k alone."""
        _, n, _, crc, tokens_crc = self.head["blocks"][k]
        data = self.data[self.at[k] : self.at[k + 1]]
        if zlib.crc32(data) != crc:
            raise ValueError(f"checksum of block {k} differs")
        out = decode_block(data, n, self.freq, self.bias, self.symbol)
        if zlib.crc32(out.astype("<u4").tobytes()) != tokens_crc:
            raise ValueError(f"tokens of block {k} differ")
        return out

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.head["blocks"]))] or [np.zeros(0, np.uint32)])
