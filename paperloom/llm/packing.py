"""Packing documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared
lengths). Pieces are placed in decreasing length; of the open sequences with room in every
capacity, the one with the smallest weighted norm of what is left, or the largest weighted dot
product of piece and room, takes the piece. Pieces are dealt into groups of bounded size, which are
packed apart from each other; each group leaves about one sequence part empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import fresh, table, written
from paperloom.llm.tokens import KEPT_PARTS, vocabulary

MAX_TOKENS = 4096
END = 1
GROUP = 8192
#: Documents whose tokens a task holds at a time.
SLICE = 512
#: Weights of tokens, documents and attention cost in the choice.
WEIGHTS = (1.0, 1e-6, 1e-3)


def pieces(docs: DataFrame, vocabulary_path: str, end: int = END, max_tokens: int = MAX_TOKENS, with_ids: bool = False, keep: int = KEPT_PARTS) -> DataFrame:
    """``doc_id, row_no, piece, start, length, ids_crc32`` (and ``ids``) of every row's tokens with the end id.

    Null text counts as empty: one piece with the end id alone. ``row_no`` tells repeated rows apart
    within a task's rows; rows with a null ``doc_id`` are pieces like any other. ``keep`` bounds a worker's memory.
    """
    schema = "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        v, row = vocabulary(vocabulary_path, keep), 0
        tail = np.array([end], v.dtype).tobytes()
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            out = {k: [] for k in ("doc_id", "row_no", "piece", "start", "length", "ids_crc32")}
            kept = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(v.encode(text.as_py() or "") + tail, v.dtype).astype("<u4")
                for k, a in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[a : a + max_tokens]
                    for name, x in (("doc_id", doc_id), ("row_no", row), ("piece", k), ("start", a), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        out[name].append(x)
                    if with_ids:
                        kept.append(part.astype(np.int32))
                row += 1
            made = {k: pa.array(x, pa.int32() if k == "piece" else pa.int64()) for k, x in out.items()}
            if with_ids:
                made["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(made)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights=WEIGHTS, choose: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` must fall, none above ``max_tokens``.

    A piece whose square is above ``max_cost`` gets a sequence of its own. Ties: the sequence opened first.
    """
    full = np.array([max_tokens, max_docs, max_cost], float)
    w = np.asarray(weights, float)
    room = np.empty((3, 256))
    name = np.empty(256, np.int64)
    n_open = opened = 0
    least = int(lengths[-1]) if len(lengths) else 0
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1, float(size) * size])
        have = room[:, :n_open]
        fits = np.flatnonzero((have[0] >= size) & (have[1] >= 1) & (have[2] >= need[2]))
        if len(fits):
            rest = (have[:, fits] - need[:, None]) / full[:, None]
            if choose == "norm":
                k = int(fits[np.argmin(w @ (rest * rest))])
            else:
                k = int(fits[np.argmax((w * need / full) @ (have[:, fits] / full[:, None]))])
        else:
            if n_open == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([name, np.empty_like(name)])
            k, n_open = n_open, n_open + 1
            room[:, k], name[k] = full, opened
            opened += 1
        seq[i], off[i] = name[k], max_tokens - room[0, k]
        room[:, k] -= need
        if room[0, k] < least or room[1, k] < 1 or room[2, k] < least * least:  # nothing fits any more
            n_open -= 1
            room[:, k:n_open], name[k:n_open] = room[:, k + 1 : n_open + 1].copy(), name[k + 1 : n_open + 1].copy()
    return seq, off


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_TOKENS, max_cost: float = float(MAX_TOKENS) ** 2, weights=WEIGHTS, choose: str = "norm", group: int = GROUP) -> DataFrame:
    """``cut`` (the columns of ``pieces``, others stay) with ``sequence_id`` and ``offset``.

    Every piece is in one sequence, gapless from offset 0, within all three capacities.
    """
    at, dealt = fresh(cut, "at"), fresh(cut, "dealt")
    cut = written(cut.withColumn(at, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group))
    keys = cut.select(at, "doc_id", "row_no", "piece", "length", F.pmod(F.xxhash64("doc_id", "row_no", "piece"), F.lit(groups)).alias(dealt))

    def place(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row_no", "ascending")])
        seq, off = best_fit(batch["length"].to_numpy(), max_tokens, max_docs, max_cost, weights, choose)
        first = batch[dealt][0].as_py() << 32
        return pa.Table.from_arrays([batch[at], pa.array(first + seq), pa.array(off)], names=[at, "sequence_id", "offset"])

    # Only keys and lengths go to Python; the tokens meet their places by the number their table gave them.
    placed = keys.groupBy(dealt).applyInArrow(place, f"`{at}` long, sequence_id long, offset long")
    return cut.join(placed.hint("merge"), at).drop(at)


def op9_pack_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
