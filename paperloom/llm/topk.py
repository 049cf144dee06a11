"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; each has a mean and a deviation. For two vectors, the sum over
segments of length * (mean * mean + deviation * deviation) is no less than their inner product, so
its negative is a lower bound of the distance that ranks here. Bounds go from coarse to fine
segments; what no bound rules out is computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import table, written

K = 20
SCALE = 64.0
#: Vectors and queries of a block: a cell of the search holds one block of each.
ROWS, QUERIES = 8192, 2048
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16, 32)
#: Rows with the best of the finest bounds, whose distances are computed first: the k-th best of them is what others must reach.
FIRST = 256
#: Queries whose bounds are held at a time.
HELD = 128


def quantized(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id, dim, v``: floor(scale * x) of each component as a double.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & F.col("vec_id").isNotNull()).where(whole)
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that a product of two rows is the bound."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    out = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts] + [p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack(out, axis=1)


def search(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int = K, levels=LEVELS):
    """(place in q, place in v, score) of each query's k best rows of v; ties to the smaller id; never its own id.

    Products beyond 2**52 are computed with integers of any size, without bounds; scores that no long holds are the nearest long.
    """
    order = np.argsort(v_ids, kind="stable")
    v, v_ids = v[order], v_ids[order]
    most = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0))
    exact = most * most * max(1, q.shape[1]) < 2**52
    if not exact:  # integers of any size, and no bounds
        q, v, levels = q.astype(object), v.astype(object), ()
        q, v = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(v)
    if not q.shape[1]:
        levels = ()
    stats = [(statistics(q, m), statistics(v, m)) for m in levels]
    few = len(v) <= max(FIRST, 4 * k)
    for i in range(len(q)):
        others = v_ids != q_ids[i]
        if stats and not few:
            if i % HELD == 0:
                bounds = [qs[i : i + HELD] @ vs.T + 0.5 for qs, vs in stats]
            own = [b[i % HELD] for b in bounds]
            first = np.argpartition(-np.where(others, own[-1], -np.inf), FIRST)[:FIRST]
            first = first[others[first]]
            least = np.partition(v[first] @ q[i], -k)[-k] if len(first) >= k else -np.inf
            left = np.flatnonzero(others & (own[0] >= least))
            for bound in own[1:]:
                left = left[bound[left] >= least]
        else:
            left = np.flatnonzero(others)
        scores = v[left] @ q[i]
        if not exact:
            scores = np.clip(scores, -(2**63), 2**63 - 1)
        best = np.argsort(-scores, kind="stable")[:k]  # left is in order of id
        for j in best:
            yield i, order[left[j]], int(scores[j])


OUT = pa.schema([("query_id", pa.int64()), ("block", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def matrix(t: pa.Table, id_: str, v: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t[id_].to_numpy()
    flat = t[v].combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
    return ids, flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0))


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest integer inner products over all ``rows``.

    Both tables are as ``quantized`` returns them. Vectors of different length do not meet. Ties go to
    the smaller vec_id; rows with the query's vec_id are its own; repeated rows count each.
    The stated queries meet all rows in blocks: cells of one query block and one row block, of fixed
    size, whose best are merged.
    """
    n_rows = max(1, -(-rows.count() // ROWS))
    n_queries = max(1, -(-queries.count() // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("dim").alias("q_dim"), F.col("v").alias("q"), block(n_queries).alias("q_of"), every(n_rows).alias("q_block"))
    v = rows.select("vec_id", F.col("dim").alias("v_dim"), "v", block(n_rows).alias("v_block"), every(n_queries).alias("v_of"))

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return OUT.empty_table()
        q_ids, a = matrix(left, "query_id", "q")
        v_ids, b = matrix(right, "vec_id", "v")
        found = list(search(a, q_ids, b, v_ids, k))
        i, j, s = ([x[n] for x in found] for n in range(3))
        return pa.Table.from_arrays([pa.array(q_ids[i], pa.int64()), pa.array([key[1].as_py()] * len(i), pa.int64()), pa.array(v_ids[j], pa.int64()), pa.array(s, pa.int64())] if found else [pa.array([], pa.int64())] * 4, schema=OUT)

    best = q.groupBy("q_dim", "q_block", "q_of").cogroup(v.groupBy("v_dim", "v_block", "v_of")).applyInArrow(cell, "query_id long, block long, vec_id long, score long")
    order = [F.desc("score"), "vec_id"]
    if n_rows > 64:  # merge in two steps
        best = best.withColumn("some", F.expr("block div 64"))
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "some").orderBy(*order))).where(F.col("r") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    rows = written(quantized(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows.where("vec_id % 20 = 0"), rows)


OP5_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({int(SCALE)} * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= {K}
"""
