"""Connected components of a table of links, by alternating stars on Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, written

#: Links that one task connects.
FEW_LINKS = 200_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on (v, u) links with u < v: neighbours move to the least node of a neighbourhood.

    The least nodes are dealt anew before neighbours meet them: a join of two bare shuffles is one whose hot keys, the
    centres of large stars, Spark splits.
    """
    if large:  # of all neighbours, the larger ones move
        all_ = links.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(links.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = all_.groupBy("n").agg(F.least(F.min("x"), F.first("n")).alias("m")).hint("rebalance")
        moved = all_.where("x > n").join(least.hint("merge"), "n").select(F.col("m").alias("u"), F.col("x").alias("v"))
    else:  # of the smaller neighbours, all move, and the node itself
        least = links.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m")).hint("rebalance")
        moved = links.withColumnRenamed("v", "n").join(least.hint("merge"), "n")
        moved = moved.select(F.col("m").alias("u"), F.col("u").alias("v")).unionAll(least.select(F.col("m").alias("u"), F.col("n").alias("v")))
    return moved.where("u < v").groupBy("v", "u").agg(F.lit(1).alias("_")).select("v", "u")


def _in_one_task(links: DataFrame) -> DataFrame:
    """(node, component) of a few (v, u) links, by least numbers passed along links until none falls."""

    def connect(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        v, u = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        a, b = at[: len(v)], at[len(v) :]
        name = np.arange(len(nodes))
        while True:
            low = name.copy()
            np.minimum.at(low, a, name[b])
            np.minimum.at(low, b, name[a])
            low = low[low]
            if (low == name).all():
                break
            name = low
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[name])], names=["node", "component"])

    return links.coalesce(1).mapInArrow(connect, "node long, component long")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b; longs): the least node it is linked with, however far.

    Loops and repeated links change nothing; a link with a null end is none. Rounds grow with the
    logarithm of the nodes; each is a written table, and so is the result. Tables of rounds before are deleted.
    ``few`` links or less (16 bytes each) need no rounds: one task connects them, with the same result.
    """
    ends = links.where("a is not null and b is not null")
    now = ends.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now, before = written(now, "links"), None
    n = now.limit(few + 1).count()
    if 0 < n <= few:
        out = written(_in_one_task(now), "components")
        discard(now)
        return out
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == before or not mark[0]:
            break
        before, last = mark, now
        now = written(_star(_star(now, large=True), large=False), "links")
        discard(last)
    # Stars around the least nodes.
    leaves = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    out = written(leaves.unionAll(now.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))), "components")
    discard(now)
    return out
