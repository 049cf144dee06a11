"""Near-duplicates by a MinHash signature-coordinate inverted join.

1. Documents with the same shingle set are one class, represented by its smallest doc_id.
2. A representative's signature has ``COORDINATES`` minima; each coordinate-value pair is a key under
   which it could be posted. Pairs of documents above the similarity agree in ``MATCHES`` of
   them (less often with a chance below 1e-5), so it is posted under its first
   ``COORDINATES - MATCHES + 1`` keys only: prefix merging, rare keys before hot ones.
3. Lists of rare keys are merged in sorted order: signatures that agree in ``MATCHES`` places
   are joined to one cluster, pairs already joined are skipped. A hot list (a key of more than
   ``HOT`` documents) is not merged at all: who is posted there is one cluster as a whole.
4. Within clusters, links are confirmed on the full shingle sets, in cells of bounded size; pairs that are already
   connected are skipped, so a cell returns a spanning forest. First each block of a cluster in itself, then some
   documents of each block's largest group against those of the first block, then all blocks against the documents
   outside the cluster's largest group. A large group of near copies costs its size thrice, not its square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, give_back, joined_small, partitions, rested, table, written
from paperloom.llm.components import components
from paperloom.llm.wordhash import mixed, shingle_set

WORDS = 5
#: Similarity, as intersection * 100 >= PERCENT * union.
PERCENT = 75
COORDINATES = 32
MATCHES = 12
HOT = 256
#: Shingles of a block on average; a cell holds two blocks.
BLOCK_SHINGLES = 150_000
#: Documents of a cell above which they meet by their rarest shingles only.
MANY = 1000
#: Rows of a written table that may be broadcast, at most 40 bytes each.
FEW = 60_000

_KEYS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mixed(_KEYS) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES hashes, as 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        x = (shingles[a : a + 4096, None] ^ _KEYS) * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_hash, sig`` of each row; an empty set has null for the last two."""
    kind = "doc_id long, n_shingles long, set_hash binary, sig binary"

    @rested
    def sign(batches):
        for batch in batches:
            n, sets, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), WORDS)
                n.append(len(s))
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select("doc_id", "text").mapInArrow(sign, kind)


def tokens(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each coordinate and value of a (documents x COORDINATES) array."""
    return mixed((np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)) | sigs.astype(np.uint64)).view(np.int64)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def hot_keys(reps: DataFrame, hot: int = HOT) -> DataFrame:
    """Keys of more than ``hot`` representatives; at most COORDINATES / hot times as many as those."""

    @rested
    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tokens(_sigs(batch.column(0))).ravel())], names=["key"])

    found = reps.select("sig").mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return written(found.where(F.col("n") > hot).select("key"), "hot-keys")


def low_bytes(sig: Column) -> Column:
    """The low byte of each coordinate: what lists compare. Different values look alike with a chance of 1/256, which only adds candidates."""
    return F.concat(*[F.substring(sig, 4 * k + 1, 1) for k in range(COORDINATES)])


def postings(reps: DataFrame, hot: DataFrame, most_hot: int = 500_000) -> DataFrame:
    """``key, is_hot, doc_id, low`` under the prefix of each representative; ``low`` is a byte a coordinate."""
    prefix = COORDINATES - MATCHES + 1
    if hot.limit(most_hot + 1).count() <= most_hot:
        known = reps.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot.collect()], np.int64)))  # 4 MB at most

        @rested
        def post(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                sigs = _sigs(batch.column(1))
                keys = tokens(sigs)
                warm = np.isin(keys, known.value)
                first = np.argsort(warm, axis=1, kind="stable")[:, :prefix]
                rows = np.repeat(np.arange(len(keys)), prefix)
                at = first.ravel()
                low = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(rows), [None, pa.py_buffer(sigs.astype(np.uint8)[rows].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows, at]), pa.array(warm[rows, at]), batch.column(0).take(pa.array(rows)), low], names=["key", "is_hot", "doc_id", "low"])

        return reps.select("doc_id", "sig").mapInArrow(post, "key long, is_hot boolean, doc_id long, low binary")

    @rested
    def every(batches):
        for batch in batches:
            if batch.num_rows:
                rows = pa.array(np.repeat(np.arange(batch.num_rows), COORDINATES))
                yield pa.RecordBatch.from_arrays([pa.array(tokens(_sigs(batch.column(1))).ravel()), batch.column(0).take(rows), pa.array(np.tile(np.arange(COORDINATES, dtype=np.int32), batch.num_rows))], names=["key", "doc_id", "at"])

    all_ = reps.select("doc_id", "sig").mapInArrow(every, "key long, doc_id long, at int")
    marked = all_.join(hot.withColumn("is_hot", F.lit(True)).hint("merge"), "key", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    own = marked.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("is_hot", "at", "key"))), 1, prefix).alias("keys"))
    return own.join(reps.select("doc_id", low_bytes(F.col("sig")).alias("low")).hint("merge"), "doc_id").select(F.explode("keys").alias("k"), "doc_id", "low").select("k.key", "k.is_hot", "doc_id", "low")


def merged(rare: DataFrame) -> DataFrame:
    """Links (a, b) between documents of a list that agree in MATCHES coordinates: a forest of each list."""

    @rested
    def merge(batches):
        held = None

        def links(t: pa.Table):
            key = t["key"].to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            many = (stop - start) > 1
            if not many.any():
                return
            ids, sigs = t["doc_id"].to_numpy(), np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            out = []
            for a, b in zip(start[many].tolist(), stop[many].tolist(), strict=True):
                s = sigs[a:b]
                if b - a == 2:
                    if ids[a] != ids[a + 1] and (s[0] == s[1]).sum() >= MATCHES:
                        out.append((ids[a], ids[a + 1]))
                    continue
                root = np.arange(b - a)
                for i in range(b - a - 1):
                    rest = np.flatnonzero(root != root[i])
                    rest = rest[rest > i]
                    if len(rest):
                        near = rest[(s[rest] == s[i]).sum(axis=1) >= MATCHES]
                        for j in near:
                            if root[j] != root[i]:
                                out.append((ids[a + i], ids[a + j]))
                                root[root == root[j]] = root[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = t["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            yield from links(t.slice(0, whole)) if whole else ()
            held = t.slice(whole)
        if held is not None:
            yield from links(held)

    width = partitions(rare.sparkSession)
    dealt = rare.select("key", "doc_id", "low").repartition(width, "key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(merge, "a long, b long")


def by_rarest(flat: np.ndarray, start: np.ndarray, size: np.ndarray):
    """A function from a document of a cell to those that can be similar to it, from the cell's numbered shingles.

    Similar sets have one of their rarest shingles in common: so many that without them too few are left. Where the first of these
    stands in both also bounds what they can have in common. No similar document is missed.
    """
    count = np.bincount(flat)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((rank[flat], of))
    place = np.arange(len(flat)) - np.repeat(start, size)
    first = place < np.repeat(size - -(-size * PERCENT // 100) + 1, size)
    key, doc, at = rank[flat[order]][first], of[first], place[first]
    own = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))])
    by_key = np.argsort(key, kind="stable")
    lists = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(count)))])
    doc_of, at_of = doc[by_key], at[by_key]

    def near(i: int) -> np.ndarray:
        mine = key[own[i] : own[i + 1]]
        low, high = lists[mine], lists[mine + 1]
        if (high - low).sum() == len(mine):
            return np.zeros(0, np.int64)
        rows = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if b - a > 1])
        here = np.repeat(np.arange(len(mine)), np.where(high - low > 1, high - low, 0))
        other, head = np.unique(doc_of[rows], return_index=True)  # the first place of each
        most = 1 + np.minimum(size[i] - here[head] - 1, size[other] - at_of[rows[head]] - 1)
        return other[most * (100 + PERCENT) >= PERCENT * (size[i] + size[other])]

    return near


def confirmed(texts: DataFrame) -> DataFrame:
    """Links (a, b) confirmed on full sets, from ``cluster, x, y, side, known, doc_id, text`` rows.

    A cell (cluster, x, y) compares its documents with side true with those with side false, or, where side is null,
    all with each other. Documents that are ``known`` to be connected have the same number there and are not compared.
    With sides the links are pairs of such numbers; without, each document of a group of two or more and the group's least one.
    """

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        ids = t["doc_id"].to_numpy()
        sets = [shingle_set(x.as_py(), WORDS) for x in t["text"]]
        t = t.drop_columns(["text"])
        size = np.array([len(s) for s in sets])
        numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark, flat = np.zeros(len(numbers), np.int32), flat.astype(np.int32)
        del sets, numbers
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        two = t["side"].null_count == 0
        side = t["side"].to_numpy() if two else None
        known = t["known"].to_numpy()
        _, root = np.unique(known, return_inverse=True)
        out = []
        candidates = by_rarest(flat, start, size) if len(ids) > MANY else None
        for i in np.flatnonzero(side) if two else range(len(ids)):
            if candidates:
                rest = candidates(i)
                rest = rest[(~side[rest] if two else rest > i) & (root[rest] != root[i])]
                if len(rest):
                    mine = flat[start[i] : start[i] + size[i]]
                    mark[mine] = 1
                    for j in rest:
                        both = int(mark[flat[start[j] : start[j] + size[j]]].sum())
                        if root[j] != root[i] and 100 * both >= PERCENT * (size[j] + size[i] - both):
                            out.append((known[i], known[j]))
                            root[root == root[j]] = root[i]
                    mark[mine] = 0
                continue
            other = root != root[i]
            other &= ~side if two else np.arange(len(ids)) > i
            other &= 100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])
            rest = np.flatnonzero(other)
            if not len(rest):
                continue
            mine = flat[start[i] : start[i] + size[i]]
            mark[mine] = 1
            if len(rest) * 4 < len(ids):
                both = np.array([mark[flat[start[j] : start[j] + size[j]]].sum() for j in rest])
            else:
                both = np.add.reduceat(mark[flat], start)[rest]
            mark[mine] = 0
            for j in rest[100 * both >= PERCENT * (size[rest] + size[i] - both)]:
                if root[j] != root[i]:
                    out.append((known[i], known[j]))
                    root[root == root[j]] = root[i]
        if not two:
            least = np.full(int(root.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids)
            grouped = np.bincount(root)[root] > 1
            out = sorted(set(zip(ids[grouped].tolist(), least[root[grouped]].tolist(), strict=True)))
        if len(flat) >= BLOCK_SHINGLES // 2:
            del flat, mark
            give_back()
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return texts.groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long")


def blocked(members: DataFrame, out: str, of: str) -> DataFrame:
    """``members`` (cluster, doc_id, n_shingles) with ``of``, the number of the cluster's blocks, and ``out``, the document's own one."""
    size = written(members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias(of)), "cluster-sizes")
    met = written(joined_small(members, size, ["cluster"], "inner", FEW).withColumn(out, F.expr(f"cast(pmod(xxhash64(doc_id), {of}) as int)")), "blocks")
    discard(size)
    return met


def linked_in_clusters(read: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component) by confirmed links of ``members`` (cluster, doc_id, n_shingles), whose texts are in ``read`` (doc_id, text)."""
    pick = lambda x, y, side: [F.col("cluster"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.alias("side"), "known", "doc_id"]
    none, yes, no = F.lit(None).cast("boolean"), F.lit(True), F.lit(False)

    def links(cells: DataFrame) -> DataFrame:
        cells = written(cells, "cells")
        found = written(confirmed(joined_small(read, cells, ["doc_id"], "inner", FEW)), "links")
        discard(cells)
        return found

    def moved(many: DataFrame, to: DataFrame) -> DataFrame:
        """``many`` with the groups in ``to`` (known, moved) under their new number."""
        met = joined_small(many, to, ["known"], "left", FEW).withColumn("known", F.coalesce("moved", "known")).drop("moved")
        return written(met, "moved")

    # Each block in itself. A group within a block is named by its least document.
    blocks = blocked(members, "own", "blocks")
    inside = links(blocks.withColumn("known", F.col("doc_id")).select(*pick(F.col("own"), F.col("own"), none)))
    if not blocks.where("blocks > 1").limit(1).count():
        discard(blocks)
        out = inside.select(F.col("a").alias("node"), F.col("b").alias("component"))
        out.written_to = inside.written_to
        return out
    placed = written(blocks.join(inside.hint("merge"), blocks["doc_id"] == inside["a"], "left").drop("a").withColumnRenamed("b", "component"), "placed")
    discard(blocks, inside)
    many = placed.where("blocks > 1").withColumn("known", F.coalesce("component", "doc_id")).drop("component")
    # Clusters of several blocks: some documents of each block's largest group against those of the first block's.
    groups = many.groupBy("cluster", "own", "known").agg(F.count(F.lit(1)).alias("n"), F.array(F.min("doc_id"), F.max("doc_id"), F.min_by("doc_id", F.xxhash64("doc_id"))).alias("some"))
    heads = groups.groupBy("cluster", "own").agg(F.max_by(F.struct("known", "some"), F.struct("n", -F.col("known"))).alias("g"))
    heads = written(heads.select("cluster", "own", "g.known", F.explode(F.array_distinct("g.some")).alias("doc_id")), "heads")
    first = heads.join(heads.groupBy("cluster").agg(F.min("own").alias("own")).hint("merge"), ["cluster", "own"])
    later = heads.select("cluster", F.col("own").alias("x")).distinct().join(first.hint("merge"), "cluster").where("x <> own")
    met = links(heads.select(*pick(F.col("own"), F.lit(-1), yes)).unionAll(later.select(*pick(F.col("x"), F.lit(-1), no))))
    to = written(met.groupBy(F.col("a").alias("known")).agg(F.min("b").alias("moved")), "heads-to")
    many = moved(many, to)
    discard(heads, met, to)
    # Then every block against what is outside the cluster's largest group.
    sizes = many.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("n"))
    main = written(sizes.groupBy("cluster").agg(F.max_by("known", F.struct("n", -F.col("known"))).alias("main")), "main-groups")
    outside = blocked(joined_small(many, main, ["cluster"], "inner", FEW).where("known <> main").select("cluster", "doc_id", "n_shingles", "known", "blocks"), "far", "fars")
    if outside.limit(1).count():
        fars = written(outside.select("cluster", "fars").distinct(), "fars")
        left = joined_small(many, fars, ["cluster"], "inner", FEW).withColumn("far", F.explode(F.expr("sequence(0, fars - 1)")))
        right = outside.withColumn("own", F.explode(F.expr("sequence(0, blocks - 1)")))
        met = links(left.select(*pick(F.col("own"), -2 - F.col("far"), no)).unionAll(right.select(*pick(F.col("own"), -2 - F.col("far"), yes))))
        to = components(met)
        last, many = many, moved(many, to.select(F.col("node").alias("known"), F.col("component").alias("moved")))
        discard(fars, met, to, last)
    least = written(many.groupBy("known").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    out = joined_small(many, least, ["known"], "inner", FEW).select(F.col("doc_id").alias("node"), "component")
    out = written(out.unionAll(placed.where("blocks = 1 and component is not null").select(F.col("doc_id").alias("node"), "component")), "components")
    discard(placed, many, main, outside, least)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one doc_id are one
    document, with all their texts, and each gets its component. Rows with a null doc_id link nothing;
    their component is that of their copies, if any, else null, and those without copies are kept.
    The result reads the tables in its ``scratch``.
    """
    read = docs.select("doc_id", "text")
    rows = written(signed(read), "signed")
    classes = rows.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"), F.max("n_shingles").alias("n_shingles"))
    classes = written(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "sig", "n_shingles")
    keys = hot_keys(reps)
    posted = written(postings(reps, keys), "postings")
    rare = merged(posted.where("not is_hot"))
    hot = posted.where("is_hot").select("key", "doc_id")
    # Small tables are written before hot rows meet them: a join of two bare shuffles is one that Spark can split.
    heads = written(hot.groupBy("key").agg(F.min("doc_id").alias("a")), "hot-heads")
    whole = joined_small(hot, heads, ["key"], "inner").select("a", F.col("doc_id").alias("b"))
    cluster = components(rare.unionAll(whole))
    discard(keys, posted, heads)
    members = reps.drop("sig").join(cluster.hint("merge"), reps["doc_id"] == cluster["node"]).select("doc_id", "n_shingles", F.col("component").alias("cluster"))
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        read = read.dropDuplicates(["doc_id", "text"])
    linked = linked_in_clusters(read, members)
    discard(cluster)
    placed = classes.join(linked.hint("merge"), classes["rep"] == linked["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(placed.hint("merge"), "set_hash", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    out.scratch = [rows, classes, linked]
    return out


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < {WORDS} then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) end as sh from w
), x as (
  select doc_id, len(sh) as n, unnest(sh) as g from s
), links as (
  select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as n, doc_id as r from s union select e.b, reach.r from reach join edges e on e.a = reach.n
)
select doc_id, len(sh)::bigint as n_shingles, c as component_id, doc_id = c as kept from s join (select n, min(r) as c from reach group by n) m on m.n = s.doc_id
"""
