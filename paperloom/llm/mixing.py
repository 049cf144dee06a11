"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule stands at frac(i * golden ratio) on the line of cumulative weights and
belongs to the source there. Each source's documents, in a shuffled order, are laid end to end
and cut into blocks of equal word count; the source's r-th slot takes its r-th block, starting
over after the last. Slots of a source weigh its target over its block size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, fresh, joined_small, table, word_count, written
from paperloom.operators.numbering import running_before

#: Words of a block at most, the unit of a slot; a source has at least so many blocks, if it has the words.
BLOCK = 256
LEAST_BLOCKS = 64
#: No document is taken more often.
MAX_EPOCHS = 3
SEED = 20240613
#: Documents of a source that are ordered in one task, on average.
RUN = 512
GOLDEN = 0.6180339887498949
#: Sources whose names and numbers are sent to all tasks; more are joined by a shuffle.
SOURCES = 10_000


def targets(sizes: list[tuple], weights: list[float], total: int, most: float = MAX_EPOCHS) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its source, its excess goes to the others by weight.

    ``sizes``: (source, size) rows. With all sources at their stop the rest of ``total`` stays untaken.
    """
    out, open_ = [0.0] * len(sizes), {k for k, (_, n) in enumerate(sizes) if n > 0}
    left = float(total)
    while open_:
        whole = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / whole >= most * sizes[k][1]}
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = float(most * sizes[k][1])
            left -= out[k]
        open_ -= over
    return out


def source_facts(sized: DataFrame, weights: dict | None = None, block: int = BLOCK, most: float = MAX_EPOCHS) -> DataFrame:
    """``source_no, source, source_size, target, n_blocks, low``: sources in order of code points, null last. A written table.

    The same targets as ``targets`` gives, over a table: in each round sources that would pass their stop are stopped, and two sums
    over the others come to the driver. ``low`` is where the source's part of the schedule begins, in slots.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("n")).withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1))
    rows = running_before(total, "one", ["last", "source"], []).select(F.col("before").cast("int").alias("source_no"), "source", "n")
    weight = (F.col("source_no") % 3 + 1).cast("double")
    if weights:
        given = sized.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "named string, given double")
        rows = rows.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("named")), "left")
        weight = F.coalesce("given", weight)
    rows = written(rows.select("source_no", "source", "n", weight.alias("w")), "sources")
    left, whole, stopped, count = None, None, F.lit(False), -1
    while True:
        open_ = ~stopped & (F.col("n") > 0)
        r = rows.agg(F.sum("n").alias("all"), F.sum(F.when(stopped, F.col("n") * most)).alias("gone"), F.sum(F.when(open_, F.col("w"))).alias("w"), F.count_if(stopped).alias("k")).first()
        if r["k"] == count or not r["w"]:
            break
        left, whole, count = float(r["all"] or 0) - float(r["gone"] or 0), r["w"], r["k"]
        stopped = stopped | ((F.col("n") > 0) & (F.lit(left) * F.col("w") / F.lit(whole) >= F.col("n") * most))
    share = F.lit(left) * F.col("w") / F.lit(whole) if whole else F.lit(0.0)
    target = F.when(F.col("n") <= 0, 0.0).when(stopped, F.col("n") * float(most)).otherwise(share)
    n_blocks = F.greatest(F.lit(1), F.least(F.col("n"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / block)))).cast("long")
    rows = rows.select("source_no", "source", F.col("n").alias("source_size"), target.alias("target"), n_blocks.alias("n_blocks"))
    part = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
    out = running_before(rows.withColumn("slots", part), "slots", ["source_no"], [], "low")
    return written(out.select("source_no", "source", "source_size", "target", "n_blocks", "slots", "low"), "source-facts")


def schedule(facts: DataFrame) -> DataFrame:
    """(source_no, block_no, times): how often the schedule's slots take each block of each source.

    Slots and the edges between sources stand on one line; a slot's source is the number of edges before it.
    """
    total = facts.agg(F.sum("slots")).first()[0] or 0.0
    slots = facts.sparkSession.range(int(round(total)))
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    edges = facts.where("source_no > 0").select((F.col("low") / F.lit(total or 1.0)).alias("u"), F.lit(0).alias("kind"), F.col("source_no").cast("long").alias("id"), F.lit(1).alias("edge"))
    line = slots.select(point.alias("u"), F.lit(1).alias("kind"), "id", F.lit(0).alias("edge")).unionByName(edges)
    slots = running_before(line, "edge", ["u", "kind", "id"], []).where("kind = 1").select("id", F.col("before").cast("int").alias("source_no"))
    # Rank within the source: whole chunks before, then the place in the chunk.
    slots = slots.withColumn("chunk", F.expr("id div 16384"))
    before = slots.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("id"))
    ranked = slots.withColumn("place", place).join(before.hint("merge"), ["source_no", "chunk"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    ranked = joined_small(ranked, facts.select("source_no", "n_blocks"), ["source_no"], "inner", rows=SOURCES).where(F.col("rank") < MAX_EPOCHS * F.col("n_blocks"))
    return ranked.groupBy("source_no", (F.col("rank") % F.col("n_blocks")).alias("block_no")).agg(F.count(F.lit(1)).alias("times"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``doc_id, row_no, source, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` counts the words the mix takes of the row, repeats included; 0 to 3 times ``size``.
    ``weights`` maps sources to weights (missing: 1, 2, 3 repeating in order). Size is the number
    of words; null, empty and blank texts have 0 and are never taken. Null is a source of its own, the
    last. Repeated rows count each, in an order by document, then size. An empty table gives an empty one.
    The order within a source comes from a seeded hash of the document, so reruns agree.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    facts = source_facts(sized, weights, block)
    known = facts.drop("slots", "low")
    known = F.broadcast(known) if facts.limit(SOURCES + 1).count() <= SOURCES else known.hint("merge")
    rows = sized.join(known.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # Shuffled order: runs by the top of a hash, then by the whole hash; whole runs before count as one sum.
    runs = max(1, -(-rows.count() // RUN))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")).withColumn("run", F.expr(f"(h div 131072) * {runs} div 2147483648"))
    inner = Window.partitionBy("source_no", "run").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("row_no", F.row_number().over(inner)).withColumn("stop", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    heads = rows.groupBy("source_no", "run").agg(F.sum("size").alias("run_size"))
    heads = heads.withColumn("head", F.sum("run_size").over(Window.partitionBy("source_no").orderBy("run")) - F.col("run_size"))
    rows = rows.join(heads.drop("run_size").hint("merge"), ["source_no", "run"]).withColumn("start", F.col("head") + F.col("stop") - F.col("size"))
    rows = written(rows.select("doc_id", "source", "source_no", "run", "row_no", "size", "source_size", "target", "n_blocks", "start"), "mix-rows")
    discard(sized)
    meets = "sequence(((start + 1) * n_blocks - 1) div source_size, ((start + size) * n_blocks - 1) div source_size)"
    pieces = rows.where("size > 0").withColumn("block_no", F.explode(F.expr(meets)))
    part = F.expr("least(start + size, (block_no + 1) * source_size div n_blocks) - greatest(start, block_no * source_size div n_blocks)")
    key = ["source_no", "run", "row_no"]
    taken = pieces.join(schedule(facts).hint("merge"), ["source_no", "block_no"]).groupBy(*key).agg(F.sum(part * F.col("times")).alias("taken"))
    out = rows.join(taken.hint("merge"), key, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", F.concat_ws("/", "source_no", "run", "row_no").alias("row_no"), "source", "size", "source_size", "target", "taken")


def repeat_rows(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: ``taken / size`` times, rounded by half a document.

    Rows the mix leaves out go; columns stay as they are. Rows of one ``doc_id`` share one verdict.
    """
    plan = mix(docs, weights, block, seed).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    mixed, often, copy = (fresh(docs, x) for x in ("mixed", "times", "copy"))
    plan = plan.where("size > 0").select(F.col("doc_id").alias(mixed), times.alias(often)).where(F.col(often) > 0)
    met = docs.join(plan.hint("merge"), F.col("doc_id").eqNullSafe(F.col(mixed)))
    return met.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(often))).alias(copy)).drop(copy)


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as h from documents
), src as (
  select source, sum(size)::bigint as n, row_number() over (order by source nulls last) - 1 as k from sized group by source
), caps as (
  select *, (1 + k % 3)::double as w, {MAX_EPOCHS} * n as cap, row_number() over (order by {MAX_EPOCHS} * n / (1 + k % 3), k) as o from src where n > 0
), levels as (
  select *, (select sum(n) from src) - coalesce(sum(cap) over (order by o rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by o rows between current row and unbounded following) as open from caps
), stop as (
  select min(o) as o from levels where rest * w / open < cap
), goals as (
  select src.*, case when l.o is null then 0.0 when l.o < coalesce((select o from stop), 1e9) then l.cap::double
      else (select rest::double from levels join stop using (o)) * l.w / (select open from levels join stop using (o)) end as target,
    greatest(1, least(src.n, greatest({LEAST_BLOCKS}, (src.n + {BLOCK} - 1) // {BLOCK}))) as nb
  from src left join levels l using (k)
), shares as (
  select *, case when n > 0 then target * nb / n else 0.0 end as share from goals
), edges as (
  select *, sum(share) over (order by k) / (select sum(share) from shares) as edge from shares
), slots as (
  select i, (select count(*) from edges where k < (select max(k) from edges) and edge <= i * {GOLDEN} - floor(i * {GOLDEN})) as k
  from range((select round_even(sum(share), 0)::bigint from shares)) t(i)
), ranked as (
  select k, row_number() over (partition by k order by i) - 1 as r from slots
), times as (
  select k, r % nb as b, count(*) as times from ranked join goals using (k) where r < {MAX_EPOCHS} * nb group by all
), placed as (
  select s.doc_id, s.size, g.k, g.n, g.target, g.nb, sum(s.size) over (partition by g.k order by h, doc_id, s.size rows unbounded preceding) - s.size as a, row_number() over () as id
  from sized s join goals g on s.source is not distinct from g.source
), pieces as (
  select *, unnest(range(((a + 1) * nb - 1)::bigint // n, ((a + size) * nb - 1)::bigint // n + 1)) as b from placed where size > 0
), taken as (
  select id, sum((least(a + size, (b + 1) * n // nb) - greatest(a, b * n // nb)) * times) as taken from pieces join times using (k, b) group by id
)
select doc_id, size, n as source_size, target, coalesce(taken, 0)::bigint as taken from placed left join taken using (id)
"""
