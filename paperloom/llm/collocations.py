"""Collocations: phrases of up to four words whose words keep together, from FM-indexes of shards.

1. Texts become shards of one language each, of about ``SHARD_WORDS`` words: numbers of words with the shard's own list.
2. Counts of words over all shards choose the frequent ones, which get numbers of their own; other words part passages,
   as punctuation does.
3. Each shard's bidirectional index extends all words by the words after them: pairs with their counts, summed over the shards.
4. A second reading extends the pairs that are frequent over all shards, to the right and then to the left, by words with which they
   make a frequent pair again: phrases of three and four words, summed likewise. A frequent phrase has frequent parts, so none is missed.
5. Frequent phrases are split at each place, and scored by the counts of both parts; one inside a longer phrase that is
   nearly as frequent, one of its extensions to the left or right, is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.bidirectional import Index, chosen
from paperloom.llm.common import discard, joined_small, rested, table, written
from paperloom.operators.numbering import running_before

MIN_COUNT = 30
#: A phrase goes if a longer one around it has at least so many hundredths of its count.
SHARE = 80
TOP = 2000
SHARD_WORDS = 1_000_000
#: What parts passages; the mark for it is one of these characters, so no word.
STOPS, STOP = r"[.,;:!?\x0A-\x0D]+", "."
NO_LANG = "und"
_HEAD, _TAIL = 32, (1 << 32) - 1


def _cut(tokens: pa.StringArray, size: int):
    """Parts of about ``size`` tokens each, cut after a stop."""
    stops, at = np.flatnonzero(pc.equal(tokens, STOP).to_numpy(zero_copy_only=False)), 0
    while at < len(tokens):
        k = np.searchsorted(stops, at + size)
        end = int(stops[k]) + 1 if k < len(stops) else len(tokens)
        yield tokens.slice(at, end - at)
        at = end


def shards(docs: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """``shard, lang, tokens, words, counts``: numbers of words from 0 as 32-bit integers, the words, and how often each is there.

    Documents of a task and a language go to one shard until it has ``size`` words. A passage is never cut, so one
    that is longer makes a longer shard. Null texts are empty; a null language is ``und``.
    """

    def deal(batches):
        task, made, open_ = TaskContext.get().partitionId(), 0, {}

        def close(lang, last):
            nonlocal made
            arrays = open_.pop(lang)
            for part in _cut(pa.concat_arrays(arrays), size):
                if len(part) < size and not last:
                    open_[lang] = [part]  # goes on with the next documents
                    continue
                coded = part.dictionary_encode()
                ids = coded.indices.to_numpy()
                row = (task << 32 | made, lang, ids.astype("<i4").tobytes(), coded.dictionary, np.bincount(ids, minlength=len(coded.dictionary)))
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([lang]), pa.array([row[2]], pa.binary()), _one(row[3]), _one(pa.array(row[4]))], names=["shard", "lang", "tokens", "words", "counts"])

        for batch in batches:
            text = pc.replace_substring_regex(pc.ascii_lower(batch.column(1)), STOPS, f" {STOP} ")
            text = pc.replace_substring(pc.binary_join_element_wise(text, STOP, " "), "\t", " ")
            split = pc.split_pattern(text, " ")
            for lang in pc.unique(batch.column(0)).to_pylist():
                tokens = split.filter(pc.equal(batch.column(0), lang)).flatten()
                open_.setdefault(lang, []).append(tokens.filter(pc.not_equal(tokens, "")))
                if sum(map(len, open_[lang])) >= size:
                    yield from close(lang, False)
        for lang in list(open_):
            yield from close(lang, True)

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(rested(deal), "shard long, lang string, tokens binary, words array<string>, counts array<long>")


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def vocabulary(parts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, word, f, id) of those that occur ``least`` times; frequent words have small ids, from 1."""
    rows = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).where(F.col("w.words") != STOP)
    count = written(rows.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")), "words")
    totals = written(count.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = count.where(F.col("f") >= least).withColumn("less", -F.col("f")).withColumn("one", F.lit(1))
    out = written(running_before(often, "one", ["less", "lang", "word"], []).select("lang", "word", "f", (F.col("before") + 1).alias("id")), "vocabulary")
    discard(count)
    return totals, out


def numbered(parts: DataFrame, words: DataFrame) -> DataFrame:
    """``shard, tokens, ids``: shards with the ids of their frequent words, each packed after the word's number in the shard."""
    own = parts.select("shard", "lang", F.posexplode("words").alias("at", "word"))
    met = joined_small(own, words.select("lang", "word", "id"), ["lang", "word"], "inner", rows=200_000)
    ids = met.groupBy("shard").agg(F.collect_list(F.col("at").cast("long") * (1 << 32) + F.col("id")).alias("ids"))
    return parts.select("shard", "tokens").join(ids.hint("shuffle_hash"), "shard")


def _text(tokens: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard as dense numbers, 0 between passages and at both ends, and the ids that they stand for, in the same order."""
    of_token = np.frombuffer(tokens, "<i4")
    known = np.zeros(int(of_token.max(initial=0)) + 1, np.int64)
    known[ids >> 32] = ids & 0xFFFFFFFF
    real = np.sort(ids & 0xFFFFFFFF)
    dense = np.searchsorted(real, known) + 1
    dense[known == 0] = 0
    text = dense[of_token]
    text = text[(text > 0) | (np.concatenate([[0], text[:-1]]) > 0)]  # one 0 is enough
    return np.concatenate([[0], text, [0]]), np.concatenate([[0], real])


def pairs(coded: DataFrame) -> DataFrame:
    """``shard, pair, n``: each shard's pairs of words in a row and their counts; a pair is both ids in one long."""

    def extend(batches):
        for batch in batches:
            for shard, tokens, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, real = _text(tokens.as_buffer(), ids.values.to_numpy())
                index = Index(text)
                first, second, found = index.right(index.single())
                keys, n = real[first + 1] << 32 | real[second], found.count
                for k in range(0, len(n), 100_000):
                    part = keys[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array(part), pa.array(n[k : k + 100_000])], names=["shard", "pair", "n"])

    return coded.mapInArrow(rested(extend), "shard long, pair long, n long")


def frequent(local: DataFrame, least: int) -> DataFrame:
    """``shard, pair, f``: the pairs that all shards together have ``least`` times, in each shard that has them, with that count.

    A sum over a pair's own rows, one a shard, so that no pair has to meet the shards again.
    """
    return local.withColumn("f", F.sum("n").over(Window.partitionBy("pair"))).where(F.col("f") >= least).select("shard", "pair", "f")


def longer(coded: DataFrame) -> DataFrame:
    """``a, b, n``: each shard's phrases of three and four words, two ids in each of ``a`` and ``b``; ``coded`` also has ``pairs``, the pairs to build on."""

    def extend(batches):
        for batch in batches:
            for tokens, ids, allowed in zip(*[batch.column(k) for k in range(3)], strict=True):
                text, real = _text(tokens.as_buffer(), ids.values.to_numpy())
                allowed = np.sort(allowed.values.to_numpy())
                index = Index(text)

                def frequent(a, b, real=real, allowed=allowed):
                    keys = real[a] << 32 | real[b]
                    at = np.minimum(np.searchsorted(allowed, keys), len(allowed) - 1)
                    return np.flatnonzero(allowed[at] == keys)

                of, w2, two = index.right(index.single())
                good = frequent(of + 1, w2)
                w1, w2, two = of[good] + 1, w2[good], chosen(two, good)
                of, w3, three = index.right(two)
                good = frequent(w2[of], w3)
                w1, w2, w3, three = w1[of[good]], w2[of[good]], w3[good], chosen(three, good)
                of, w0, four = index.left(three)
                good = frequent(w0, w1[of])
                w0, of, four = w0[good], of[good], chosen(four, good)
                a = np.concatenate([real[w1] << 32 | real[w2], real[w0] << 32 | real[w1[of]]])
                b = np.concatenate([real[w3] << 32, real[w2[of]] << 32 | real[w3[of]]])
                n = np.concatenate([three.count, four.count])
                for k in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (a, b, n)], names=["a", "b", "n"])

    return coded.select("tokens", "ids", "pairs").mapInArrow(rested(extend), "a long, b long, n long")


def phrases(docs: DataFrame, least: int = MIN_COUNT, size: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (lang, word, f, id), and (a, b, f): words of each language, its frequent words, and all frequent phrases of one to four words.

    ``a`` and ``b`` hold two ids each, 32 bits an id, 0 where a phrase has ended. All are written tables.
    """
    parts = written(shards(docs, size), "shards")
    totals, words = vocabulary(parts, least)
    coded = written(numbered(parts, words), "coded")
    met = written(frequent(pairs(coded), least), "frequent-pairs")
    often = met.select("pair", "f").distinct()
    allowed = met.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))
    more = longer(coded.join(allowed.hint("shuffle_hash"), "shard")).groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    one = words.select((F.col("id") * (1 << 32)).alias("a"), F.lit(0).cast("long").alias("b"), "f")
    two = often.select(F.col("pair").alias("a"), F.lit(0).cast("long").alias("b"), "f")
    out = written(one.unionByName(two).unionByName(more), "phrases")
    discard(parts, coded, met)
    return totals, words, out


def _ids(a: Column, b: Column) -> list[Column]:
    return [F.shiftright(a, _HEAD), a.bitwiseAND(F.lit(_TAIL)), F.shiftright(b, _HEAD), b.bitwiseAND(F.lit(_TAIL))]


def _key(ids: list[Column]) -> Column:
    ids = [*ids, *[F.lit(0).cast("long")] * (4 - len(ids))]
    pack = lambda x, y: F.shiftleft(x, _HEAD).bitwiseOR(y)
    return F.struct(pack(ids[0], ids[1]).alias("a"), pack(ids[2], ids[3]).alias("b"))


def scored(found: DataFrame) -> DataFrame:
    """(a, b, size, f, l, r, score, left, right) of phrases of two words and more, from (a, b, f) of all.

    Of its cuts the one with the lowest score counts, of equal ones the first. ``left`` and ``right`` are the counts of the most
    frequent phrases with one word more on that side, 0 without any. Scores are whole numbers, by decimals of 38 digits.
    """
    w = _ids(F.col("a"), F.col("b"))
    size = F.when(w[3] > 0, 4).when(w[2] > 0, 3).when(w[1] > 0, 2).otherwise(1)
    rows = found.withColumn("size", size)
    many = rows.where("size > 1")
    cut = lambda k: [F.struct(F.lit(j).alias("k"), _key(w[:j]).alias("head"), _key(w[j:k]).alias("rest")) for j in range(1, k)]
    cuts = F.when(F.col("size") == 2, F.array(*cut(2))).when(F.col("size") == 3, F.array(*cut(3))).otherwise(F.array(*cut(4)))
    opened = many.select("a", "b", "size", "f", F.explode(cuts).alias("c")).select("a", "b", "size", "f", "c.*")
    part = lambda side, count: found.select(F.col("a").alias(f"{side}_a"), F.col("b").alias(f"{side}_b"), F.col("f").alias(count))
    opened = opened.select("a", "b", "size", "f", "k", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("head", "rest") for c in "ab"])
    met = opened.join(part("head", "l").hint("merge"), ["head_a", "head_b"]).join(part("rest", "r").hint("merge"), ["rest_a", "rest_b"])
    score = F.expr("cast(f as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    best = met.groupBy("a", "b", "size", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    # A phrase without its first word has it as a left extension, one without its last word as a right one.
    inner = lambda c: F.when(F.col("size") == 3, c(3)).otherwise(c(4))
    no_first, no_last = inner(lambda k: _key(w[1:k])), inner(lambda k: _key(w[: k - 1]))
    around = rows.where("size > 2").select("f", F.explode(F.array(F.struct(no_first.alias("p"), F.lit(1).alias("side")), F.struct(no_last.alias("p"), F.lit(0).alias("side")))).alias("e"))
    most = lambda side: F.max(F.when(F.col("e.side") == side, F.col("f")))
    around = around.groupBy(F.col("e.p.a").alias("a"), F.col("e.p.b").alias("b")).agg(most(1).alias("left"), most(0).alias("right"))
    out = best.join(around.hint("merge"), ["a", "b"], "left")
    return out.select("a", "b", "size", "f", "x.l", "x.r", "x.score", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))


def collocations(docs: DataFrame, least: int = MIN_COUNT, share: int = SHARE, top: int = TOP, size: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, left, right``: each language's ``top`` phrases, by score, then count, then text.

    ``docs``: text, lang; other columns are ignored, and repeated rows count again. Null and empty texts have no words, a null
    language is ``und``. A phrase inside a longer one with ``share`` hundredths of its count or more is left out; ``left`` and ``right``
    count the most frequent phrases with one word more on that side. No documents, or no frequent phrases, give no rows.
    """
    totals, words, found = phrases(docs, least, size)
    good = scored(found).where(100 * F.greatest("left", "right").cast("decimal(20, 0)") < share * F.col("f").cast("decimal(20, 0)"))
    w = _ids(F.col("a"), F.col("b"))
    lang = words.select(F.col("id").alias("w1"), F.col("word").alias("s1"), "lang")
    good = good.select("*", *[c.alias(f"w{k}") for k, c in enumerate(w, 1)]).join(lang.hint("merge"), "w1")
    # The best of each language are found within parts of it first, ties at the end included.
    by = F.desc("score"), F.desc("f")
    part = F.pmod(F.xxhash64("a", "b"), F.lit(64))
    near = written(good.withColumn("part", part).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("place") <= top), "best")
    out = near
    for k in (2, 3, 4):
        out = out.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"s{k}")).hint("merge"), f"w{k}", "left")
    out = out.withColumn("phrase", F.concat_ws(" ", "s1", "s2", "s3", "s4"))
    for keys in (["lang", "part"], ["lang"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by, "phrase"))).where(F.col("rank") <= top)
    out = out.join(totals.hint("merge"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score", "left", "right")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("left", "right")


OP13_SQL = rf"""
with pieces as (
  select coalesce(lang, '{NO_LANG}') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), ws as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), grams as (
  select lang, m as size, array_to_string(ws[i:i + m - 1], ' ') as phrase
  from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from ws, (select unnest([1, 2, 3, 4]) as m))
), f as (
  select lang, size, phrase, count(*)::hugeint as f from grams group by all
), cand as (
  select * from f where size > 1 and f >= {MIN_COUNT}
), cuts as (
  select c.lang, c.size, c.phrase, c.f, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') as head, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') as rest
  from (select *, unnest(range(1, size)) as k from cand) c
), scored as (
  select c.lang, c.size, c.phrase, c.f, k, h.f as l, r.f as r, (2000000 * c.f) // (h.f + r.f) as score
  from cuts c join f h on h.lang = c.lang and h.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.rest
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_phrases as (
  select lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') as phrase, f
  from (select *, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from cand))
), gone as (
  select distinct c.lang, c.phrase from cand c join inner_phrases i on i.lang = c.lang and i.phrase = c.phrase and 100 * i.f >= {SHARE} * c.f
), n as (
  select lang, sum(f)::bigint as n from f where size = 1 group by lang
), ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, f desc, b.phrase) as rank from best b anti join gone g on g.lang = b.lang and g.phrase = b.phrase
)
select lang, rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join n using (lang) where rank <= {TOP}
"""
