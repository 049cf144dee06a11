"""Benchmark decontamination: a positional inverted index of the documents, read from the rarest terms of each test phrase.

1. The postings (term, document, place) of all documents hold the terms of the benchmark; a document ends in a mark
   whose place is its number of words. A part of the table holds the lists of its own documents, so nothing is
   shuffled to write it.
2. A test text is cut into its windows. Each window leads with its two rarest terms, by their number in the corpus.
3. Lists are moved by the term's place in the text, so that an occurrence of the text is one place in all of them.
   The lists of the two rarest terms are intersected first; only what is left meets those of the other terms.
4. Runs of consecutive words that are as long as a window are phrase matches.

SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, joined_small, table, written

WINDOW = 10
#: What parts words: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The mark at a document's end, which is no word.
END = ""


def lowered(text: Column) -> Column:
    """A text with A to Z as a to z and all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def terms(text: Column) -> Column:
    """A text's words in lower case; none for null."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): ``doc`` is doc_id, or where ids repeat or are null a hash of id and text."""
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    unique = ids.where("n > 1 or doc_id is null").limit(1).count() == 0
    return docs.select("doc_id", "text", (F.col("doc_id") if unique else F.xxhash64("doc_id", "text")).alias("doc"))


def item_texts(benchmark: DataFrame) -> DataFrame:
    """(item_id, text_id, ws): items with words; equal word sequences have one text_id. Rows with a null item_id take no part."""
    rows = benchmark.where("item_id is not null").select("item_id", terms(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return rows.select("item_id", F.xxhash64(F.array_join("ws", " ")).alias("text_id"), "ws").distinct()


def places(items: DataFrame) -> DataFrame:
    """(text_id, n, k, word): each text's words by place from 0, once however many items have it."""
    texts = items.select("text_id", "ws").dropDuplicates(["text_id"])
    return texts.select("text_id", F.size("ws").alias("n"), F.posexplode("ws").alias("k", "word"))


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``term, doc, pos`` of the words of ``docs`` (doc, text) that are in ``words`` (word, term), and of each document's end.

    Places count from 0. A null or empty text has its end alone.
    """
    rows = docs.select("doc", F.posexplode(F.concat(terms(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    return joined_small(rows, words, ["word"], "inner", rows=200_000).select("term", "doc", "pos")


def leading(known: DataFrame, window: int) -> DataFrame:
    """(text_id, s, size, k1, t1, k2, t2): each window's two rarest terms with their places in the text.

    ``known``: text_id, n, k, term, f. Windows with a term that no document has are left out.
    """
    size = F.least(F.col("n"), F.lit(window))
    first, last = F.greatest(F.lit(0), F.col("k") - size + 1), F.least(F.col("k"), F.col("n") - size)
    rows = known.select("text_id", size.alias("size"), "k", "term", "f", F.explode(F.sequence(first, last)).alias("s"))
    by_rarity = F.array_sort(F.collect_list(F.struct("f", "k", "term")))
    out = rows.groupBy("text_id", "s", "size").agg(by_rarity.alias("r")).where("r[0].f > 0")
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    out = out.select("text_id", "s", "size", F.col("r")[0].alias("a"), second.alias("b"))
    return out.select("text_id", "s", "size", F.col("a.k").alias("k1"), F.col("a.term").alias("t1"), F.col("b.k").alias("k2"), F.col("b.term").alias("t2"))


def with_frequency(index: DataFrame, words: DataFrame, items: DataFrame) -> DataFrame:
    """(text_id, n, k, term, f) of the test texts; f is the term's number of postings. A written table."""
    count = written(index.groupBy("term").agg(F.count(F.lit(1)).alias("f")), "frequencies")
    known = places(items).join(words.hint("shuffle_hash"), "word").join(count.hint("shuffle_hash"), "term", "left")
    out = written(known.select("text_id", "n", "k", "term", F.coalesce("f", F.lit(0)).alias("f")), "test-places")
    discard(count)
    return out


def phrase_matches(index: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame:
    """(text_id, doc, first, n): maximal runs of a test text's words in a document, of ``window`` words or the whole text at least.

    ``index``: postings, a written table; ``known``: see ``with_frequency``. A written table.
    """
    windows = written(leading(known, window), "windows")
    one = windows.select("text_id", F.col("k1").alias("k"), F.col("t1").alias("term"))
    wanted = written(one.unionByName(windows.select("text_id", F.col("k2").alias("k"), F.col("t2").alias("term"))).distinct(), "leads")
    moved = joined_small(index, wanted, ["term"], "inner", rows=200_000).select("text_id", "k", "doc", (F.col("pos") - F.col("k")).alias("at"))
    lists = written(moved.distinct(), "lists")
    pairs = written(windows.select("text_id", F.col("k1").alias("k"), "k2").distinct(), "pairs")
    rare = joined_small(lists, pairs, ["text_id", "k"], "inner", rows=200_000).withColumnRenamed("k", "k1")
    both = rare.join(lists.withColumnRenamed("k", "k2").hint("merge"), ["text_id", "k2", "doc", "at"])
    both = joined_small(both, windows.select("text_id", "k1", "k2", "s", "size"), ["text_id", "k1", "k2"], "inner", rows=200_000)
    left = both.select("text_id", "doc", "at", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("size") - 1)).alias("k")).distinct()
    left = written(joined_small(left, known.select("text_id", "n", "k", "term"), ["text_id", "k"], "inner", rows=200_000).withColumn("pos", F.col("at") + F.col("k")), "open")
    where = written(left.select("doc").distinct(), "open-documents")
    rest = joined_small(index, where, ["doc"], "left_semi", rows=200_000)
    there = left.join(rest.hint("merge"), ["doc", "pos", "term"], "left_semi")
    run = Window.partitionBy("text_id", "doc", "at").orderBy("k")
    runs = there.withColumn("run", F.col("k") - F.row_number().over(run)).groupBy("text_id", "doc", "at", "n", "run")
    runs = runs.agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("length"))
    out = runs.where(F.col("length") >= F.least(F.col("n"), F.lit(window))).select("text_id", "doc", "first", F.col("length").alias("n"))
    out = written(out, "phrase-matches")
    discard(windows, wanted, lists, pairs, left, where)
    return out


def proximity_matches(index: DataFrame, known: DataFrame, window: int = WINDOW, reach: int = 2 * WINDOW) -> DataFrame:
    """(text_id, s, doc, pos): windows of test texts all of whose words are within ``reach`` words of their rarest one's place ``pos``, in any order.

    A word that a window has twice is asked for once. The second rarest word is looked for first.
    """
    windows = written(leading(known, window), "windows")
    rare = joined_small(index, windows.select("text_id", "s", F.col("t1").alias("term"), "t2"), ["term"], "inner", rows=200_000)
    rare = rare.withColumnRenamed("term", "t1").distinct()
    width = 2 * reach + 1
    dealt = index.select("doc", "term", F.col("pos").alias("at"), F.floor(F.col("pos") / width).alias("cell"))

    def close(rows: DataFrame) -> DataFrame:
        cells = F.array_distinct(F.array(*[F.floor((F.col("pos") + d) / width) for d in (-reach, reach)]))
        met = rows.withColumn("cell", F.explode(cells)).join(dealt.hint("merge"), ["doc", "term", "cell"])
        return met.where(F.abs(F.col("at") - F.col("pos")) <= reach)

    own = ["text_id", "s", "doc", "pos"]
    second = written(close(rare.withColumnRenamed("t2", "term")).select(*own).distinct(), "close")
    size = F.least(F.col("n"), F.lit(window))
    words = known.select("text_id", "term", F.explode(F.sequence(F.greatest(F.lit(0), F.col("k") - size + 1), F.least(F.col("k"), F.col("n") - size))).alias("s")).distinct()
    words = written(words.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("text_id", "s"))), "window-words")
    found = close(joined_small(second, words, ["text_id", "s"], "inner", rows=200_000)).groupBy(*own, "asked").agg(F.count_distinct("term").alias("met"))
    out = written(found.where("met = asked").select(*own), "proximity-matches")
    discard(windows, second, words)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of ``docs`` (doc_id, text): words, words inside test phrases, and the items these are of.

    A phrase is ``window`` consecutive words of a test text, or all of a shorter one. Null and empty texts have no words and no
    hits. Rows with one doc_id are judged each by its own text; repeated rows each stay. Items are sorted as text, each once;
    items with a null item_id or without words take no part. An empty benchmark hits nothing; no documents give no rows.
    """
    docs = keyed(docs)
    items = written(item_texts(benchmark), "items")
    vocabulary = items.select(F.explode("ws").alias("word")).distinct().unionByName(items.sparkSession.range(1).select(F.lit(END).alias("word")))
    words = written(vocabulary.select("word", F.xxhash64("word").alias("term")), "test-words")
    index = written(postings(docs, words), "postings")
    known = with_frequency(index, words, items)
    matches = phrase_matches(index, known, window)
    covered = matches.select("doc", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("pos"))
    n_hit = covered.distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    of = joined_small(matches.select("doc", "text_id").distinct(), items.select("text_id", F.col("item_id").cast("string").alias("item")), ["text_id"], "inner", rows=200_000)
    named = of.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = index.where(F.col("term") == F.xxhash64(F.lit(END))).groupBy("doc").agg(F.max("pos").cast("long").alias("n_words"))
    out = docs.select("doc_id", "doc").join(ends.hint("merge"), "doc", "left").join(n_hit.hint("merge"), "doc", "left").join(named.hint("merge"), "doc", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with docs as (
  select doc_id, {_WORDS} as ws from documents
), items as (
  select item_id, ws, least({WINDOW}, len(ws)) as n from (select item_id, {_WORDS} as ws from benchmark) where item_id is not null and len(ws) > 0
), phrases as (
  select distinct item_id, n, array_to_string(ws[s:s + n - 1], ' ') as phrase from (select *, unnest(range(1, len(ws) - n + 2)) as s from items)
), seen as (
  select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as phrase
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from docs, (select distinct n from phrases))
), found as (
  select doc_id, item_id, i, n from seen join phrases using (n, phrase)
), hit as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from docs d left join hit using (doc_id) left join named using (doc_id)
"""
