"""Substring dedup: windows of words that an earlier document has too, by FM-indexes of shards.

1. Every window of ``WINDOW`` words has an anchor, its least ``ANCHOR``-word gram by hash; windows in a row
   with one anchor are a segment. Equal windows have equal anchors.
2. Anchors of two documents at least mark the segments that can hold a repeat. Such segments are sharded
   by anchor, so a window meets its repeats in its shard.
3. A shard's index holds the segments that a later document could repeat: those not of an anchor's last document alone.
   Segments of other documents than an anchor's first one are streamed against it: backward search computes the matching
   statistic at each of their words, and where it reaches ``WINDOW``, the interval's least document is reported.
4. A document loses the words of its windows whose least document is smaller.

An anchor of more than ``HOT`` segments is sharded by single windows, so no shard holds all of its segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, joined_small, table, written
from paperloom.llm.fm_index import Index, matching_statistics
from paperloom.llm.wordhash import spans, windows, word_numbers

WINDOW = 13
ANCHOR = 5
HOT = 4096
#: Words of a shard, on average.
SHARD_WORDS = 150_000


def segments_of(numbers: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the segments of a text."""
    grams = windows(numbers, gram)
    if len(numbers) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = view.argmin(axis=1) + np.arange(len(view))
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    last = np.concatenate([first[1:] - 1, [len(view) - 1]])
    return grams[place[first]].view(np.int64), first, last


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor, place`` of every segment of every text, after the other columns of ``docs`` (longs); place is first * 256 + number of windows after it.

    A segment has fewer windows than an anchor has places in a window.
    """
    own = [c for c in docs.columns if c != "text"]
    names = ["anchor", *own, "place"]

    def cut(batches):
        for batch in batches:
            parts = []
            for *key, text in zip(*[x.to_numpy() for x in batch.columns[:-1]], batch.columns[-1], strict=True):
                a, first, last = segments_of(word_numbers(text.as_py())[0], window, gram)
                if len(a):
                    parts.append((a, *[np.full(len(a), k) for k in key], first * 256 + (last - first)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)

    return docs.select(*own, "text").mapInArrow(cut, ", ".join(f"{c} long" for c in names))


def spelled(marked: DataFrame, window: int) -> DataFrame:
    """``anchor, doc_id, first, text`` of the segments in ``marked`` (doc_id, text, list of segments).

    Segments of hot anchors come as single windows, their anchor the window's own hash.
    """

    def spell(batches):
        for batch in batches:
            out = {k: [] for k in ("anchor", "doc_id", "first", "text")}
            found = batch.column(2)
            cut, inner = found.offsets.to_numpy(), found.values
            anchor, place, hot = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "place", "hot"))
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                own = slice(cut[row], cut[row + 1])
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                start, end = spans(np.frombuffer(raw, np.uint8))
                first = place[own] >> 8
                last = first + (place[own] & 255)
                keys = anchor[own]
                if hot[own].any():  # single windows instead
                    each = [(w, z, k) for w, z, k, h in zip(first.tolist(), last.tolist(), keys.tolist(), hot[own], strict=True) if not h]
                    whole = windows(word_numbers(text.as_py())[0], window).view(np.int64)
                    each += [(w, w, int(whole[w])) for a, z, h in zip(first.tolist(), last.tolist(), hot[own], strict=True) if h for w in range(a, z + 1)]
                else:
                    each = list(zip(first.tolist(), last.tolist(), keys.tolist(), strict=True))
                if not each:
                    continue
                begin, stop = start[[x[0] for x in each]].tolist(), end[[x[1] + window - 1 for x in each]].tolist()
                out["anchor"] += [x[2] for x in each]
                out["doc_id"] += [doc_id] * len(each)
                out["first"] += [x[0] for x in each]
                # bytes.split() parts at the very blanks of the contract
                out["text"] += [b" ".join(raw[a:b].split()) for a, b in zip(begin, stop, strict=True)]
            text = pa.array(out.pop("text"), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["first"], pa.int32()), text], names=["anchor", "doc_id", "first", "text"])

    return marked.mapInArrow(spell, "anchor long, doc_id long, first int, text string")


def searched(distinct: DataFrame, window: int, shards: int) -> DataFrame:
    """``k1, k2, least``: of each streamed segment, the least document of each of its windows; a window without an earlier place has the largest long.

    ``distinct`` has each segment's text once, with the first and the last document it is in.
    """

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k1", "ascending"), ("k2", "ascending")])
        owner, last = t["doc_id"].to_numpy(), t["last_id"].to_numpy()
        _, of = np.unique(t["anchor"].to_numpy(), return_inverse=True)
        lowest, highest = np.full(of.max() + 1, np.iinfo(np.int64).max), np.full(of.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(lowest, of, owner)
        np.maximum.at(highest, of, last)
        held, streamed = owner < highest[of], np.flatnonzero(last > lowest[of])
        parts = pc.split_pattern(t["text"].combine_chunks(), " ")
        cut = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        size = np.diff(cut)
        # Texts end to end, 0 before and after each; the index has those held, and one 0 more in front.
        flat = np.zeros(len(words) + len(size) + 1, np.int64)
        head = 1 + cut[:-1] + np.arange(len(size))
        flat[np.arange(len(words)) + 1 + np.repeat(np.arange(len(size)), size)] = words
        of_text = np.repeat(np.arange(len(size)), size + 1)
        own = np.concatenate([[True], held[of_text]])
        index = Index(flat[own], np.concatenate([[np.iinfo(np.int64).max], owner[of_text]])[own], max(window, 2))
        n = size[streamed] - window + 1
        before = np.concatenate([[0], np.cumsum(n)])
        ends = np.arange(before[-1]) + np.repeat(head[streamed] + window - before[:-1], n)
        length, lo, hi = matching_statistics(index, flat, ends, window)
        least = np.full(len(ends), np.iinfo(np.int64).max)
        told = length >= window
        least[told] = index.least_owner(lo[told], hi[told])
        lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(least))
        return pa.Table.from_arrays([t["k1"].take(streamed), t["k2"].take(streamed), lists], names=["k1", "k2", "least"])

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(search, "k1 long, k2 long, least array<long>")


def removed(docs: DataFrame, window: int = WINDOW, gram: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(doc_id, starts): the windows of each document, by first word, that a smaller doc_id has too."""
    spark = docs.sparkSession
    # Of rows with one doc_id, all texts count as the document's.
    known, text_key = docs.select("doc_id", "text").where("doc_id is not null and text is not null"), ["doc_id"]
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # Places are those of one text, and are looked up in no other.
        known, text_key = known.dropDuplicates(["doc_id", "text"]).withColumn("version", F.xxhash64("text")), ["doc_id", "version"]
    found = written(anchors(known, window, gram), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("lo < hi").select("anchor", (F.col("n") > hot).alias("hot")), "shared-anchors")
    hits = joined_small(found, shared, ["anchor"], "inner", rows=200_000)
    hits = hits.groupBy(*text_key).agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("found"))
    marked = known.join(hits.hint("merge"), text_key).select("doc_id", "text", "found")
    parts = spelled(marked, window).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(5), "text"))
    parts = written(parts, "segments")
    discard(found)
    distinct = written(parts.groupBy("k1", "k2", "text").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_id"), F.min("anchor").alias("anchor")), "distinct-segments")
    words = distinct.agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit(" "))) + 2)).first()[0] or 0
    least = written(searched(distinct, window, max(1, -(-words // SHARD_WORDS))), "searched")
    discard(distinct)
    met = parts.select("k1", "k2", "doc_id", "first").join(least.hint("merge"), ["k1", "k2"])
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull())
    met = met.select("doc_id", starts.alias("starts")).where(F.size("starts") > 0)
    out = written(met.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts")), "repeats")
    discard(parts, least, shared)
    return out


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row: without the words of repeated windows, joined by one space.

    Null, empty and blank texts have no words. Texts of fewer than ``window`` words and rows with a null doc_id
    lose nothing. A window twice in one document alone stays. Rows with one doc_id and different texts
    are one document; each loses the windows at the places found for either.
    """
    starts = removed(docs, window, gram, hot)
    met = docs.select("doc_id", "text").join(starts.hint("merge"), "doc_id", "left")

    def strip(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if not places.is_valid:  # bytes.split() parts at the very blanks of the contract
                    own = raw.split()
                    n_words.append(len(own))
                    n_removed.append(0)
                    kept.append(b" ".join(own))
                    continue
                start, end = spans(np.frombuffer(raw, np.uint8))
                edge = np.zeros(len(start) + window + 1, np.int64)
                at = places.values.to_numpy()
                at = at[at < len(start)]  # found in a longer text of the doc_id
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stay = np.cumsum(edge)[: len(start)] == 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]])))  # runs of words that stay
                runs = [raw[a:b] for a, b in zip(start[turn[0::2]].tolist(), end[turn[1::2] - 1].tolist(), strict=True)]
                n_words.append(len(start))
                n_removed.append(int((~stay).sum()))
                kept.append(b" ".join(b" ".join(runs).split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return met.select("doc_id", "text", "starts").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
with w as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)
), low as (
  select win, min(doc_id) as lo from win group by win
), hit as (
  select distinct doc_id, unnest(range(i, i + {WINDOW})) as k from win join low using (win) where lo < doc_id
), gone as (
  select doc_id, list(k) as ks from hit group by doc_id
)
select w.doc_id, len(ws) as n_words, coalesce(len(ks), 0) as n_removed,
  sha256(coalesce(array_to_string(
    list_transform(list_filter(range(1, len(ws) + 1), lambda k: ks is null or not list_contains(ks, k)), lambda k: ws[k]), ' '), '')) as kept_sha256
from w left join gone using (doc_id)
"""
