"""Language identification by multilingual mixture inference.

A document is a mixture of languages; each language is a distribution of letter trigrams, in
``BUCKETS`` hashed places, and beside them stands a background in which every place is equally likely.
Expectation-maximisation estimates the proportions for the best language, the best two, and so on as long
as another one raises the likelihood less a penalty per language; the last set that did is chosen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import fresh, give_back, rested, table
from paperloom.llm.tokens import forget

BUCKETS = 1 << 14
#: The model is fitted on about so many labelled documents of each language at most, chosen by a hash; whole texts.
SAMPLE = 5_000
#: Nats of log-likelihood that each further language must bring, times the log of the number of trigrams.
PENALTY = 3.0
#: Rounds for the order in which languages are tried. The mixture of a set goes on until no share moves by TOLERANCE.
ROUNDS = 8
TOLERANCE = 1e-3

# Bytes: ASCII letters (texts are in lower case) and all bytes of longer characters stay, others part words.
_KEEP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script; numerals of any kind are none."""
    return any(c.isalpha() for c in text or "")


def places(text: str) -> np.ndarray:
    """The place of each trigram of a text's words, ends of words included; none if it has no letter."""
    if not has_letter(text):
        return np.zeros(0, np.int64)
    b = _KEEP[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    key = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities (trigram places x languages), from (text, lang) rows.

    Rows with null text or lang take no part. Memory: one count vector a language and task, of 16 tasks.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not known:
        return [], np.ones((BUCKETS, 0))
    part = F.create_map(*[x for k, n in known.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chance = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < F.element_at(part, F.col("lang"))).repartition(16)

    @rested
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(places(text.as_py()), minlength=BUCKETS)
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": list(seen), "counts": pa.array(list(seen.values()), pa.list_(pa.int64()))})

    def add(t: pa.Table) -> pa.Table:  # 16 rows at most
        counts = t["counts"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, BUCKETS).sum(axis=0)
        return pa.Table.from_pydict({"lang": t["lang"][:1].to_pylist(), "counts": pa.array([counts], pa.list_(pa.int64()))})

    kind = "lang string, counts array<long>"
    summed = chosen.mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind)
    total: dict[str, np.ndarray] = {k: np.zeros(BUCKETS) for k in known}
    for r in summed.toArrow().to_pylist():  # one row a language
        total[r["lang"]] += r["counts"]
    names = sorted(total)
    p = np.stack([total[k] + 0.5 for k in names], axis=1)
    return names, p / p.sum(axis=0)


def mixture(like: np.ndarray, count: np.ndarray, start: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x columns) and log-likelihoods of mixtures of ``like``'s columns; a document's rows begin at ``start``.

    ``like`` has, for each of a document's trigrams, its probability in each column; ``count`` how often it is there. A
    document is done once no share moves by TOLERANCE, or after ``rounds``.
    """
    n = len(start)
    length = np.diff(np.append(start, len(count)))
    share = np.full((n, like.shape[1]), 1.0 / like.shape[1])
    live, x, c, at, left = np.arange(n), like, count, start, rounds
    while len(live) and left != 0:
        own, width = np.repeat(np.arange(len(live)), length[live]), np.add.reduceat(c, at)
        moved = np.full(len(live), np.inf)
        for _ in range(8 if left is None else min(8, left)):
            old = share[live]
            part = x * old[own]
            part *= (c / part.sum(axis=1))[:, None]
            share[live] = np.add.reduceat(part, at) / width[:, None]
            moved = np.abs(share[live] - old).max(axis=1)
        left = None if left is None else max(0, left - 8)
        open_ = moved >= TOLERANCE
        if not open_.all():  # what is done leaves
            keep = open_[own]
            x, c, live = x[keep], c[keep], live[open_]
            at = np.concatenate([[0], np.cumsum(length[live])[:-1]]).astype(np.int64) if len(live) else start[:0]
    return share, np.add.reduceat(np.log((like * np.repeat(share, length, axis=0)).sum(axis=1)) * count, start)


def infer(p: np.ndarray, place: np.ndarray, count: np.ndarray, start: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares (documents x languages) of the chosen sets; what is missing from 1 is the background's. ``start`` tells where each document's trigrams begin.

    No document may be without trigrams. Sets are nested: the language that explains most alone, then the others by
    their share in the mixture of all.
    """
    n, k = len(start), p.shape[1]
    length = np.diff(np.append(start, len(place)))
    like = np.column_stack([p[place], np.full(len(place), 1.0 / len(p))])
    cost = penalty * np.log(np.add.reduceat(count, start) + 1)
    alone = np.add.reduceat(np.log(like[:, :k]) * count[:, None], start)
    first = alone.argmax(axis=1)
    full = mixture(like, count, start, ROUNDS)[0][:, :k]
    full[np.arange(n), first] = 2
    order = np.argsort(-full, axis=1, kind="stable")
    best, score = np.zeros((n, k)), np.full(n, -np.inf)
    live = np.arange(n)
    for m in range(1, k + 1):
        keep = np.isin(np.repeat(np.arange(n), length), live)
        chosen = np.repeat(order[live, :m], length[live], axis=0)
        own = np.column_stack([np.take_along_axis(like[keep], chosen, axis=1), like[keep, k]])
        at = np.concatenate([[0], np.cumsum(length[live])[:-1]]).astype(np.int64)
        share, value = mixture(own, count[keep], at)
        value = value - m * cost[live]
        better = value > score[live]
        live, share = live[better], share[better]
        score[live] = value[better]
        best[live] = 0
        best[live[:, None], order[live, :m]] = share[:, :m]
        if not len(live):
            break
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` (the language of the largest share), ``score`` (that share of the text, from 0 to 1) and ``languages``.

    What no language explains better than chance counts for none, so a text in a language that was not learned has a low
    score. ``languages`` has the shares of the languages among themselves. ``und`` with score 0 if the text is null or has
    no letter, or nothing was learned. Rows keep all their columns but any of these names; repeated rows get the same
    answer. Only ``text`` is an input, and only texts go to Python.
    """
    names, p = model
    docs = docs.drop("lang_pred", "score", "languages")
    held = docs.sparkSession.sparkContext.broadcast((names, p))  # languages x 16384 numbers

    def answer(texts: list[str | None]):
        names, p = held.value
        out, own = [("und", 0.0, "")] * len(texts), []
        place, count, start, total = [], [], [], 0
        for i, text in enumerate(texts):
            c = np.bincount(places(text or ""), minlength=BUCKETS)
            nz = np.flatnonzero(c)
            if len(nz) and names:
                own.append(i)
                start.append(total)
                place.append(nz)
                count.append(c[nz])
                total += len(nz)
        if own:
            share = infer(p, np.concatenate(place), np.concatenate(count).astype(float), np.array(start))
            for i, row in zip(own, share, strict=True):
                order = [j for j in np.argsort(-row, kind="stable") if row[j] > 0]
                whole = sum(row[j] for j in order)
                out[i] = (names[order[0]], min(1.0, float(row[order[0]])), ",".join(f"{names[j]}:{row[j] / whole:.3f}" for j in order))
        return out

    @F.arrow_udf("struct<lang_pred:string,score:double,languages:string>")
    def predicted(texts: pa.Array) -> pa.Array:
        forget()
        found = []
        for a in range(0, len(texts), 128):  # the inference holds so many documents at a time
            found += answer(texts.slice(a, 128).to_pylist())
        give_back()
        parts = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))]
        return pa.StructArray.from_arrays(parts, names=["lang_pred", "score", "languages"])

    name = fresh(docs, "predicted")
    out = docs.withColumn(name, predicted(F.col("text")))
    return out.select(*docs.columns, f"{name}.lang_pred", f"{name}.score", f"{name}.languages")


def held_out():
    """Whether a row's label is kept for testing: from its doc_id alone; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "languages")
