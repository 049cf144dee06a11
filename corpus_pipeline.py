"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import language, line_dedup, mixing, near_dedup, packing
from paperloom.llm.common import discard, fresh, table, written

#: A document is rejected if its largest language has less than this share of what is in any language, or less than
#: MIN_SCORE of all of it; so is one without letters.
MIN_SHARE, MIN_SCORE = 0.5, 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one main language; null texts, texts without letters, balanced mixtures and unknown languages go."""
    names = {c: fresh(docs, c) for c in docs.columns if c.lower() in ("lang_pred", "score", "languages")}
    out = language.identify(docs.withColumnsRenamed(names), language.fit(docs.select("text", "lang")))
    share = F.regexp_extract("languages", ":([0-9.]+)", 1).try_cast("double")  # of the largest one, which is the first
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE) & (share >= MIN_SHARE))
    return out.drop("lang_pred", "score", "languages").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text.

    A group of near-duplicates counts as one page of a source, or its copies would make its own lines boilerplate.
    """
    found = near_dedup.near_duplicates(docs)
    copies = found.where("doc_id is not null and component_id <> doc_id")
    family = written(copies.groupBy("doc_id").agg(F.min("component_id").alias("family")), "families")
    discard(*found.scratch)
    names = {c: fresh(docs, c) for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    out = line_dedup.drop_boilerplate(docs.withColumnsRenamed(names), family=family)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    out = out.withColumn("n_chars", n_chars) if "n_chars" in docs.columns else out
    return out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; rows of a doc_id stay together."""
    name = fresh(docs, "kept_id")
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: from never to three times."""
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each with its sequence and its place there. Workers keep few words: they hold token ids as well."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, keep=60_000))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the mixture model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            if k:
                discard(last)
    return docs
