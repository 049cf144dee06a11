"""Token-id output: texts to ids, ids to files of range-coded blocks, files back to ids.

Documents are dealt by ranges of ``doc_id`` and sorted, so that files in the order of
(part, file) hold ascending documents. A task codes its documents in files of about
``FILE_TOKENS`` tokens, whose table covers all of the file's tokens; a file is a row of a table that
Spark writes, so a lost executor's files are written anew and none is half there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import ans
from paperloom.llm.common import partitions, table, written
from paperloom.llm.tokens import vocabulary

FILE_TOKENS = 1 << 21
END = 2


def write_files(docs: DataFrame, vocabulary_path: str, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Table of files ``part int, file int, n_docs long, n_tokens long, body binary`` for the whole texts of ``docs``.

    Null and empty texts are the end id alone. Repeated rows are written each, in order of document, then
    text. A null ``doc_id`` comes first and is read back as null. A very long text makes a large file.
    """
    width = partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        v = vocabulary(vocabulary_path)
        tail = np.array([end], v.dtype).tobytes()
        ids, texts, held = [], [], 0

        def flush():
            nonlocal ids, texts, held, k
            tokens = np.frombuffer(b"".join(texts), v.dtype).astype(np.uint32)
            body = ans.encode_file(ids, [len(x) // v.dtype.itemsize for x in texts], tokens)
            row = pa.RecordBatch.from_pylist([{"part": part, "file": k, "n_docs": len(ids), "n_tokens": len(tokens), "body": body}], schema=FILES)
            ids, texts, held, k = [], [], 0, k + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.encode(text.as_py()) + tail
                ids.append(doc_id)
                texts.append(x)
                held += len(x) // v.dtype.itemsize
                if held >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    return written(rows.mapInArrow(encode, "part int, file int, n_docs long, n_tokens long, body binary"), "token-files", "none")


FILES = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])


def read_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` (array), from the files' bytes."""
    schema = "part int, file int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches):
        for batch in batches:
            for part, file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                f = ans.File(body.as_py())
                tokens, n = f.tokens().astype("<u4"), len(f.doc_ids)
                stop = np.cumsum(f.counts)
                start = stop - f.counts
                raw = memoryview(tokens).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                out = {"part": pa.array([part] * n, pa.int32()), "file": pa.array([file] * n, pa.int32()), "doc_id": pa.array(f.doc_ids, pa.int64()), "start_in_file": pa.array(start), "n_tokens": pa.array(f.counts), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(start, stop[-1:]).astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    docs = files.select("part", "file", "body").mapInArrow(decode, schema)
    # Tokens before a file: all of the parts before its own, and the files of its part before it.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.withColumn("before_part", F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens"))
    heads = files.select("part", "file", "n_tokens").withColumn("before_file", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens"))
    heads = heads.join(parts.hint("merge"), "part").select("part", "file", (F.col("before_part") + F.col("before_file")).alias("before"))
    out = docs.join(heads.hint("merge"), ["part", "file"]).withColumn("start", F.col("before") + F.col("start_in_file"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_files(write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
