"""Batches of files: archives to members, and lists that come with a batch."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import paths as P
from paperloom.operators.storage import shared_dir, written

RECORDS = "array<struct<path:string,rel_dir:string,filename:string,first_label:string,last_label:string,pages:int,category:string>>"
METADATA = "array<struct<name:string,path:string,fullPath:string,batesRange:string>>"
MEMBERS = "batch_id string, archive string, ord long, path string, size_bytes long, content binary, error string"


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, content) of the archives below a folder. A row holds an archive, so 2 GB is the most."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def expand(archives: DataFrame, on_bad: str = "row", allowed: tuple[str, ...] | None = None, with_content: bool = True) -> DataFrame:
    """Members of archives in order, without folders, junk, and kinds that are not ``allowed``.

    ``archives``: archive, content; files that are no ZIP by name pass as they are. A bad archive is a row with
    an error, or with ``on_bad='fail'`` an error of the job.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for archive, content in zip(pdf["archive"], pdf["content"], strict=True):
                row = lambda k, p, n, c=None, e=None, a=archive: (a, a, k, p, n, c, e)
                if not archive.lower().endswith(".zip"):
                    out.append(row(0, archive, len(content), content if with_content else None))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for k, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                            out.append(row(k, m.filename, m.file_size, z.read(m) if with_content else None))
                except zipfile.BadZipFile:
                    if on_bad == "fail":
                        raise
                    out.append(row(0, archive, len(content), None, BAD_ARCHIVE))
            yield pd.DataFrame(out, columns=["batch_id", "archive", "ord", "path", "size_bytes", "content", "error"])

    rows = archives.select("archive", "content").mapInPandas(members, MEMBERS).where(~P.is_junk(F.col("path")))
    return rows if allowed is None else rows.where(P.ext(F.col("path")).isin(*allowed) | F.col("error").isNotNull())


#: Archives inside of archives are opened so many times; what is deeper is a failure.
DEEPEST = 8
PACKED = "batch_id string, within string, place array<long>, path string, size_bytes long, method int, crc long, raw binary, error string"
#: Bytes of members that a batch on its way to Spark holds, if more than one member is in it.
BATCH_BYTES = 1 << 22
# Reasons of failures, as users of the job expect them.
BAD_ARCHIVE = "Not a valid ZIP file"


def _packed(archives: DataFrame) -> DataFrame:
    """Members as they are stored, from (batch_id, within, place, path, content): the central directory cuts an archive, nothing is unpacked."""
    import struct

    names = [f.split()[0] for f in PACKED.split(", ")]

    def members(batch_id, within, place, path, content):
        inner = path if within is None else f"{within}!{path}"
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for k, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                    head = content[m.header_offset : m.header_offset + 30]
                    if len(head) < 30 or head[:4] != b"PK\x03\x04":
                        raise zipfile.BadZipFile
                    start = m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))
                    locked = "Encrypted archive member" if m.flag_bits & 1 else None
                    yield batch_id, inner, [*place, k], m.filename, m.file_size, m.compress_type, m.CRC, content[start : start + m.compress_size], locked
        except (zipfile.BadZipFile, struct.error, ValueError, UnicodeDecodeError):
            yield batch_id, within, place, path, len(content), None, None, None, BAD_ARCHIVE

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for row in pdf.itertuples(index=False):
                for member in members(row.batch_id, row.within, list(row.place), row.path, row.content):
                    out.append(member)
                    size += len(member[7] or b"")
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return archives.select("batch_id", "within", "place", "path", "content").mapInPandas(cut, PACKED)


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of members with ``content`` and ``error`` in place of what is stored, each cut so that it holds ``BATCH_BYTES`` of contents, or one member: few stored bytes may be many."""
    import zlib

    def unpack(method: float, crc: float, raw, error):
        if error or pd.isna(method):
            return None, error
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return None, "Unsupported compression"
        try:
            content = raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
        except zlib.error:
            return None, "Damaged archive member"
        return (content, None) if zlib.crc32(content) == int(crc) else (None, "Damaged archive member")

    for pdf in batches:
        kept = pdf.drop(columns=["method", "crc", "raw", "error"])
        start, size, found = 0, 0, []
        for i, stored in enumerate(zip(pdf["method"], pdf["crc"], pdf["raw"], pdf["error"], strict=True)):
            found.append(unpack(*stored))
            size += len(found[-1][0] or b"")
            if size >= BATCH_BYTES or i == len(pdf) - 1:
                yield kept.iloc[start : i + 1].assign(content=[c for c, _ in found], error=[e for _, e in found])
                start, size, found = i + 1, 0, []


def _unpacked(packed: DataFrame) -> DataFrame:
    """``content`` and ``error`` of members that ``_packed`` cut; a member that does not fit its checksum is an error."""
    return packed.mapInPandas(unpacked, "batch_id string, within string, place array<long>, path string, size_bytes long, content binary, error string")


def expand_all(archives: DataFrame, allowed: tuple[str, ...] | None = None, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(members, failures) of archives and all archives in them; what goes wrong is a failure of its file alone.

    ``archives``: archive, content, and batch_id if a batch has several. Files that are no ZIP by name pass as they are. members: batch_id, within (the archives
    around it, outermost first, parted by ``!``; null for a file by itself), place (its place in each), path, size_bytes, content; without folders, junk, and kinds
    not ``allowed``. failures: batch_id, path, stage, reason. A directory is read in one task, members are then dealt to all tasks and unpacked, level by level; a
    row holds at most 2 GB. Null content is an archive that is none. No archives give empty tables.
    """
    spark = archives.sparkSession
    shared_dir(spark)  # sets the size of batches for Python, from the first job on
    batch = F.col("batch_id") if "batch_id" in archives.columns else F.col("archive")
    level = archives.select(batch.alias("batch_id"), F.lit(None).cast("string").alias("within"), F.array().cast("array<long>").alias("place"), F.col("archive").alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.coalesce("content", F.lit("").cast("binary")).alias("content"), F.lit(None).cast("string").alias("error"))
    zipped = F.lower("path").endswith(".zip") & F.col("error").isNull()
    kept, failed = [], []
    for depth in range(deepest + 1):
        files = level.where(~zipped & ~P.is_junk(F.col("path")))
        wanted = F.lit(True) if allowed is None else P.ext(F.col("path")).isin(*allowed)
        kept.append(files.where(F.col("error").isNull() & wanted).drop("error"))
        failed.append(files.where(F.col("error").isNotNull()).select("batch_id", "path", F.col("error").alias("reason")))
        inner = level.where(zipped & ~P.is_junk(F.col("path")))
        if depth == deepest:
            failed.append(inner.select("batch_id", "path", F.lit("Too many archives inside of each other").alias("reason")))
        elif inner.limit(1).count() == 0:
            break
        else:
            width = int(spark.conf.get("spark.sql.shuffle.partitions"))
            level = written(_unpacked(_packed(inner).repartition(width, "batch_id", "within", "place")), "members")
    members, failures = kept[0], failed[0]
    for a in kept[1:]:
        members = members.unionByName(a)
    for b in failed[1:]:
        failures = failures.unionByName(b)
    return members, failures.select("batch_id", "path", F.lit("intake").alias("stage"), "reason")


def json_list(text: Column, kind: str) -> Column:
    """A JSON text as an array of structs; null if it is not a list."""
    return F.when(F.json_array_length(text).isNotNull(), F.from_json(text, kind))


def sidecar_records(members: DataFrame, anywhere: bool = False) -> DataFrame:
    """Records of a batch's label sidecar (batch_id, ord, path, content as text).

    At the root the last sidecar counts; with ``anywhere``, the first one in any folder that is a list.
    """
    name = P.SIDECARS[0]
    at = P.filename(P.norm_key(F.col("path"))) == name if anywhere else P.norm_key(F.col("path")) == name
    rows = members.where(at).withColumn("_records", json_list(F.col("content").cast("string"), RECORDS))
    if anywhere:
        chosen = rows.where("_records is not null").groupBy("batch_id").agg(F.min_by("_records", "ord").alias("_records"))
    else:
        chosen = rows.groupBy("batch_id").agg(F.max_by(F.struct("_records"), "ord").alias("r")).select("batch_id", "r._records")
    return chosen.select("batch_id", F.posexplode("_records").alias("ord", "r")).select("batch_id", "ord", "r.*")


def client_metadata(texts: DataFrame) -> DataFrame:
    """(batch_id, ord, name, path, bates_range) of metadata a client sends as JSON (batch_id, text)."""
    rows = texts.select("batch_id", F.posexplode(json_list(F.col("text"), METADATA)).alias("ord", "r"))
    path = F.coalesce(F.nullif(F.col("r.path"), F.lit("")), F.nullif(F.col("r.fullPath"), F.lit("")))
    return rows.select("batch_id", "ord", F.col("r.name").alias("name"), path.alias("path"), F.col("r.batesRange").alias("bates_range"))


def password_map(text: Column) -> Column:
    """A JSON map of passwords without blank ones; null for bad JSON."""
    return F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: F.trim(v) != "")


def read_password_list(spark: SparkSession, path: str) -> DataFrame:
    """(filename, password) of a CSV with a header: columns by those names, else the first two."""
    df = spark.read.option("header", True).csv(path)
    by_name = {c.strip().lower(): c for c in df.columns}
    a, b = (by_name["filename"], by_name["password"]) if {"filename", "password"} <= by_name.keys() else df.columns[:2]
    return df.select(F.trim(F.col(f"`{a}`")).alias("filename"), F.trim(F.col(f"`{b}`")).alias("password")).where("filename <> '' and password is not null")
