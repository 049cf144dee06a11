"""Path and file-name functions. Paths use ``/``; a batch's paths are relative to its root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by extension, and names of the files the engine writes into batches itself.
PDF = (".pdf",)
LABEL_IMAGES = (".jpg", ".jpeg", ".png")
OCR_IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
SCAN_IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".gif", ".webp")
SIDECARS = ("__bates_records.json", "_redaction_audit.json", "_pipeline_report.json")


def ext(path: Column) -> Column:
    """Last suffix in lower case; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(filename(path), r"(?<=.)(\.[^.]+)$", 1))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    name = filename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def rel_dir(path: Column) -> Column:
    """Folder of a path, empty at the root."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def category(path: Column) -> Column:
    """Name of the folder a file is in, empty at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def norm_key(path: Column) -> Column:
    """Forward slashes, without any leading dots and slashes."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^[./]+", "")


def norm_rel_path(folder: Column, name: Column) -> Column:
    """Folder and name as one path; ``.`` and empty folders are the root."""
    bare = F.trim(F.replace(F.coalesce(folder, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(bare.isin("", "."), name).otherwise(F.concat_ws("/", bare, name))


def is_junk(path: Column) -> Column:
    """Leftovers of archive tools: ``/__MACOSX/`` below the root, ``._`` names, ``.DS_Store``."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = filename(p)
    return F.contains(p, F.lit("/__MACOSX/")) | F.startswith(name, F.lit("._")) | (F.lower(name) == ".ds_store")


def is_browser_junk(path: Column) -> Column:
    """The browser's rule: ``__MACOSX/`` in front, or ``.ds_store`` anywhere."""
    return F.startswith(path, F.lit("__MACOSX/")) | F.contains(F.lower(path), F.lit(".ds_store"))


def is_sidecar(path: Column, names=SIDECARS) -> Column:
    """One of the engine's own files at the root."""
    return norm_key(path).isin(*names)


def to_pdf_name(path: Column) -> Column:
    """The name an image has once it is a PDF."""
    return F.regexp_replace(path, r"\.[^./]+$", ".pdf")


def output_name(path: Column, suffix: str, extension: str) -> Column:
    """Stem, suffix, extension; ``output`` where there is no stem."""
    return F.concat(F.coalesce(F.nullif(stem(path), F.lit("")), F.lit("output")), F.lit(suffix), F.lit(extension))


def safe_zip_name(name: Column, fallback: str) -> Column:
    """A download name: runs of blanks to ``_``, only word characters, dots and dashes, ending in .zip."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", "_"), r"(?U)[^\w\-.]", "")
    bare = F.coalesce(F.nullif(F.regexp_replace(kept, r"^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))
    return F.when(F.endswith(F.lower(bare), F.lit(".zip")), bare).otherwise(F.concat(bare, F.lit(".zip")))


def natural_key(text: Column) -> Column:
    """Sortable key: runs of digits compare as numbers, other text in lower case.

    An array of (text, length of the number, digits) per pair of a text run and a digit run; numbers compare by
    their digits without leading zeros, shorter first, so any length works.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\D*)(\d*)"), F.lit(0))
    runs = F.filter(runs, lambda r: r != "")

    def part(r):
        digits = F.regexp_replace(F.regexp_extract(r, r"(\d*)$", 1), "^0+(?=.)", "")
        has = F.regexp_extract(r, r"(\d*)$", 1) != ""
        return F.struct(F.regexp_extract(r, r"^(\D*)", 1).alias("s"), F.when(has, F.length(digits)).otherwise(-1).alias("k"), digits.alias("n"))

    return F.transform(runs, part)


def walk_key(path: Column) -> Column:
    """Sortable key of the order of a walk: a folder's PDFs, its images, then its subfolders, each in natural order."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kind = F.when(ext(path).isin(*PDF), 0).otherwise(1)
    entry = lambda k, s: F.struct(k.alias("kind"), natural_key(s).alias("key"))
    return F.concat(F.transform(folders, lambda x: entry(F.lit(2), x)), F.array(entry(kind, filename(path))))
