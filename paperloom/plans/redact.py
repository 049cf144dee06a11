"""Sensitive content: hits with context guards, masked text, audit counts, numbers split over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import labels as L
from paperloom.functions import paths as P
from paperloom.functions.matching import covered, find_all, find_all_custom, loose, near, search_variants, whole_words_custom, without_last_digits
from paperloom.functions.patterns import SSN_CONTEXT, Pattern, java
from paperloom.operators.numbering import running_before

#: Literals longer than this without blanks are counted, but not masked.
LONGEST_LITERAL = 60


PAGE = ["batch_id", "path", "page_no"]
# Fixed value: the name of numbers that are split over words.
SPLIT = "OCR_SSN_SPLIT"


def _readable() -> Column:
    return P.ext(F.col("path")).isin(*P.PDF, *P.LABEL_IMAGES)


def _guarded(pages: DataFrame, patterns: list[Pattern], require_context: bool) -> tuple[DataFrame, list[Column]]:
    """``pages`` with a column for each condition that patterns share, and for each pattern whether a page may have it."""
    needs = [{p.needs} | ({java(loose(p.context))} if p.context and require_context else set()) for p in patterns]
    names = {n: f"_may{k}" for k, n in enumerate(sorted({n for each in needs for n in each if n}))}
    pages = pages.withColumns({c: F.coalesce(F.col("text").rlike(n), F.lit(False)) for n, c in names.items()}) if names else pages
    fits = []
    for each in needs:
        one = F.lit(True)
        for n in sorted(n for n in each if n):
            one = one & F.col(names[n])
        fits.append(one)
    return pages, fits


_HIT = "array<struct<pattern_no:int,pattern:string,start:int,matched:string>>"


def _text_hits(patterns: list[Pattern], fits: list[Column], require_context: bool) -> Column:
    """Array of the matches of all patterns in ``text``, in the order of patterns, then places."""
    per = []
    for k, (p, may) in enumerate(zip(patterns, fits, strict=True)):
        found = find_all(F.col("text"), java(p.regex, p.case_sensitive)) if p.native else find_all_custom(p.regex, p.case_sensitive)(F.col("text"))
        if not p.native:  # a preset's match is never blank
            found = F.filter(found, lambda m: F.trim(F.regexp_replace(m["text"], r"(?U)\s+", " ")) != "")
        if p.context and require_context:
            found = F.filter(found, lambda m: near(F.col("text"), m["start"], m["end"], java(p.context)))
        rows = F.transform(found, lambda m: F.struct(F.lit(k).alias("pattern_no"), F.lit(p.regex).alias("pattern"), m["start"].alias("start"), m["text"].alias("matched")))
        per.append(F.when(may, rows).otherwise(F.array().cast(_HIT)))
    return F.concat(*per)


def _exploded(rows: DataFrame) -> DataFrame:
    """Rows with a ``hit`` of an outer explode. Before an inner one the optimizer puts a filter that works the hits out once more."""
    return rows.where(F.col("hit").isNotNull()).select(*PAGE, "hit.*")


def hits(pages: DataFrame, patterns: list[Pattern], require_context: bool = True, keep_last: int = 0) -> DataFrame:
    """``pages`` (batch_id, path, page_no, text) to one row a match: pattern_no, pattern, start, matched, literal, partial.

    Only PDFs and JPEG or PNG images are read; other kinds are no part of a redaction.
    All patterns are looked for in one pass over a page, those first that cannot be there ruled out by what they need.
    Overlapping patterns each count. With ``keep_last``,
    ``literal`` is the part before that many digits, if any, and ``partial`` says so. Null text has no hits.
    """
    pages, fits = _guarded(pages.where(_readable()).select(*PAGE, "text"), patterns, require_context)
    out = _exploded(pages.withColumn("hit", F.explode_outer(_text_hits(patterns, fits, require_context))))
    head = without_last_digits(F.col("matched"), keep_last) if keep_last > 0 else F.lit("")
    return out.withColumn("partial", head != "").withColumn("literal", F.when(head != "", head).otherwise(F.col("matched")))


def findings(pages: DataFrame, words: DataFrame, patterns: list[Pattern], require_context: bool = True, keep_last: int = 0) -> DataFrame:
    """Hits of a batch whose pages have a text of their own or only recognized words, in one table.

    ``pages``: batch_id, path, page_no, text; ``words``: batch_id, path, page_no, word_idx, text, and boxes as for ``split_numbers`` if there are any.
    A PDF's page with more than blanks in its text is read by ``hits``, its words are ignored. Any other page, images and pages without a row
    included, is read by its words: those a pattern matches as a whole, and numbers split over five words. A page is met once with
    its words and read one way. Kinds that a redaction does not read have no hits; nor have pages with neither text nor words.

    A row a hit: ``source`` (text, words), ``seq`` (its place among the page's hits), pattern_no (null for split numbers), pattern, start (in a text),
    word_idx and n_words (of the words), matched, literal, partial, share (of the box to cover), x0, y0, x1, y1 (in points, if words have boxes).
    """
    met = pages.where(_readable()).select(*PAGE, "text").join(words_of_pages(words.where(_readable())).hint("merge"), PAGE, "full")
    return hit_rows(with_hits(met, patterns, require_context, keep_last), keep_last)


def words_of_pages(words: DataFrame) -> DataFrame:
    """(batch_id, path, page_no, words): the words of each page in order, as ``with_hits`` takes them."""
    edges = ("xmin", "ymin", "xmax", "ymax", "page_width", "page_height")
    boxed = all(c in words.columns for c in edges)
    number = lambda c: F.col(c).cast("double") if boxed else F.lit(None).cast("double")
    x, y = (lambda c: number(c) * number("page_width")), (lambda c: number(c) * number("page_height"))
    word = F.struct(F.col("word_idx").cast("int").alias("i"), F.col("text").alias("t"), x("xmin").alias("x0"), y("ymin").alias("y0"), x("xmax").alias("x1"), y("ymax").alias("y1"))
    return words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("words"))


def with_hits(pages: DataFrame, patterns: list[Pattern], require_context: bool = True, keep_last: int = 0) -> DataFrame:
    """``pages`` (batch_id, path, page_no, text, words) with ``hits``, an array for ``hit_rows``, null or empty without any; a row is worked on by itself."""
    own = F.when(P.ext(F.col("path")).isin(*P.PDF) & F.col("text").rlike(r"(?U)\S"), F.col("text"))
    met = pages.withColumn("_given", F.col("text")).withColumn("text", own)
    met = met.withColumn("_words", F.when(F.col("text").isNull() & _readable(), F.col("words"))).withColumn("_texts", F.transform("_words", lambda w: F.coalesce(w["t"], F.lit(""))))
    met, fits = _guarded(met, patterns, require_context)

    size = F.size("_words")
    # Places of the words that any preset matches as a whole; most words are none of them.
    presets = [java(p.regex, p.case_sensitive) for p in patterns if p.native]
    whole_word = lambda i, regexes: F.get("_texts", i).rlike(rf"\A(?:{'|'.join(f'(?:{r})' for r in regexes)})\z")
    if presets:
        met = met.withColumn("_likely", F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: (F.get("_texts", i) != "") & whole_word(i, presets))))
    around = lambda i: F.array_join(F.filter(F.slice("_texts", F.greatest(i - 6, F.lit(0)) + 1, i + 7 - F.greatest(i - 6, F.lit(0))), lambda t: t != ""), " ")
    at = lambda i: F.get("_words", i)
    nothing = {"start": "int", "word_idx": "int", "n_words": "int", "x0": "double", "y0": "double", "x1": "double", "y1": "double"}
    shape = lambda **c: F.struct(*[c.get(n, F.lit(None)).cast(k).alias(n) for n, k in ({"source": "string", "a": "int", "b": "int", "pattern_no": "int", "pattern": "string", "matched": "string", "share": "double"} | nothing).items()])

    digits = lambda t: F.char_length(F.regexp_replace(t, r"(?U)\D", ""))

    def word_hit(k: int, p: Pattern):
        def hit(i):
            share = F.when((F.lit(keep_last) > 0) & (digits(at(i)["t"]) > keep_last), (digits(at(i)["t"]) - keep_last) / digits(at(i)["t"])).otherwise(F.lit(1.0))
            return shape(
                source=F.lit("words"), a=i, b=F.lit(k), pattern_no=F.lit(k), pattern=F.lit(p.regex), matched=at(i)["t"], share=share, word_idx=at(i)["i"], n_words=F.lit(1),
                x0=at(i)["x0"], y0=at(i)["y0"], x1=at(i)["x0"] + (at(i)["x1"] - at(i)["x0"]) * share, y1=at(i)["y1"],
            )

        return hit

    per = []
    for k, p in enumerate(patterns):
        if p.native:
            whole = F.filter("_likely", lambda i: whole_word(i, [java(p.regex, p.case_sensitive)]))
        else:
            whole = whole_words_custom(p.regex, p.case_sensitive)(F.col("_texts"))
        if p.context and require_context:
            whole = F.filter(whole, lambda i: around(i).rlike(java(p.context)))

        per.append(F.transform(whole, word_hit(k, p)))
    full = lambda i, pattern: F.get("_texts", i).rlike(rf"(?U)\A{pattern}\z")
    splits = F.filter(F.sequence(F.lit(0), size - 5), lambda i: (F.char_length(F.get("_texts", i)) == 3) & full(i, r"\d{3}") & full(i + 2, r"\d{2}") & full(i + 4, r"\d{4}") & full(i + 1, r"\D*") & full(i + 3, r"\D*"))
    if require_context:
        splits = F.filter(splits, lambda i: around(i + 2).rlike(java(SSN_CONTEXT)))

    def split(i):
        every = lambda c, pick: pick(*[at(i + j)[c] for j in range(5)])
        text = F.concat_ws("-", at(i)["t"], at(i + 2)["t"], at(i + 4)["t"])
        box = {"x0": every("x0", F.least), "y0": every("y0", F.least), "x1": every("x1", F.greatest), "y1": every("y1", F.greatest)}
        return shape(source=F.lit("words"), a=size, b=i, pattern=F.lit(SPLIT), matched=text, share=F.lit(1.0), word_idx=at(i)["i"], n_words=F.lit(5), **box)

    of_words = F.concat(*[F.when(size > 0, x) for x in per], F.when(size >= 5, F.transform(splits, split)).otherwise(F.array()))
    of_text = F.transform(_text_hits(patterns, fits, require_context), lambda h: shape(source=F.lit("text"), a=h["pattern_no"], b=h["start"], share=F.lit(1.0), **{c: h[c] for c in ("pattern_no", "pattern", "matched", "start")}))
    out = met.withColumn("hits", F.when(F.col("text").isNotNull(), of_text).when(size > 0, of_words))
    return out.select(*[c for c in pages.columns if c != "text"], F.col("_given").alias("text"), "hits")


def hit_rows(pages: DataFrame, keep_last: int = 0) -> DataFrame:
    """The hits of ``with_hits``, for the same ``keep_last``, a row each, as ``findings`` gives them."""
    out = _exploded(pages.select(*PAGE, F.explode_outer("hits").alias("hit")))
    head = without_last_digits(F.col("matched"), keep_last) if keep_last > 0 else F.lit("")
    head = F.when(F.col("source") == "text", head).otherwise("")
    out = out.withColumn("seq", F.struct("a", "b")).withColumn("partial", (head != "") | (F.col("share") < 1)).withColumn("literal", F.when(head != "", head).otherwise(F.col("matched")))
    return out.select(*PAGE, "source", "seq", "pattern_no", "pattern", "start", "word_idx", "n_words", "matched", "literal", "partial", "share", "x0", "y0", "x1", "y1")


def audit(found: DataFrame) -> DataFrame:
    """Counts by file, page and pattern; never the matched text."""
    return found.groupBy("batch_id", F.col("path").alias("file"), F.col("page_no").alias("page"), "pattern").agg(F.count(F.lit(1)).alias("match_count"))


def hits_by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("batch_id", "path").agg(F.count(F.lit(1)).alias("hits"))


def audit_in_order(found: DataFrame, files: DataFrame) -> DataFrame:
    """The audit of ``findings`` with ``place``, from 0 in each batch: entries in the order in which hits are first met.

    ``files`` (batch_id, path, ord) gives the order of files; hits of files that are not there are left out. Within a file pages go
    by number, and entries of a page by the first of their hits.
    """
    rows = found.groupBy("batch_id", "path", "page_no", "pattern").agg(F.count(F.lit(1)).alias("match_count"), F.min("seq").alias("_seq"))
    rows = rows.join(files.select("batch_id", "path", "ord").hint("merge"), ["batch_id", "path"]).withColumn("_one", F.lit(1))
    out = running_before(rows, "_one", ["ord", "path", "page_no", "_seq", "pattern"], ["batch_id"], "place")
    return out.select("batch_id", "place", F.col("path").alias("file"), F.col("page_no").alias("page"), "pattern", "match_count")


def review(found: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(batch_id, total_files, files_with_hits, total_hits, bates_range) to review before a batch is finished; ``hits_by_file`` has the files.

    ``ranges``: batch_id, first_bates, last_bates of the run's labels; no label leaves an empty range. Batches without hits have 0.
    """
    total = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_files"))
    hit = hits_by_file(found).groupBy("batch_id").agg(F.count(F.lit(1)).alias("files_with_hits"), F.sum("hits").alias("total_hits"))
    out = total.join(hit.hint("merge"), "batch_id", "left").join(ranges.hint("merge"), "batch_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("batch_id", "total_files", zero("files_with_hits"), zero("total_hits"), L.bates_range(F.coalesce("first_bates", F.lit("")), F.coalesce("last_bates", F.lit(""))).alias("bates_range"))


def masked(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with ``redacted``: every literal's first spelling that is on the page, masked wherever it is there.

    The case of letters is ignored; places that overlap are all masked. A page is read once, however many literals it has.
    """
    literals = found.where(F.length(F.regexp_replace("literal", r"(?U)\s+", "")) <= LONGEST_LITERAL)
    per = literals.groupBy(*PAGE).agg(F.collect_set("literal").alias("_literals"))
    met = pages.join(per.hint("merge"), PAGE, "left")
    return met.withColumn("redacted", covered_page(F.col("_literals"))).drop("_literals")


def literals_of(hits: Column, keep_last: int = 0) -> Column:
    """The literals to cover of an array of hits by text; null without any."""
    head = lambda h: without_last_digits(h["matched"], keep_last) if keep_last > 0 else F.lit("")
    own = F.transform(F.filter(hits, lambda h: h["source"] == "text"), lambda h: F.when(head(h) != "", head(h)).otherwise(h["matched"]))
    few = F.array_distinct(F.filter(own, lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", "")) <= LONGEST_LITERAL))
    return F.when(F.size(few) > 0, few)


def covered_page(literals: Column) -> Column:
    """``text`` with the literals of an array covered; a page without any does not go to Python."""
    some = F.when(literals.isNotNull(), F.col("text"))
    return F.coalesce(covered(some, F.transform(literals, search_variants)), F.col("text"))


def split_numbers(words: DataFrame, require_context: bool = True) -> DataFrame:
    """Numbers of 3, 2 and 4 digits over five words in a row, from (batch_id, path, page_no, word_idx, text).

    With ``require_context`` a context word must be within six words of the third one. A page's words are one
    group of bounded size. Words with boxes (xmin, ymin, xmax, ymax as shares of page_width and page_height) also give
    the box around the five, in points.
    """
    page = Window.partitionBy("batch_id", "path", "page_no").orderBy("word_idx")
    w = {0: F.col("text"), **{k: F.lead("text", k).over(page) for k in range(1, 5)}}
    snippet = F.array_join(F.collect_list(F.nullif(F.col("text"), F.lit(""))).over(page.rowsBetween(-6, 6)), " ")
    edges = {"x0": ("xmin", "page_width", F.least), "y0": ("ymin", "page_height", F.least), "x1": ("xmax", "page_width", F.greatest), "y1": ("ymax", "page_height", F.greatest)}
    boxed = all(c in words.columns for e in edges.values() for c in e[:2])
    if boxed:
        words = words.withColumns({k: (point := F.col(c) * F.col(size), pick(point, *[F.lead(point, j).over(page) for j in range(1, 5)]))[1] for k, (c, size, pick) in edges.items()})
    rows = words.withColumn("_snippet", snippet).withColumn("_snippet", F.lead("_snippet", 2).over(page)).withColumns({f"_w{k}": c for k, c in w.items()})
    full = lambda k, p: F.coalesce(F.col(f"_w{k}"), F.lit("")).rlike(f"(?U)^{p}$")
    there = F.lead("word_idx", 4).over(page).isNotNull()
    rows = rows.withColumn("_there", there).where(full(0, r"\d{3}") & full(1, r"\D*") & full(2, r"\d{2}") & full(3, r"\D*") & full(4, r"\d{4}") & F.col("_there"))
    if require_context:
        rows = rows.where(F.col("_snippet").rlike(java(SSN_CONTEXT)))
    return rows.select("batch_id", "path", "page_no", "word_idx", F.lit(SPLIT).alias("pattern"), F.concat_ws("-", "_w0", "_w2", "_w4").alias("matched"), *(edges if boxed else ()))


def word_hits(words: DataFrame, patterns: list[Pattern], require_context: bool = True, keep_last: int = 0) -> DataFrame:
    """Words that a preset pattern matches as a whole, with the share of the box to cover.

    ``share`` is 1, or with ``keep_last`` the part of the digits before the last ones.
    """
    page = Window.partitionBy("batch_id", "path", "page_no").orderBy("word_idx").rowsBetween(-6, 6)
    snippet = F.array_join(F.collect_list(F.nullif(F.col("text"), F.lit(""))).over(page), " ")
    rows = words.withColumn("_snippet", snippet).where("text <> ''")
    tests = []
    for k, p in enumerate(patterns):
        fits = F.col("text").rlike(f"^(?:{java(p.regex, p.case_sensitive)})$")
        if p.context and require_context:
            fits = fits & F.col("_snippet").rlike(java(p.context))
        tests.append(F.when(fits, F.struct(F.lit(k).alias("pattern_no"), F.lit(p.regex).alias("pattern"))))
    rows = rows.withColumn("hit", F.explode(F.filter(F.array(*tests), lambda h: h.isNotNull())))
    digits = F.length(F.regexp_replace("text", r"(?U)\D", ""))
    share = F.when((F.lit(keep_last) > 0) & (digits > keep_last), (digits - keep_last) / digits).otherwise(1.0)
    return rows.select("batch_id", "path", "page_no", "word_idx", "hit.*", F.col("text").alias("matched"), share.alias("share"))
