import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, score double, size long, h1 string, ids string, sequence_id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that can be odd, and extra columns named like columns the operators use."""
    words = [f"word{i} the" for i in range(400)]
    long_ = " ".join(f"w{i}" for i in range(60_000))
    text = " ".join(words)
    near = text.replace("word7 ", "changed ")
    rows = [
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", "a"), (3, near, "en", "b"), (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n ", "fr", None),
        (7, long_, "en", "a"), (8, "one", None, None), (9, "### $$$", "xx", "b"), (None, "null id " + text[:300], "en", "b"), (10, "été über ñandú \U0001f600 <|endoftext|>", "fr", "b"),
        (11, "x\ny\nx\n\nx", "en", "a"), (12, "same line\nx\nown 1", "en", "s"), (13, "same line\nown 2", "en", "s"), (14, "same line\nown 3", "en", "s"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "h", 1.0, 2, "k", "i", "q") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
