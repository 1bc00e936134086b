import pytest

#: Texts that every operator must take: null, empty, blank, short, one long word, many lines, other scripts, emoji, repeats.
ODD = [None, "", "   \n\t ", "a", "x" * 5000, "one two three", "Wörter über Straße ñandú", "日本語のテキスト 😀 emoji", "\n".join(["same line again"] * 40), "word " * 3000, "nul\x00byte and \r\n ends"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null, negative and repeated ids, columns whose names clash with results, and rows that repeat."""
    rows = [(k - 2, t, "en" if k % 3 else None, None, k, 0.5, 7, "z") for k, t in enumerate(ODD)]
    rows += [(None, "a text without an id", None, None, None, None, None, None), rows[5], rows[5], (100, "one two three", "fr", "s", 1, 1.0, 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
