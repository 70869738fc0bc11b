"""Documents with every awkward case, for all operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra}"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


def odd_documents(spark, extra="spans string, n_words string, score string, fp string, items string, pii string"):
    """Null in every column, empty, blank and very long texts, exact repeats
    of a row, one id with two texts, and columns that clash with results."""
    n = extra.count(",") + 1
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n ", "fr", "b", 4),
        (5, LONG, "en", "a", len(LONG)),
        (6, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (6, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (7, "1234 ... !!! 5", "de", "c", 14),
        (7, "être où l'été naît ça et là 漢字 😀", "fr", "c", 30),
        (None, "a text without an id but with some words in it", "en", None, 46),
    ]
    data = [r + tuple("x" for _ in range(n)) for r in rows]
    return spark.createDataFrame(data, SCHEMA.format(extra=extra))


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA.format(extra="spans string"))
