"""Small tables with the awkward rows every operator must take."""

LONG = "lorem ipsum dolor " * 4000

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, slot int"


def awkward(spark, *more):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64, "x", 1),
        (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64, "x", 1),
        (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", 1), (4, " \n\t ", None, "b", 3, None, 2),
        (5, LONG, "de", None, len(LONG), "y", 3), (None, "no id here at all, none", "en", "b", 23, "y", None),
        (6, "one", "fr", "b", 3, "z", 1), *more]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
