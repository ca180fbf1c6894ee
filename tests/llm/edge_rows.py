"""Rows that every operator must take."""

LONG = "alpha beta gamma delta epsilon " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n int, label int, key string, slot int, node int, root string, line int, n_lines string"
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 10, "x", 1, None, "k", 1, 1, "r", 1, "l"),
    (1, "one two three four five six seven eight nine ten", "en", "a", 10, "x", 1, None, "k", 1, 1, "r", 1, "l"),
    (2, "one two three four five six seven eight nine ten", None, None, None, None, None, None, None, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None, None, None, None, None),
    (4, "", "", "", 0, "", 0, 0, "", 0, 0, "", 0, ""),
    (5, " \n\t ", "en", "b", 4, "", 0, 0, "", 0, 0, "", 0, ""),
    (6, "…☃ 日本語 12 !!", "en", "b", 4, "", 0, 0, "", 0, 0, "", 0, ""),
    (None, "one two three four five six seven eight nine ten", "en", "b", 4, "", 0, 0, "", 0, 0, "", 0, ""),
    (None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    (7, LONG, "en", "b", len(LONG), "", 0, 0, "", 0, 0, "", 0, ""),
    (8, LONG + "zeta", "en", "b", len(LONG), "", 0, 0, "", 0, 0, "", 0, ""),
]


def edge_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
