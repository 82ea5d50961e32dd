import pytest


@pytest.fixture()
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, no newline or only newlines, and clashing names."""
    shared = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, f"{shared}\nThe END of it", "en", "a"), (2, f"intro line\n{shared}", "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, "\n\n", "fr", "b"),
        (6, "x" * 30_000, "en", "a"), (7, "mail me at a.b@c.de or +1 (555) 010-2000", None, "c"), (7, "mail me at a.b@c.de or +1 (555) 010-2000", None, "c"), (None, "der die das", "de", "c"),
        (None, None, None, None), (8, "Ünï ’s don't 日本語　😀 ١٢", "de", "b"), (9, f"{shared}\nThe END of it", "en", "c"), (10, "word " * 4000, "en", "a"),
    ]
    extra = "1L size, 'x' key, 2 n, 'p' path, 3 part, 'c' chunk, 'd' doc, 'g' gone, 1 copies, 'r' rate, 'q' score, 'h' held_out, true rejected, 'z' lang_pred, 7 n_lines, 'k' kind"
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *extra.split(", "))


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
