import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, an extra column with clashing names."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [
        (1, same, "en", "a", 1), (1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same, "en", None, None), (3, None, None, None, None),
        (4, "", "en", "a", 0), (None, same, "en", "b", 5), (None, None, None, None, None), (5, long_text, "de", "b", 9),
        (6, " \t\n ", "en", "b", 4), (7, "one", "en", "b", 3), (8, "один два три четыре", "ru", "c", 3), (9, long_text + " x", "de", "b", 9),
        (10, "\U0001f600\u0000 zero", "en", "", 2), (11, same + " nu", "en", "a", 1),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long, f0 string, cell string, u string, key string, size string, n string"
    clash = ["__key", "__n", "__k", "__copies", "__leaks", "__told", "row", "k", "copies", "told", "leaks"]
    return spark.createDataFrame([(*r, *["x"] * 6, *[f"keep{i}" for i in clash]) for r in rows], cols + "".join(f", {c} string" for c in clash))
