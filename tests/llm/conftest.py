import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, rank int, size long, kept boolean, queue string, comp long, part int, _cf_text string"


def _clash(rows):
    """Rows of documents with more columns, named as the operators' own."""
    return [(*r, None, "k", 7, 1, False, "q", 3, 0, "x") for r in rows]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, ties, rows that repeat, a very long text, other scripts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, " \n\t", None, "a", 3), (4, "a b c", "en", "a", 5), (5, "a bc", "en", None, 4), (6, "abc", "en", "b", 3), (6, "abc", "en", "b", 3),
        (7, long, "en", "b", len(long)), (8, "ein Satz über Größe und Maß", "de", "b", 27), (9, "two words", None, "b", 9), (10, "日本語 テキスト  x", "ja", None, 11), (11, "12 34 -- !!", "en", "a", 11),
        (None, "a b c", "en", "a", 5), (12, "A B C", "en", "a", 5), (13, "á naïve café \x1f don't <|endoftext|> ﬁ", "fr", "c", 30),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(_clash(edge_rows), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def near_rows():
    """A third of all rows in one group of near copies, some exact copies, the rest unlike each other."""
    dice = random.Random(3)
    word = lambda: "".join(dice.choices("abcdefghijklmnop", k=5))
    base, rows = [word() for _ in range(120)], []
    for i in range(60):
        own = list(base)
        for _ in range(dice.choice([0, 1, 1, 2, 3, 5])):
            own[dice.randrange(len(own))] = word()
        rows.append((i, " ".join(own), "en", "a", 0))
    for i in range(60, 160):
        rows.append((i, " ".join(word() for _ in range(dice.randint(1, 150))), "en", dice.choice("bcd"), 0))
    for i in range(160, 180):
        rows.append((i, rows[dice.randrange(160)][1].replace(" ", "\n"), "en", "e", 0))
    return rows


@pytest.fixture(scope="session")
def near_docs(spark, near_rows):
    return spark.createDataFrame(near_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()
