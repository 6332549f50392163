"""Small document tables with the awkward cases that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, line string"
WORDS = "the of and to in a is that for it as was with be by on not he this are river stone light garden winter letter market window".split()


def prose(seed: int, words: int = 120) -> str:
    r = random.Random(seed)
    text = [r.choice(WORDS) + (str(r.randrange(9)) if r.random() < 0.02 else "") for _ in range(words)]
    for i in range(9, words, 13):
        text[i] += "."
    for i in range(19, words, 29):
        text[i] += "\n"
    return " ".join(text).replace("\n ", "\n")


def near(text: str, seed: int, edits: int) -> str:
    """``text`` with some words replaced."""
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(1000)}"
    return " ".join(words)


def rows_of(texts: list) -> list[tuple]:
    """Rows with columns whose names clash with the operators' own."""
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 99 - (i or 0), "x", None) for i, t in texts]


def awkward() -> list[tuple]:
    base = prose(1)
    texts = [
        (0, base), (1, base), (2, near(base, 5, 1)), (3, near(base, 6, 2)), (4, prose(2)), (5, None), (6, ""), (7, " \t\n"),
        (8, "one two"), (9, "one two"), (10, "One TWO"), (11, prose(3, 6000)), (12, "\n".join(["same line of seven words here now"] * 5)),
        (13, "ÄÖÜ straße é x   end"), (14, near(prose(2), 7, 12)), (15, "a\x00b c"), (None, base), (None, "only null id here"), (16, prose(4)),
        (16, prose(5)), (17, "<|endoftext|> is text"), (18, "tab\tseparated  double  spaces\r\nend"),
    ]
    rows = rows_of([(i if i is not None else 0, t) for i, t in texts])
    rows = [(i, *r[1:]) for (i, _), r in zip(texts, rows)]
    rows.append(rows[4])  # a repeated row
    rows[8] = (8, "one two", None, None, None, None, None, None)
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
