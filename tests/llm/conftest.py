"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib

import pytest

LONG = " ".join(f"word{k % 977} and{k}" for k in range(12_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
# Lines with stop words that are not alike otherwise.
BASE = ["the {} of {} and {}".format(*[hashlib.md5(f"{k} {j}".encode()).hexdigest()[:6] for j in range(3)]) for k in range(40)]
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two"),
    (5, LONG),
    (6, "\n".join(BASE)),
    (7, "\n".join(BASE)),  # a copy
    (7, "\n".join(BASE)),  # a repeated row
    (8, "\n".join(BASE[:-1] + [BASE[-1][:-6] + "edited"])),  # a near copy
    (9, f"the start of it\n{PASSAGE}\nthe end of nine"),
    (10, f"another begin here\n{PASSAGE}\nand the end of ten"),
    (None, "a text that has no id but says the same to all of us"),
    (12, "Zoë said: <|im_end|> <|endoftext|> naïve café — 日本語 🙂\x0b tab\x0c"),
    (13, "### *** $$$ %%% | < > " * 30),
    (14, "same words again " * 40),
]
CLASHING = "doc_id long, text string, row string, key string, words string, n_words string, kept string, id string, line string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(k, t, *["x"] * 7) for k, t in TEXTS], CLASHING)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)
