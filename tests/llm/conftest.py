import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, mark int, ids string, words string, score double, `_id` string, h string, runs string"


def words(rnd, n, letters="abcdefghij"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Small texts with every awkward case: null, empty, very long, repeats, ties, odd characters."""
    rnd = random.Random(11)
    passage = words(rnd, 70)
    plain = [words(rnd, rnd.randint(40, 90)) + ".\n" + words(rnd, 30) + "." for _ in range(12)]
    long = "\n".join(words(rnd, 40) + "." for _ in range(900))
    out = [None, "", " \n\t ", "x", "one two three", "é ß ﬁ 日本語 \x00 😀 İ", "the the the " * 200, *plain, long]
    out += [plain[0], plain[0].replace("a", "a", 1), plain[1] + " tail", words(rnd, 30) + " " + passage + " " + words(rnd, 30), words(rnd, 10) + " " + passage, "###$$$ %%% | | |\n" * 40]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with null ids, a repeated row, nulls in every column and columns that clash with inner names."""
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None, 1, 2, "i", "w", 0.5, "x", "h", "r") for i, t in enumerate(texts)]
    rows += [rows[8], (None, texts[9], *[None] * 11), (None, None, *[None] * 11)]
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
