"""Small tables with everything that a column can hold."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rank string, words string, `key` int, place int, `a.b` string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alder birch cedar date elm fig gum hazel iris juniper kapok larch maple nut oak pine".split()) + r.choice(["", "s", "y", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    base = prose(1, 120)
    near = base.replace("oak", "ash", 1)
    long = " ".join(prose(100 + i, 400) for i in range(60))
    lines = "\n".join(prose(200 + i, 12) for i in range(6))
    return [
        (1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n\x0b\f\r "), (7, "One"), (8, "one"), (9, long),
        (10, lines), (11, prose(7, 9) + "\n" + lines + "\n" + prose(8, 9)), (None, base), (None, None), (12, "é ÉCOLE ñandú 🤖 ***"), (13, prose(13, 30)),
        (13, prose(14, 30)), (14, "a b c d e " * 5), (15, "the same line here again\nthe same line here again\nthe same line here again"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 else "s", None, k, "x", "w", k, k, "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 if i % 5 == 0 else 0) for i in range(1, 16)] + [(None, 1, 1), (3, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
