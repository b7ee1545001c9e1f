"""Small tables with everything odd in them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


LONG = prose("long", 120_000, 50_000)

ODD = [
    (1, None, None, None, 0),
    (2, "", "en", "s", 1),
    (3, " \n\t ", "en", "s", 2),
    (4, "one", "en", None, 3),
    (5, "¡Çé 漢字 😀 ！", "xx", "s", 4),
    (6, "1234 5678 !!!", "en", "s", 5),
    (7, prose(7, 80), "en", "s", 6),
    (8, prose(7, 80), "en", "s", 7),  # a copy
    (8, prose(7, 80), "en", "s", 7),  # a repeated row
    (9, LONG, "en", "s", 8),
    (None, "a row without a key, " + prose(1, 60), "en", "s", 9),
    (10, "The The The The " * 50, "en", "s", 10),
]
#: Columns whose names the operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n long, key long, node long, label long, score double, start long, words string, place long, row string, ids string, block long, h string, _key long, _lowered_text string"


def odd(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(*r, 1, 2, 3, 0.5, 4, "x", 5, "y", "z", 6, "h", 7, "low") for r in rows], EXTRA)


def plain(spark, texts):
    """doc_id from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def empty(spark):
    return odd(spark, [])


def alike(n=10):
    """Two different words of 2 ** n bytes that any polynomial hash modulo 2 ** 64 gives the same value."""
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y
