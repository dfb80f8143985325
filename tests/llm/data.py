"""Small documents with all that operators must stand: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, key long, size long, word string"


def words(n, seed, stock=400):
    rng = random.Random(seed)
    return [f"{rng.choice(['the', 'of', 'and', 'is', 'to'])}" if rng.random() < 0.35 else f"w{rng.randrange(stock)}x" for _ in range(n)]


def texts():
    base = " ".join(words(300, 1))
    near = base.replace("w1", "v1", 1)
    shared = " ".join(words(70, 9))
    rows = [
        (1, base), (2, base), (3, near), (4, "junk " * 80), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "one"), (9, "One two"), (10, "a b c d"),
        (11, " ".join(words(40, 2)) + " " + shared), (12, shared + " " + " ".join(words(60, 3))), (13, "  é ß 😀 " * 30), (14, 'token = "0123456789abcdef0123456789abcdef01234567" tail'),
        (15, " ".join(words(9000, 4, 100_000))), (15, "again the same id"), (16, base.upper()), (None, "no id here"), (None, "no id here"), (None, None), (17, "x" * 50_000), (18, "### $$$ " * 60),
        (20, "same words here for all"), (20, "same words here for all"), (21, "same  words here for all"),
    ]
    rows += [(100 + k, " ".join(words(120 + k, 50 + k))) for k in range(30)]
    rows += [(200 + k, f"Line {k % 3}!!\n" * 30 + " ".join(words(20, k))) for k in range(12)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["s1", "s2", "s3", None]
    return spark.createDataFrame([(i, t, "en", sources[n % 4], len(t) if t else None, n, n, n, n, "word") for n, (i, t) in enumerate(rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
