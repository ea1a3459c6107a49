"""Inputs for the corpus operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, node long, label string, part int"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); extra columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), 7, 7, "x", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """Null and empty texts, a null id, ties, repeated rows, a very long text."""
    long = words(random.Random(1), 20_000)
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f"), (5, "tie of words here and there"), (6, "tie of words here and there"), (6, "tie of words here and there"), (8, long), (9, "x"), (10, "é ß 日本 İ")]
