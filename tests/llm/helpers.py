"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the caller.
CLASHING = ("key", "row", "hash", "size", "found", "gone", "lines", "words", "f", "s", "node", "score", "_held", "_kept", "_fence", "begin", "quality", "toxic", "label", "text_key", "html")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def prose(seed: int, lines: int = 6, words: int = 20) -> str:
    rng = random.Random(seed)
    return "\n".join(sentence(rng, words) for _ in range(lines))


def awkward(spark):
    """Documents with every awkward case; doc 20 and 21 are exact copies of 10, 22 a near copy."""
    base = prose(10)
    near = base.replace(base.split()[30], "changedword", 1)
    rows = [
        (None, prose(1), "en", "a", 5),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\r\n ", "en", "a", 6),
        (4, "word", "en", "b", 4),
        (5, "\n".join(prose(100 + i, 3) for i in range(200)), "en", "b", None),
        (5, "\n".join(prose(100 + i, 3) for i in range(200)), "en", "b", None),
        (6, prose(6), "en", None, 1),
        (6, prose(7), "en", None, 1),
        (10, base, "en", "b", 1),
        (20, base, "en", "c", 1),
        (21, base, "en", "c", 1),
        (22, near, "en", "c", 1),
        (30, "é ü ß 漢字 \U0001f600 &|# " * 30, "de", "d", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


def empty(spark):
    return awkward(spark).where("false")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
