"""Copies just above the threshold, and counts of long texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkwatch.llm import decontamination
from tests.llm.helpers import DOCS


def test_copies_at_the_threshold(spark):
    """Items of 40 words whose last four are others in the copy: 32 of 40 shingles."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    items = {i: [word() for _ in range(40)] for i in range(1000)}
    docs = [(i, " ".join([word() for _ in range(20)] + w[:36] + [word() for _ in range(20)]), "en", "a", 1) for i, w in items.items()]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == {(i, i) for i in items}


def test_simhash_of_many_words(spark):
    """A word that stands 40,000 times outweighs others."""
    row = spark.range(1).select(F.array_repeat(F.lit("often"), 40_000).alias("w")).select(decontamination.simhash(F.concat("w", F.array(F.lit("once")))).alias("p"), F.xxhash64(F.lit("often")).alias("h")).first()
    assert row["p"] == row["h"]
