"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a 64-bit SimHash of its words. A document offers
windows as long as an item. Window and item are compared if their fingerprints
differ in at most ``RADIUS`` bits, found by multi-index blocks: of ``BLOCKS``
blocks, two such fingerprints differ in at most ``RADIUS // BLOCKS`` bits of at
least one, so the items are listed under every value that close of every block,
and the windows ask for their own values: no pair within the radius is missed.
Exact similarity of the shingles, weighted by how often they stand, decides.

A window only reaches the threshold ``t`` if it has ``t / (1 + t)`` of both
sides' shingles in common with an item of its length. Windows with fewer
shingles of such items can't match and get no fingerprint; that leaves the few
passages in which nearly every shingle is known.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import GAP, fenced, written

SHINGLE = 5
THRESHOLD = 0.8
#: Bits in which fingerprints of a window and an item may differ. Of 80,000 simulated
#: copies at the threshold (40 to 200 random words, the last ones replaced) none differed in more.
RADIUS = 23
BLOCKS = 8
_BITS = 64 // BLOCKS
#: Bits of the table that tells known shingles; a wrong "known" costs time only.
TABLE_BITS = 1 << 20


def normal_words(text: Column) -> Column:
    """Lower-cased words of letters and digits, without other signs."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")
    return F.filter(F.split(plain, GAP), lambda w: w != "")


def shingle_at(words: Column, i: Column) -> Column:
    """Hash of the words from place ``i``, counted from 0."""
    return F.xxhash64(F.slice(words, i + 1, SHINGLE))


def places(n: Column) -> Column:
    """Places of the shingles of ``n`` words; none in fewer words than a shingle."""
    return F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, length, words) of the items with a shingle at least, without repeats."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal_words(F.col("text")).alias("words"))
    items = items.withColumns({"item_key": F.xxhash64("item_id", "words"), "length": F.size("words")})
    return items.where(F.col("length") >= SHINGLE).dropDuplicates(["item_key"])


def known_shingles(items: DataFrame) -> DataFrame:
    """(length, hash): the shingles of items of each length."""
    rows = items.select("length", "words", F.explode(places(F.col("length"))).alias("i"))
    return rows.select("length", shingle_at(F.col("words"), F.col("i")).alias("hash")).distinct()


def bit_table(known: DataFrame) -> list[int]:
    """A table of TABLE_BITS bits, as 64-bit words, with the bit of every known hash set.

    Its size is fixed, however many items there are.
    """
    at = F.col("hash").bitwiseAND(F.lit(TABLE_BITS - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))
    words = known.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = [0] * (TABLE_BITS // 64)
    for r in words.collect():  # TABLE_BITS / 64 rows at most
        table[r["word"]] = r["bits"]
    return table


def simhash(words: Column) -> Column:
    """64-bit SimHash of an array of words, each with the weight of its count.

    The counts of the 64 bits are kept in 32-bit lanes, two to a number,
    which is enough for any array.
    """
    # The bits of a number under 4, each in a lane of its own.
    spread = F.array(*[F.lit(sum((v >> k & 1) << 32 * k for k in range(2))).cast("long") for v in range(4)])
    names = [f"c{k}" for k in range(32)]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names])

    def add(acc: Column, w: Column) -> Column:
        h = F.xxhash64(w)
        return F.struct(*[(acc[c] + F.get(spread, F.shiftrightunsigned(h, 2 * k).bitwiseAND(F.lit(3)).cast("int"))).alias(c) for k, c in enumerate(names)])

    def read(acc: Column) -> Column:
        half = F.size(words) / 2
        out = F.lit(0).cast("long")
        for k, c in enumerate(names):
            for lane in range(2):
                bit = 2 * k + lane
                count = F.shiftright(acc[c], 32 * lane).bitwiseAND(F.lit(0x7FFFFFFF))
                out = out.bitwiseOR(F.when(count > half, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
        return out

    return F.aggregate(words, zero, add, read)


def blocks_of(fingerprint: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    parts = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int").alias("value")) for b in range(BLOCKS)]
    return F.array(*parts)


def listed_items(items: DataFrame) -> DataFrame:
    """(length, block, value, item_key, item_print): each item under all values close to its own."""
    close = [m for m in range(1 << _BITS) if m.bit_count() <= RADIUS // BLOCKS]
    rows = items.select("length", "item_key", simhash(F.col("words")).alias("item_print"))
    rows = rows.withColumn("b", F.explode(blocks_of(F.col("item_print"))))
    rows = rows.withColumn("mask", F.explode(F.array(*map(F.lit, close))))
    return rows.select("length", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"), "item_key", "item_print")


def suspect_documents(docs: DataFrame, table: list[int], least: int) -> DataFrame:
    """(doc_id, words, hits): documents with at least ``least`` places whose shingle the table knows."""
    # One literal, which Spark folds to an array.
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    rows = fenced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_words(F.col("text")).alias("words")))
    hashes = F.transform(places(F.size("words")), lambda i: shingle_at(F.col("words"), i))
    rows = fenced(rows.withColumn("hashes", hashes))

    def is_known(i: Column) -> Column:
        at = F.get("hashes", i).bitwiseAND(F.lit(TABLE_BITS - 1)).cast("int")
        return F.getbit(F.get(known, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    rows = fenced(rows.select("doc_id", "words", F.filter(places(F.size("words")), is_known).alias("hits")))
    return rows.where(F.size("hits") >= least)


def candidate_windows(suspects: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, key, length, start, words): windows with enough shingles of items of their length.

    A document shorter than the item is one window, whole.
    """
    places_ = suspects.select("doc_id", "key", F.size("words").alias("n"), F.explode(F.transform("hits", lambda i: F.struct(i.alias("i"), shingle_at(F.col("words"), i).alias("hash")))).alias("p"))
    hits = places_.select("doc_id", "key", "n", "p.*").join(known, "hash")
    hits = hits.groupBy("doc_id", "key", "n", "length").agg(F.sort_array(F.collect_set("i")).alias("at"))
    size = F.least("length", "n")
    here, there = size - SHINGLE + 1, F.col("length") - SHINGLE + 1
    need = F.ceil((here + there) * threshold / (1 + threshold) - 1e-9).cast("int")
    hits = hits.withColumns({"size": size, "m": here, "need": need}).where(F.size("at") >= F.col("need"))
    # ``need`` hits that lie within a window's reach, and the starts of such windows.
    def starts(i: Column) -> Column:
        first, last = F.get("at", i), F.get("at", i + F.col("need") - 1)
        low = F.greatest(F.lit(0), last - F.col("m") + 1)
        high = F.least(first, F.col("n") - F.col("size"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), starts)))
    windows = hits.select("doc_id", "key", "length", "size", F.explode(found).alias("start"))
    whole = suspects.select("doc_id", "key", "words")
    same = [windows["doc_id"].eqNullSafe(whole["doc_id"]), windows["key"] == whole["key"]]
    return windows.join(whole, same).select(windows["doc_id"], "length", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))


def word_shingles(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of the greater counts of two arrays of shingles."""
    count = lambda all_, x: F.size(F.filter(all_, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, start): each item a document holds, with its best window.

    ``start`` is the place of the window's first word; of equal ones the first.
    Items and texts without ``SHINGLE`` words, null and empty ones match nothing.
    Rows that repeat a doc_id count as one document with several texts, a null
    doc_id as a document like others; so do repeated item_ids. Other columns are
    ignored. Without documents or items there are no rows.
    """
    items = written(benchmark_items(benchmark), "leak-items")
    known = written(known_shingles(items), "leak-shingles")
    # A match has t of its item's shingles at least.
    shortest = items.agg(F.min("length")).first()[0] or SHINGLE
    least = math.ceil((shortest - SHINGLE + 1) * threshold - 1e-9)
    suspects = suspect_documents(docs, bit_table(known), least)
    suspects = written(suspects.withColumn("key", F.xxhash64("words")).dropDuplicates(["doc_id", "key"]), "leak-suspects")
    windows = written(candidate_windows(suspects, known, threshold), "leak-windows")
    # The same passage stands in many documents: one fingerprint for each wording.
    windows = windows.withColumn("wording", F.xxhash64("words"))
    wordings = windows.groupBy("length", "wording").agg(F.min("words").alias("words"))
    prints = wordings.withColumn("print", simhash(F.col("words")))
    prints = written(prints, "leak-prints")
    asked = prints.withColumn("b", F.explode(blocks_of(F.col("print")))).select("length", "wording", "print", "b.*")
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    # Rows multiply in the listing, which Spark's estimate doesn't know: no broadcast.
    pairs = asked.join(listed_items(items).hint("merge"), ["length", "block", "value"]).where(close)
    pairs = pairs.select("length", "wording", "item_key").distinct()
    pairs = pairs.join(prints.select("length", "wording", "words"), ["length", "wording"])
    pairs = pairs.join(items.select("item_key", "item_id", F.col("words").alias("item_words")), "item_key")
    pairs = fenced(pairs.withColumns({"a": word_shingles(F.col("words")), "b": word_shingles(F.col("item_words"))}))
    pairs = fenced(pairs.withColumn("similarity", weighted_similarity(F.col("a"), F.col("b"))))
    sure = pairs.where(F.col("similarity") >= threshold)
    found = windows.select("doc_id", "length", "start", "wording").join(sure.select("length", "wording", "item_id", "similarity"), ["length", "wording"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. A null doc_id is a document like others."""
    held = find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(held["_held"]), "left_anti")


#: Every window that shares a shingle with an item of its length, compared in full.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'),
                                                  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), item AS (
  SELECT item_id, len(w) AS length, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM b WHERE len(w) >= {SHINGLE})
), item_count AS (
  SELECT item_id, length, s, count(*) AS c FROM item GROUP BY ALL
), place AS (
  SELECT doc_id, n, i - 1 AS i, s FROM (
    SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE}))
  WHERE s IN (SELECT s FROM item)
), starts AS (
  SELECT DISTINCT doc_id, item_id, length, size, start FROM (
    SELECT doc_id, item_id, length, size, unnest(range(greatest(0, i - size + {SHINGLE}), least(i, n - size) + 1)) AS start
    FROM (SELECT place.*, item_id, length, least(length, n) AS size FROM place JOIN item_count USING (s)))
), common AS (
  SELECT doc_id, item_id, length, size, start, s, count(*) AS c
  FROM starts JOIN place USING (doc_id) WHERE i BETWEEN start AND start + size - {SHINGLE} GROUP BY ALL
), score AS (
  SELECT doc_id, item_id, length, size, start, sum(least(common.c, item_count.c)) AS n
  FROM common JOIN item_count USING (item_id, length, s) GROUP BY ALL
), sim AS (
  SELECT *, n::DOUBLE / (size + length - {2 * (SHINGLE - 1)} - n) AS similarity FROM score
)
SELECT doc_id, item_id, max(similarity) AS similarity,
       max_by(start, struct_pack(a := similarity, b := -start))::INTEGER AS start
FROM sim WHERE similarity >= {THRESHOLD} GROUP BY doc_id, item_id
"""
