"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the mix takes the point ``frac(i * golden ratio)``; the points are
mapped through the cumulative draw counts of the sources, so each source gets
its share in every stretch of the schedule. The slots of a source are ranked,
and rank ``r`` takes block ``r mod blocks`` of that source: blocks of equal
numbers of words, cut from the source's documents in a fixed shuffled order.

No task holds a source: ranks and word offsets are prefix sums over
(source, chunk) parts, whose totals are summed in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkwatch.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 256
#: A small source is cut into at least so many blocks (one word each, at least),
#: which bounds the share that one slot more or less changes.
LEAST_BLOCKS = 256
#: 2^32 / golden ratio, odd: i * GOLDEN mod 2^32 visits every point once in 2^32 slots.
GOLDEN = 2654435769
#: Slots ranked together, and cells of the point range.
CHUNK = 8192
CELLS = 4096


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, order_key): words of each text, and its place in the shuffle."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("order_key"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per source: source, source_size, target, words per block, blocks, draws.

    The targets are the water level: sources sorted by size / weight fill up to
    ``limit * size`` first, the others share what is left by weight. The
    unpartitioned windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * limit)
        / F.sum("weight").over(after),
    )
    # The first source that its level doesn't fill sets the level of all.
    open_ = F.col("source_size") * limit > F.col("level") * F.col("weight")
    per = per.withColumn("level", F.first(F.when(open_, F.col("level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    top = (F.col("source_size") * limit).cast("double")
    target = F.when(F.col("level").isNull(), top).otherwise(F.least(F.col("level") * F.col("weight"), top))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    per = per.select("source", "source_size", target.alias("target"), block.alias("block_words"))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    draws = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.round(F.col("target") * F.col("blocks") / F.col("source_size")))
    return per.withColumn("draws", draws.cast("long"))


def _intervals(targets: DataFrame) -> DataFrame:
    """Sources with draws, their part [lo, hi) of the 2^32 points, and the slots of the mix."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    to = F.sum("draws").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = lambda c: F.floor(c.cast("double") / F.col("slots") * float(2**32)).cast("long")
    return (
        targets.where("draws > 0")
        .withColumn("slots", F.sum("draws").over(everything))
        .withColumn("upto", to)
        .withColumns({"lo": cut(F.col("upto") - F.col("draws")), "hi": cut(F.col("upto"))})
    )


def slot_schedule(targets: DataFrame) -> DataFrame:
    """(slot, source, rank, block, epoch) of every slot of the mix.

    Points are looked up by an equi-join on the cell of the point range. Slots
    past the last permitted pass over a source are left out. Slots are made from
    one row, so Spark takes them for few: the joins ask for sorted shuffles, else
    the slots would be broadcast.
    """
    spark = targets.sparkSession
    spans = _intervals(targets)
    width = 2**32 // CELLS
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    # One row for each chunk of slots, then the slots within.
    chunks = spans.agg(F.max("slots").alias("n")).select(
        "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.coalesce("n", F.lit(1)) - 1) / CHUNK))).alias("chunk")
    ).where("n IS NOT NULL").repartition("chunk")
    slots = chunks.select(
        "chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)).alias("slot")
    )
    i = F.col("slot") % 2**32
    high, low = F.floor(i / 65536), i % 65536
    point = ((high * GOLDEN) % 65536 * 65536 + low * GOLDEN) % 2**32
    slots = slots.withColumn("point", point.cast("long")).withColumn("cell", F.floor(F.col("point") / width))
    slots = slots.join(cells.hint("merge"), "cell").where("point >= lo AND point < hi")
    part = W.partitionBy("chunk", "source").orderBy("slot")
    slots = slots.select("slot", "chunk", "source", "blocks", F.row_number().over(part).alias("nth"))
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    slots = slots.join(counts.hint("merge"), (F.col("chunk") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")))
    rank = F.col("offset") + F.col("nth") - 1
    return slots.select(
        "slot", "source", rank.alias("rank"), (rank % F.col("blocks")).alias("block"), F.floor(rank / F.col("blocks")).alias("epoch")
    ).where(F.col("epoch") < LIMIT)


def shuffled_pieces(sizes: DataFrame, targets: DataFrame, parts: int) -> DataFrame:
    """(doc_id, source, order_key, block, words): each document's words by the block they fall in."""
    share = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") % parts
    docs = sizes.withColumn("part", share)
    inside = W.partitionBy("source", "part").orderBy("order_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    totals = docs.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(totals, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    docs = docs.select("doc_id", "source", "order_key", "size", (F.col("offset") + F.col("inside")).alias("begin"))
    blocks = targets.select(F.col("source").alias("s"), "source_size", "target", "block_words")
    docs = docs.join(blocks, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = F.floor(F.col("begin") / F.col("block_words"))
    last = F.floor((F.col("begin") + F.greatest(F.col("size"), F.lit(1)) - 1) / F.col("block_words"))
    docs = docs.withColumn("block", F.explode(F.sequence(first, last)))
    upper = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    lower = F.greatest(F.col("begin"), F.col("block") * F.col("block_words"))
    return docs.withColumn("words", upper - lower)


def mix_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    ``taken`` counts the words that the mix takes of the document, repeats
    included, and is never over ``LIMIT * size``. Null texts and texts without
    words have size 0 and taken 0; a null source is a source of its own, the
    last in order; a null doc_id is a document like others. Rows that repeat a
    doc_id are documents of their own, one result each. An empty table gives no
    rows. Other columns are ignored.

    ``parts``: parts in which a source's documents are summed; by default one
    for about 5,000 documents.
    """
    sizes = written(document_sizes(docs), "mix-sizes")
    parts = parts or max(1, sizes.count() // 5_000)
    targets = source_targets(sizes)
    taken = slot_schedule(targets).groupBy("source", "block").agg(F.count("*").alias("times"))
    taken = taken.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    pieces = shuffled_pieces(sizes, targets, parts)
    pieces = pieces.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    # A document with words is alone at its begin; only empty rows that repeat a doc_id share one.
    out = pieces.groupBy("source", "begin", "doc_id", "size").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"),
        F.sum(F.when(F.col("block") == F.floor(F.col("begin") / F.col("block_words")), 1).otherwise(0)).cast("int").alias("rows_here"),
    )
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows_here"))))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same result in DuckDB: plain running sums over whole sources, and the
#: schedule's points by modular products.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w
  FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
             - coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {LIMIT})
            / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM s1
), lvl AS (
  SELECT min_by(lv, struct_pack(a := source_size::DOUBLE / w, b := source IS NULL, c := source)) AS level
  FROM s2 WHERE source_size * {LIMIT} > lv * w
), s3 AS (
  SELECT source, source_size,
         least(coalesce(level * w, (source_size * {LIMIT})::DOUBLE), (source_size * {LIMIT})::DOUBLE) AS target,
         greatest(1, least({BLOCK_WORDS}, source_size // {LEAST_BLOCKS}))::BIGINT AS bw
  FROM s2, lvl
), s4 AS (
  SELECT *, ((source_size + bw - 1) // bw)::BIGINT AS blocks FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE round(target * blocks / source_size) END::BIGINT AS draws FROM s4
), s6 AS (
  SELECT *, sum(draws) OVER ()::BIGINT AS slots,
         sum(draws) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM s5 WHERE draws > 0
), s7 AS (
  SELECT *, floor((upto - draws)::DOUBLE / slots * 4294967296.0)::BIGINT AS lo,
         floor(upto::DOUBLE / slots * 4294967296.0)::BIGINT AS hi
  FROM s6
), pts AS (
  SELECT i, ((i % 4294967296) * {GOLDEN}::HUGEINT % 4294967296)::BIGINT AS p
  FROM range((SELECT coalesce(max(slots), 0) FROM s7)) t(i)
), ranked AS (
  SELECT s7.source, blocks, row_number() OVER (PARTITION BY s7.source ORDER BY i) - 1 AS rank
  FROM pts JOIN s7 ON p >= lo AND p < hi
), times AS (
  SELECT source, rank % blocks AS block, count(*) AS n FROM ranked WHERE rank // blocks < {LIMIT} GROUP BY ALL
), placed AS (
  SELECT r, doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY part, k, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % greatest(1, (SELECT count(*) FROM d) // 5000) AS part FROM d)
), pieces AS (
  SELECT r, source, block, least(b + size, (block + 1) * bw) - greatest(b, block * bw) AS words
  FROM (SELECT placed.*, bw, unnest(range(b // bw, (b + size - 1) // bw + 1)) AS block
        FROM placed JOIN s4 ON placed.source IS NOT DISTINCT FROM s4.source WHERE size > 0)
), taken AS (
  SELECT r, sum(words * n)::BIGINT AS taken
  FROM pieces JOIN times ON pieces.source IS NOT DISTINCT FROM times.source AND pieces.block = times.block
  GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed JOIN s3 ON placed.source IS NOT DISTINCT FROM s3.source LEFT JOIN taken USING (r)
"""
