"""Line deduplication by winnowing over line hashes.

Every line with a word has a hash. A window is a run of lines that just reaches
``min_words`` words, counted forwards from a line or backwards from it. The
least line hash of a window is its fingerprint. Two documents that share a run
of ``min_words`` words or more share whole windows, so the same lines are chosen
in both: the fingerprints are guaranteed.

Positions meet on the fingerprint and the match grows from it both ways to the
ends of its window (equal lines to the left and to the right); windows of one
run overlap, so the run grows on from window to window: each line of a run of
enough words lies in a window that begins or ends there or spans it, within the
run. Every place but the first of such a match is a later repeat, and its lines go.

Each window needs its first place only, never all pairs, so the work is linear
in the lines, also where a third of the corpus holds one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkwatch.llm.common import WORD, fenced

#: A run of lines goes if it stood earlier and has so many words.
MIN_WORDS = 25

#: Stripped from the ends of a line before it is compared.
_EDGES = " \t\r\x0b\x0c"


def text_key(text: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, pos, hash, words): the lines that hold a word, counted from 0."""
    lines = F.transform(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n"),
        lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(_EDGES))).alias("hash"), F.regexp_count(x, F.lit(WORD)).alias("words")),
    )
    worded = F.filter(lines, lambda x: x["words"] > 0)
    rows = fenced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), worded.alias("lines")))
    return rows.select("doc_id", "key", F.posexplode("lines").alias("pos", "x")).select("doc_id", "key", "pos", "x.*")


def window_fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, first, last, anchor, left, right) of every window.

    ``first`` and ``last`` are its lines by ``pos``, ``anchor`` the least line
    hash, ``left`` and ``right`` stand for the lines on either side of it.
    """
    doc = W.partitionBy("doc_id", "key")
    # Rows that repeat a doc_id with an equal text are one document here.
    lines = lines.dropDuplicates(["doc_id", "key", "pos"])
    lines = lines.withColumn("end", F.sum("words").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.withColumn("begin", F.col("end") - F.col("words"))
    forth = doc.orderBy("begin").rangeBetween(0, min_words - 1)
    back = doc.orderBy("end").rangeBetween(1 - min_words, 0)
    lines = lines.withColumns(
        {"forth": F.collect_list("hash").over(forth), "forth_words": F.sum("words").over(forth), "back": F.collect_list("hash").over(back), "back_words": F.sum("words").over(back)}
    )
    window = lambda first, last, hashes, full: F.when(full, F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), hashes.alias("hashes")))
    pos = F.col("pos")
    both = F.array_compact(
        F.array(
            window(pos, pos + F.size("forth") - 1, F.col("forth"), F.col("forth_words") >= min_words),
            # A line that is a window by itself is there already.
            window(pos - F.size("back") + 1, pos, F.col("back"), (F.col("back_words") >= min_words) & (F.col("words") < min_words)),
        )
    )
    rows = lines.select("doc_id", "key", F.explode(both).alias("w")).select("doc_id", "key", "w.*")
    rows = rows.withColumn("anchor", F.array_min("hashes"))
    at = F.array_position("hashes", F.col("anchor")).cast("int")
    return rows.select(
        "doc_id", "key", "first", "last", "anchor",
        F.xxhash64(F.slice("hashes", 1, at - 1)).alias("left"),
        F.xxhash64(F.slice("hashes", at + 1, F.size("hashes") - at)).alias("right"),
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, gone): the lines of each document, by ``pos``, that repeat an earlier run."""
    lines = hashed_lines(docs)
    found = window_fingerprints(lines, min_words)
    same = ["anchor", "left", "right"]
    firsts = found.groupBy(*same).agg(F.min(F.struct("doc_id", "key", "first")).alias("place"), F.count("*").alias("places")).where("places > 1")
    later = found.join(firsts.drop("places"), same).where(~F.struct("doc_id", "key", "first").eqNullSafe(F.col("place")))
    runs = later.select("doc_id", "key", F.explode(F.sequence("first", "last")).alias("pos"))
    return runs.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later repeated runs cut from ``text``, and ``n_removed``, the lines cut.

    Documents are ordered by doc_id, lines by their place; the first place of a
    run stays. Texts without a repeat stay as they are; a text that loses its
    last line with a word becomes empty. Null and empty texts have no lines and
    stay. A null doc_id comes before the others. Rows that repeat a doc_id and
    text are one document and get one result; with other texts they are
    documents of their own, in an order fixed by the texts' hashes. All other
    columns stay, whatever their names, but for ``n_removed``, which is
    replaced. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, min_words).select(F.struct("doc_id", "key", "gone").alias("found"))
    docs = docs.drop("n_removed")
    names = docs.columns
    # The row is one column, so that no name of its own meets those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("text_key"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("found.doc_id")) & (F.col("text_key") == F.col("found.key")), "left")
    out = out.select("row", F.col("found.gone").alias("gone"), F.when(F.col("found").isNotNull(), F.split("row.text", "\n")).alias("lines"))
    lines = F.col("lines")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    out = fenced(out.withColumn("worded", F.filter(places, lambda i: F.get(lines, i).rlike(WORD))))
    stay = F.array_except(places, F.transform("gone", lambda p: F.get(F.col("worded"), p)))
    out = fenced(out.withColumn("left", F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).when(F.col("left").rlike(WORD), F.col("left")).otherwise("")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], n_removed)


#: The rule in plain SQL: pairs of equal lines lie on diagonals; stretches of a
#: diagonal with enough words repeat an earlier run.
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM l WHERE words > 0
), pairs AS (
  SELECT a.doc_id, a.pos, a.words, b.doc_id AS other, a.pos - b.pos AS diagonal
  FROM p a JOIN p b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY pos) AS island FROM pairs
), runs AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, other, diagonal, island) AS run_words FROM islands
), gone AS (
  SELECT DISTINCT doc_id, pos FROM runs WHERE run_words >= {MIN_WORDS}
), cut AS (
  SELECT l.doc_id, count(gone.pos)::INTEGER AS n_removed
  FROM l LEFT JOIN p USING (doc_id, line_no) LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos
  GROUP BY l.doc_id
), rest AS (
  SELECT d.doc_id, string_agg(x, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) d
  LEFT JOIN p ON p.doc_id = d.doc_id AND p.line_no = d.i
  LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos
  WHERE gone.pos IS NULL GROUP BY d.doc_id
)
SELECT documents.doc_id, n_removed,
       CASE WHEN n_removed = 0 THEN documents.text
            WHEN regexp_matches(coalesce(rest.text, ''), '[^\\x20\\x09-\\x0D]') THEN rest.text ELSE '' END AS text
FROM documents JOIN cut USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
