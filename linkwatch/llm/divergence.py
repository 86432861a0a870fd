"""Divergence of sources: how far the words of each source are from those of others.

Terms are counted as fixed-width digests; no shuffle that grows with the corpus
carries their text. Each task also notes the text of every digest that it meets,
once; the least and the greatest text of a digest show where two terms share
one. Only those are counted again by their texts and split (``twin``). Text is
joined back to what the report shows.

A pair of sources is compared over all kept terms. Terms are dealt into blocks
and so are sources; a task compares the sources of two blocks over the terms of
one. A term that neither source has adds the same to each pair, so a task sums
what its terms add beyond that, and the rest is a product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwatch.llm.common import written
from linkwatch.session import scratch_path

#: Documents of its language that a kept term is in, at least.
MIN_DOCS = 3
#: Probabilities are counted in parts of this.
PARTS = 1_000_000_000
#: Ranks of the terms of a group.
TOP = 200
#: Bits of a digest.
BITS = 64
#: Terms and sources of a block of the comparison.
TERMS, SOURCES = 4096, 64
#: Bytes of text that a task splits together (a longer text is by itself).
TOGETHER = 2_000_000
#: A task gives its counts out beyond so many rows, and forgets its terms beyond so many; rows of a batch.
ROWS, NOTED, BATCH = 1_500_000, 500_000, 100_000

#: Terms are what a space is left between: A-Z become a-z, all bytes of other characters are above 7F, the rest is no term's.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_TALLY = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("count", pa.int64()), ("docs", pa.int64()), ("term", pa.string())])
_TALLY_DDL = "kind int, lang string, source string, digest long, count long, docs long, term string"
_COUNTS, _TEXTS = 0, 1


def digest(term: bytes, bits: int = BITS) -> int:
    """The last ``bits`` of the term's hash, as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(term) & ((1 << bits) - 1)
    return h - (1 << 64) if h >> 63 else h


def terms_of(text: bytes) -> list[bytes]:
    """The lower-cased terms of a text in UTF-8, in order."""
    return text.translate(_LETTERS).split()


class _Tally:
    """Occurrences and documents of each (group, term) of a task, given out when there are many."""

    def __init__(self, bits: int, with_text: bool) -> None:
        self.bits, self.with_text = bits, with_text
        self._begin()

    def _begin(self) -> None:
        self.index: dict[bytes, int] = {}
        self.names: dict[tuple[str, str], int] = {}
        self.digests = np.empty(0, np.int64)
        self.told = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, texts: list[bytes], groups: list[tuple[str, str]]) -> None:
        index, flat, ends = self.index, [], []
        for text in texts:
            flat += [index.setdefault(x, len(index)) for x in terms_of(text)]
            ends.append(len(flat))
        group = np.array([self.names.setdefault(g, len(self.names)) for g in groups], np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
        # Numbers of documents, groups and terms in a task are far below 2 ** 31.
        in_doc, times = np.unique((doc << 32) + np.array(flat, np.int64), return_counts=True)
        self._sum((group[in_doc >> 32] << 32) + (in_doc & 0xFFFFFFFF), times, np.ones(len(in_doc), np.int64))

    def _merge(self) -> None:
        if len(self.parts) > 1:
            keys, n, in_docs = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.rows = [], 0
            self._sum(keys, n, in_docs)

    def _sum(self, keys: np.ndarray, times: np.ndarray, in_docs: np.ndarray) -> None:
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        keys = keys[first]
        self.parts.append((keys, *(np.add.reduceat(x[order], first) if len(first) else x for x in (times, in_docs))))
        self.rows += len(keys)

    def full(self) -> bool:
        if self.rows > ROWS:
            self._merge()
            return self.rows > ROWS // 2 or len(self.index) > NOTED
        return len(self.index) > NOTED

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        """All that is counted, and the texts of the terms that are new."""
        self._merge()
        terms = list(self.index)
        self.digests = np.r_[self.digests, np.fromiter((digest(t, self.bits) for t in terms[len(self.digests) :]), np.int64, len(terms) - len(self.digests))]
        text = pa.array([t.decode("utf-8") for t in (terms if self.with_text else terms[self.told :])], pa.string())
        names = [pa.array([x[k] for x in self.names], pa.string()) for k in (0, 1)]
        for keys, n, in_docs in self.parts:
            for i in range(0, len(keys), BATCH):
                group, term = pa.array(keys[i : i + BATCH] >> 32), keys[i : i + BATCH] & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(term), _COUNTS, np.int32)), names[0].take(group), names[1].take(group), pa.array(self.digests[term]),
                        pa.array(n[i : i + BATCH]), pa.array(in_docs[i : i + BATCH]), text.take(pa.array(term)) if self.with_text else pa.nulls(len(term), pa.string()),
                    ],
                    schema=_TALLY,
                )
        self.parts, self.rows = [], 0
        if not self.with_text:
            for i in range(0, len(text), BATCH):
                nulls = [pa.nulls(len(text[i : i + BATCH]), f.type) for f in _TALLY]
                nulls[0] = pa.array(np.full(len(nulls[0]), _TEXTS, np.int32))
                nulls[3], nulls[6] = pa.array(self.digests[self.told + i : self.told + i + BATCH]), text[i : i + BATCH]
                yield pa.RecordBatch.from_arrays(nulls, schema=_TALLY)
        self.told = len(terms)
        if len(terms) > NOTED:
            self._begin()


def tallies(docs: DataFrame, bits: int, with_text: bool) -> DataFrame:
    """Rows of both kinds: (lang, source, digest, count, docs) of parts of the documents, and (digest, term).

    With ``with_text`` the counts carry the term, and there are none of the second kind.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(bits, with_text)
        texts: list[bytes] = []
        groups: list[tuple[str, str]] = []
        size = 0
        for batch in batches:
            for text, lang, source in zip(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist()):
                texts.append(text.as_py())
                groups.append((lang, source))
                size += len(texts[-1])
                if size >= TOGETHER:
                    tally.add(texts, groups)
                    texts, groups, size = [], [], 0
                    if tally.full():
                        yield from tally.rows_out()
        if texts:
            tally.add(texts, groups)
        yield from tally.rows_out()

    return docs.mapInArrow(count, _TALLY_DDL)


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Within it a task writes the few folders of its rows side by side, and doesn't sort the rows by folder."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "4")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def term_counts(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, twin, count, docs) of every term of a group, and (digest, twin, term) of every term.

    ``twin`` tells terms of one digest apart; it is 0 for a digest with one term.
    """
    path = scratch_path(docs.sparkSession, f"divergence-{uuid.uuid4().hex}")
    with _unsorted(docs.sparkSession):
        tallies(docs, bits, False).write.partitionBy("kind").parquet(path)
    both = docs.sparkSession.read.schema(_TALLY_DDL).parquet(path)
    group = ["lang", "source", "digest"]
    sums = [F.sum("count").alias("count"), F.sum("docs").alias("docs")]
    counts = both.where(F.col("kind") == _COUNTS).groupBy(*group).agg(*sums)
    noted = both.where(F.col("kind") == _TEXTS).select("digest", "term")
    texts = written(noted.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "divergence-texts")
    shared = texts.where("term <> last").select("digest")
    zero = F.lit(0).alias("twin")
    alone = counts.select(*group, zero, "count", "docs")
    named = texts.select("digest", zero, "term")
    if shared.isEmpty():
        return written(alone, "divergence-counts"), named
    order = W.partitionBy("digest").orderBy("term")
    twins = written(noted.join(shared, "digest", "left_semi").distinct().withColumn("twin", F.row_number().over(order)), "divergence-twins")
    again = tallies(docs, bits, True).join(shared, "digest", "left_semi").groupBy(*group, "term").agg(*sums)
    split = again.join(twins, ["digest", "term"]).select(*group, "twin", "count", "docs")
    alone = alone.join(shared, "digest", "left_anti").unionByName(split)
    named = named.join(shared, "digest", "left_anti").unionByName(twins.select("digest", "twin", "term"))
    return written(alone, "divergence-counts"), written(named, "divergence-named")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + kept)), exactly; null where the divisor is 0."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("try_add", F.lit(1).cast("long"), _div(F.lit(PARTS).cast("decimal(10,0)") * wide(count + 1), F.nullif(wide(total + kept), F.lit(0).cast("decimal(20,0)"))))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _compared(rows: pa.Table) -> pa.Table:
    """(lang, source, item, value) of the pairs of two blocks of sources, over a block of terms."""
    r = {c: rows[c].to_numpy() for c in ("digest", "twin", "count", "p", "p0", "v", "block", "i", "j", "tb")}
    source = rows["source"].to_pylist()
    names = sorted(set(source))
    at = {x: k for k, x in enumerate(names)}
    row = np.array([at[x] for x in source])
    real = r["count"] > 0
    _, place = np.unique(np.stack([r["digest"][real], r["twin"][real].astype(np.int64)]), axis=1, return_inverse=True)
    terms = int(place.max(initial=-1)) + 1
    zero, block = np.ones(len(names), np.int64), np.zeros(len(names), np.int64)
    zero[row], block[row] = r["p0"], r["block"]
    p = np.repeat(zero[:, None], terms, axis=1)
    p[row[real], place.ravel()] = r["p"][real]
    a, b = np.flatnonzero(block == r["i"][0]), np.flatnonzero(block == r["j"][0])
    q, q0 = p[b], zero[b]
    first, kept = r["tb"][0] == 0, int(r["v"][0])
    out: dict[str, list] = {"source": [], "item": [], "value": []}
    for k in a:
        # Terms that neither source has add this each; it is counted once, with the first block of terms.
        plain = (zero[k] - q0) ** 2 // q0
        value = ((p[k] - q) ** 2 // q).sum(axis=1) - terms * plain + (kept * plain if first else 0)
        out["source"] += [names[k]] * len(b)
        out["item"] += [names[x] for x in b]
        out["value"].append(value)
    keep = pa.array([x != y for x, y in zip(out["source"], out["item"])], pa.bool_())
    table = pa.table({
        "lang": pa.array([rows["lang"][0].as_py()] * len(out["source"]), pa.string()),
        "source": pa.array(out["source"], pa.string()),
        "item": pa.array(out["item"], pa.string()),
        "value": pa.array(np.concatenate(out["value"]) if out["value"] else np.empty(0, np.int64), pa.int64()),
    })
    return table.filter(keep)


def compare_sources(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    ``terms`` has (lang, source, digest, twin, count, p), ``groups`` every group
    with its probability of a term that it lacks (p0), its language's number of
    kept terms (v) and of sources (s).
    """
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("long")
    own = groups.select(
        "lang", "source", "v", F.coalesce("p0", F.lit(1)).cast("long").alias("p0"), blocks("v", TERMS).alias("tbs"),
        blocks("s", SOURCES).alias("sbs"), F.pmod(F.xxhash64("source"), blocks("s", SOURCES)).alias("block"),
    )
    rows = terms.select("lang", "source", "digest", "twin", "count", "p").join(own, ["lang", "source"])
    rows = rows.withColumn("tb", F.pmod(F.xxhash64("digest", "twin"), F.col("tbs")))
    # Every group is in every block of terms, also without one of them.
    zero = F.lit(0).cast("long")
    present = own.withColumn("tb", F.explode(F.sequence(zero, F.col("tbs") - 1)))
    present = present.withColumns({"digest": zero, "twin": F.lit(0), "count": zero, "p": F.col("p0")})
    rows = rows.unionByName(present)
    others = F.sequence(zero, F.col("sbs") - 1)
    with_each = F.flatten(F.transform(others, lambda x: F.when(x == F.col("block"), F.array(F.struct(x.alias("i"), x.alias("j")))).otherwise(F.array(F.struct(F.col("block").alias("i"), x.alias("j")), F.struct(x.alias("i"), F.col("block").alias("j"))))))
    rows = rows.select("lang", "source", "digest", "twin", "count", "p", "p0", "v", "block", "tb", F.inline(with_each))
    parts = rows.groupBy("lang", "tb", "i", "j").applyInArrow(_compared, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and its own terms.

    Null text, lang and source count as empty ones. A row is a document, also one
    that repeats or lacks a doc_id, which isn't read. Texts without terms make a
    group all the same. Texts and terms have any length. Equal values are ranked
    by the item's code points. Other columns are ignored. An empty table gives no
    rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts, texts = term_counts(docs, bits)
    key = ["lang", "digest", "twin"]
    kept = written(counts.groupBy(*key).agg(F.sum("count").alias("n"), F.sum("docs").alias("d")).where(F.col("d") >= min_docs).drop("d"), "divergence-kept")
    own = written(counts.drop("docs").join(kept, key), "divergence-own")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.count("*").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.join(own.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang")
    groups = groups.select("lang", "source", zero("total"), zero("v"), zero("lang_total"), "s")
    groups = written(groups.withColumn("p0", probability(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "divergence-groups")
    terms = own.join(groups.drop("s", "p0"), ["lang", "source"])
    terms = terms.withColumns({"p": probability(F.col("count"), F.col("total"), F.col("v")), "q": probability(F.col("n"), F.col("lang_total"), F.col("v"))})
    terms = written(terms.select("lang", "source", "digest", "twin", "count", "p", "q"), "divergence-terms")
    pairs = compare_sources(terms, groups).withColumn("part", F.lit("pair"))
    own_terms = terms.where("p > q").select("lang", "source", "digest", "twin", distance(F.col("p"), F.col("q")).alias("value"))
    # All that may be among the first, ties too; their text decides.
    first = own_terms.withColumn("_rank", F.rank().over(W.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_rank") <= top)
    shown = first.join(texts, ["digest", "twin"]).select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    rows = pairs.unionByName(shown).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return rows.select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d
), every AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM every GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), c AS (
  SELECT every.* FROM every SEMI JOIN kept USING (lang, term)
), g AS (
  SELECT lang, source FROM d GROUP BY ALL
), sums AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT sums.lang, sums.source, kept.term, coalesce(c.n, 0) AS n,
         1 + ({PARTS}::HUGEINT * (coalesce(c.n, 0) + 1)) // (sums.total + langs.v) AS p,
         1 + ({PARTS}::HUGEINT * (kept.n + 1)) // (langs.total + langs.v) AS q
  FROM sums JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = sums.lang AND c.source = sums.source AND c.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
