"""Spelling variants: words one edit apart, and the most frequent form of each.

A word is a point: how often it has each letter (code points modulo 32). One
edit changes one count by one (a letter more or less) or two counts (a letter
replaced), so near words lie at an L1 distance of two at most. Points of one
length stand in a k-d tree. A word searches the tree of its own length, where it
may gain one letter and lose one, and that of the length below, where it may
lose one; boxes that need more are pruned. What is found is verified letter by
letter.

The upper levels of each tree are fitted on a bounded sample and deal the whole
vocabulary into cells; every word is a point of one cell and a query in each cell
that its searches reach. A task has one cell, or a part of its points and of its
queries where these are many, and goes on with the lower levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import written

#: A run of letters, lower-cased A-Z apart.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have so many code points and occurrences at least.
MIN_LENGTH, MIN_COUNT = 5, 3
#: Of ``SLIPS`` runs about one loses a letter, chosen by the run's crc32.
SLIPS = 97
#: A form has so many times the occurrences of its variant at least.
TIMES = 2
#: Counts of a point.
DIMS = 32
#: Letters of the points of a cell (a cell has that many by its words' length), and queries of a task for each point of a cell.
CELL_LETTERS, QUERIES = 400_000, 4
#: Vocabulary words, the first by hash, whose points place the cells, and the fewest of them in a cell.
SAMPLE, LEAST = 100_000, 4
#: Points that are compared with each query that reaches them.
_LEAF = 32

#: The places of an edit that isn't used yet, or isn't allowed.
_FREE, _NEVER = -1, -2
_POINT, _SAME, _LONGER = 0, 1, 2


def cell_words(length: int) -> int:
    return max(1, CELL_LETTERS // length)


def slipped(run: Column, doc_id: Column, slips: int = SLIPS) -> Column:
    """The run, without one letter where ``slips`` divides the crc32 of ``<doc_id>:<run>``; a null doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slips == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, slips: int = SLIPS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all whole texts. Null texts have none."""
    lower = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    # A slip takes one letter at most.
    runs = runs.where(F.length("run") >= min_length)
    words = runs.select(slipped(F.col("run"), F.col("doc_id"), slips).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts of each word, and its letters (all below 256), padded with zeros."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(row * DIMS + flat % DIMS, minlength=len(words) * DIMS).reshape(-1, DIMS).astype(np.int32)
    letters = np.zeros((len(words), int(sizes.max(initial=0))), np.uint8)
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return counts, letters


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """(dimension, greatest value on the left) through the middle of the widest dimension; None if all points are one."""
    spread = counts.var(axis=0)
    d = int(spread.argmax())
    if spread[d] == 0:
        return None
    values = counts[:, d]
    t = int(np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2])
    return d, t if t < values.max() else t - 1


@dataclass
class Queries:
    """Queries on their way down a tree: rows of a count matrix, and the dimensions in which they gain and lose a letter."""

    row: np.ndarray
    gain: np.ndarray
    lose: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    @staticmethod
    def of(row: np.ndarray, may_gain: np.ndarray) -> Queries:
        return Queries(row, np.where(may_gain, _FREE, _NEVER).astype(np.int8), np.full(len(row), _FREE, np.int8))

    def split(self, counts: np.ndarray, d: int, t: int) -> tuple[Queries, Queries]:
        """Those whose box reaches the points up to ``t`` in dimension ``d``, and those that reach the others."""
        v = counts[self.row, d] + (self.gain == d) - (self.lose == d)
        loses, gains = (v == t + 1) & (self.lose == _FREE), (v == t) & (self.gain == _FREE)
        left, right = (v <= t) | loses, (v > t) | gains
        return (
            Queries(self.row[left], self.gain[left], np.where(loses, d, self.lose)[left].astype(np.int8)),
            Queries(self.row[right], np.where(gains, d, self.gain)[right].astype(np.int8), self.lose[right]),
        )


@dataclass
class Cells:
    """The upper levels of one length's tree: split nodes as (dimension, value, left, right), leaves as their number."""

    nodes: list = field(default_factory=lambda: [0])
    leaves: int = 1

    @staticmethod
    def fit(sample: np.ndarray, wanted: int) -> Cells:
        """A tree of about ``wanted`` leaves, each with LEAST of the sample's points or more."""
        out = Cells([None], 0)
        stack = [(0, np.arange(len(sample)), wanted)]
        while stack:
            at, rows, parts = stack.pop()
            cut = best_split(sample[rows]) if parts > 1 and len(rows) >= 2 * LEAST else None
            if cut is None:
                out.nodes[at] = out.leaves
                out.leaves += 1
                continue
            left = sample[rows, cut[0]] <= cut[1]
            out.nodes[at] = (*cut, len(out.nodes), len(out.nodes) + 1)
            out.nodes += [None, None]
            share = min(max(round(parts * left.mean()), 1), parts - 1)
            stack += [(len(out.nodes) - 2, rows[left], share), (len(out.nodes) - 1, rows[~left], parts - share)]
        return out

    def reached(self, counts: np.ndarray, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of the queries that reach it)."""
        stack = [(0, queries)]
        while stack:
            at, q = stack.pop()
            if not len(q):
                continue
            node = self.nodes[at]
            if isinstance(node, int):
                yield node, q.row
                continue
            left, right = q.split(counts, *node[:2])
            stack += [(node[2], left), (node[3], right)]


_ONE = Cells()


def _counted(words: pa.Array) -> pa.Array:
    counts = points(words.to_pylist())[0] if len(words) else np.empty((0, DIMS), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * DIMS), pa.array(counts.ravel()))


def fit_cells(words: DataFrame) -> dict[int, Cells]:
    """The cells of each length that has too many words for one, by the points of SAMPLE words at most."""
    length = F.length("word")
    many = words.groupBy(length.alias("length")).agg(F.count("*").alias("n")).where(F.col("n") * F.col("length") > CELL_LETTERS)
    # Only lengths with a full cell come back, with two numbers each.
    wanted = {r["length"]: -(-r["n"] // cell_words(r["length"])) for r in many.collect()}
    wanted = {k: n for k, n in wanted.items() if n > 1}
    if not wanted:
        return {}

    @F.arrow_udf("array<int>")
    def counted(x: pa.Array) -> pa.Array:
        return _counted(x)

    chosen = words.where(length.isin(*wanted)).orderBy(F.xxhash64("word"), "word").limit(SAMPLE)
    # At most SAMPLE rows of DIMS counts.
    rows = chosen.select(length.alias("length"), counted("word").alias("counts")).toArrow()
    lengths = rows["length"].to_numpy()
    counts = np.asarray(rows["counts"].combine_chunks().values).reshape(-1, DIMS)
    return {k: Cells.fit(counts[lengths == k], n) for k, n in wanted.items()}


def deal(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(word, n, length, leaf, role): every word as a point of its cell and as a query of the cells that it reaches."""

    @F.arrow_udf("array<struct<length:int,leaf:int,role:int>>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = batch.to_pylist()
            if not words:
                yield pa.array([], pa.list_(pa.struct([("length", pa.int32()), ("leaf", pa.int32()), ("role", pa.int32())])))
                continue
            counts = points(words)[0]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            found = []
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                no, yes = np.zeros(len(at), bool), np.ones(len(at), bool)
                nowhere = Queries(at, np.full(len(at), _NEVER, np.int8), np.full(len(at), _NEVER, np.int8))
                for tree, role, q in ((size, _POINT, nowhere), (size, _SAME, Queries.of(at, yes)), (size - 1, _LONGER, Queries.of(at, no))):
                    for leaf, rows in cells.get(tree, _ONE).reached(counts, q):
                        found.append((rows, np.full(len(rows), tree, np.int32), np.full(len(rows), leaf, np.int32), np.full(len(rows), role, np.int32)))
            row, length, leaf, role = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(row, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(words)))].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x[order]) for x in (length, leaf, role)], ["length", "leaf", "role"]))

    return words.withColumn("place", F.explode(places("word"))).select("word", "n", "place.*")


def parted(dealt: DataFrame) -> DataFrame:
    """``dealt`` with ``i`` and ``j``: the part of its cell's points and of its queries that each row goes with.

    Cells with more points than planned (equal points can't be split by a tree)
    or with many queries have several parts of bounded size, chosen by hash;
    every part of the points meets every part of the queries.
    """
    cell = ["length", "leaf"]
    most = F.greatest(F.lit(1), F.floor(F.lit(CELL_LETTERS) / F.greatest(F.col("length"), F.lit(1)))).cast("long")
    many = dealt.groupBy(*cell).agg(F.sum((F.col("role") == _POINT).cast("long")).alias("p"), F.sum((F.col("role") != _POINT).cast("long")).alias("q"))
    # Cells without a point or without a query find nothing.
    many = many.where("p > 0 AND q > 0").select(*cell, F.ceil(F.col("p") / most / 2).alias("is"), F.ceil(F.col("q") / most / QUERIES).alias("js"))
    rows = dealt.join(many, cell)
    part = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    point = F.col("role") == _POINT
    rows = rows.withColumns({"is": F.when(point, F.array(part("is"))).otherwise(every("is")), "js": F.when(point, every("js")).otherwise(F.array(part("js")))})
    return rows.withColumn("i", F.explode("is")).withColumn("j", F.explode("js")).select("word", "n", *cell, "role", "i", "j")


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of ``a``, one letter longer, are those of ``b`` with a letter put in."""
    size = b.shape[1]
    before, after = a[:, :size] != b, a[:, 1 : size + 1] != b
    equal_to = np.where(before.any(axis=1), before.argmax(axis=1), size)
    equal_from = np.where(after.any(axis=1), size - after[:, ::-1].argmax(axis=1), 0)
    return equal_from <= equal_to


def near_pairs(words: list[str], is_point: np.ndarray, may_gain: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) rows of the near words in a cell of ``length``.

    Rows are points or queries; a query that may gain a letter has ``length``
    letters and finds those with one replaced, others are one longer and find
    those with one deleted.
    """
    counts, letters = points(words)
    # Counts in unary, two bits each: an edit changes two bits at most.
    mask = ((np.minimum(counts, 2) + (counts >= 2)).astype(np.uint64) << (2 * np.arange(DIMS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    asked = np.flatnonzero(~is_point)
    stack = [(np.flatnonzero(is_point), Queries.of(asked, may_gain[asked]))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    block = max(1, 8_000_000 // max(length, 1))
    while stack:
        p, q = stack.pop()
        if not len(q) or not len(p):
            continue
        cut = best_split(counts[p]) if len(p) > _LEAF else None
        if cut is not None:
            left, right = q.split(counts, *cut)
            low = counts[p, cut[0]] <= cut[1]
            stack += [(p[low], left), (p[~low], right)]
            continue
        step = max(1, 2_000_000 // len(p))
        for at in range(0, len(q), step):
            rows = q.row[at : at + step]
            x, y = np.nonzero(np.bitwise_count(mask[rows][:, None] ^ mask[p][None, :]) <= 2)
            a, b = rows[x], p[y]
            for k in range(0, len(a), block):
                a1, b1 = a[k : k + block], b[k : k + block]
                same = may_gain[a1]
                good = np.zeros(len(a1), bool)
                good[same] = _one_replaced(letters[a1[same], :length], letters[b1[same], :length])
                if not same.all():
                    good[~same] = _one_more(letters[a1[~same], : length + 1], letters[b1[~same], :length])
                found.append((a1[good], b1[good]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (asked[:0], asked[:0])


def _found_in_cell(rows: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of a cell's part: near words counted, and the most frequent (the least of equals)."""
    words, n, role = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["role"].to_numpy()
    a, b = near_pairs(words, role == _POINT, role == _SAME, rows["length"][0].as_py())
    # Words of one length find each other; shorter ones learn of longer ones here.
    longer = role[a] == _LONGER
    of, other = np.r_[a, b[longer]], np.r_[b, a[longer]]
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    sort = np.lexsort((order[other], -n[other], of))
    of, other = of[sort], other[sort]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    near = np.diff(np.r_[first, len(of)])
    text = lambda at: pa.array([words[i] for i in at], pa.string())
    return pa.table({"word": text(of[first]), "n_near": pa.array(near, pa.int64()), "best_n": pa.array(n[other[first]], pa.int64()), "best": text(other[first])})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) that has near words."""
    dealt = written(deal(words, fit_cells(words)), "spelling-dealt")
    parts = parted(dealt).groupBy("length", "leaf", "i", "j").applyInArrow(_found_in_cell, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first")).select("word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's way along ``links`` (word, form).

    Forms are more frequent than their words, so ways end; each round doubles the
    steps. Rounds are written tables, nothing is collected but "any left?".
    """
    now = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, slips: int = SLIPS, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words have MIN_LENGTH letters and MIN_COUNT occurrences or more over all
    texts. Null, empty and wordless texts have no words; a null doc_id is written
    as nothing in the slips' hash. Rows count each, also rows that repeat. Texts
    and words have any length. Words of equal frequency are taken by code points.
    Other columns are ignored. An empty table gives no rows.
    """
    words = written(vocabulary(docs, slips), "spelling-words")
    near = near_words(words)
    rows = words.join(near, "word", "left")
    good = F.col("best_n") >= times * F.col("n")
    rows = written(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words meet on what is left of them without one letter.
ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), occ AS (
  SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END))),
    lambda c, b: xor(c >> 8, list_reduce([(xor(c, b) & 255), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))) AS h
  FROM occ
), typed AS (
  SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) OVER w AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, other, other_n FROM pairs WINDOW w AS (PARTITION BY word)
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN other_n >= {TIMES} * n THEN other END AS form, CASE WHEN other_n >= {TIMES} * n THEN other_n END::BIGINT AS form_n
  FROM words LEFT JOIN best ON best.word = words.word AND place = 1
), ways AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT forms.word, ways.root FROM forms JOIN ways ON forms.form = ways.word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ways USING (word)
"""
