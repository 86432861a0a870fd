"""MinHash near-duplicates with sequential Bayesian verification.

Texts are sets of word shingles. Equal sets are one class, so copies cost no
comparisons. MinHash bands propose pairs of classes; a pair is compared batch by
batch of its signature and dropped as soon as the posterior probability that
its similarity reaches the threshold is under ``MISS``; survivors are confirmed
on the full sets of the whole texts.

No bucket is expanded into all its pairs:

1. every class meets the first of its bucket;
2. classes that are still in other components than their bucket mates are compared
   within tasks, by blocks; each names its most similar mate of another component;
   this is repeated while it links any;
3. what then is still apart is compared again, and every surviving pair is confirmed
   within the task, which gets the full sets of the classes concerned and returns links only.

After that no pair that shares a bucket is left that could link two components.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import small_batches, written
from linkwatch.llm.components import connected_components
from linkwatch.llm.shingles import band_keys, shingle_set, signature, similar_at_least

#: Chance that a linked pair shares no band, and posterior below which a pair is dropped.
MISS = 1e-6
BAND_ROWS = 5
#: Signature values compared before each decision.
BATCH = 20
#: Classes of a bucket compared by one task at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Plan:
    """Shingle size, threshold in percent, and the numbers that follow from them."""

    shingle: int = 3
    percent: int = 85

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** BAND_ROWS))

    @property
    def values(self) -> int:
        return self.bands * BAND_ROWS

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, matches needed to go on).

        With a uniform prior, P(similarity >= t | m of n match) is the chance
        of at most m successes in n + 1 trials of probability t.
        """
        t = self.percent / 100
        out = []
        for n in [*range(BATCH, self.values, BATCH), self.values]:
            chance, m = (1 - t) ** (n + 1), 0
            while chance < MISS:
                m += 1
                chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, bands) of every row; without shingles the last three are null."""
    k, values = plan.shingle, plan.values

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingle_set(t, k) for t in f["text"]]
            sigs = [signature(x, values) if len(x) else None for x in sets]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "n_shingles": [len(x) for x in sets],
                    "set_key": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                    "sig": [None if x is None else x.tobytes() for x in sigs],
                    "bands": [None if x is None else band_keys(x, BAND_ROWS) for x in sigs],
                }
            )

    # The doc_id travels as text: pandas would make a number that may be null a float.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInPandas(of, "doc_id string, n_shingles long, set_key binary, sig binary, bands array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def alike(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of row pairs of two signature matrices: which survive every step, and their matches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in steps:
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1, dtype=np.int32)
        alive, done = alive[matches[alive] >= least], n
    return alive, matches


def likely_pairs(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose signatures leave a link possible."""
    steps, percent = plan.least_matches(), plan.percent
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "sig_a", "sig_b")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint32).reshape(len(f), -1) for c in ("sig_a", "sig_b"))
                yield f.iloc[alike(a, b, steps)[0]][["a", "b"]]

    return both.mapInPandas(of, "a long, b long")


def confirmed_pairs(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) linked by the full shingle sets of their whole texts."""
    k, percent = plan.shingle, plan.percent
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(node: int, text: str) -> np.ndarray:
            if node not in recent:
                recent[node] = shingle_set(text, k)
                if len(recent) > 256:
                    recent.popitem(last=False)
            return recent[node]

        for f in frames:
            linked = [similar_at_least(shingles(a, x), shingles(b, y), percent) for a, b, x, y in zip(f["a"], f["b"], f["text_a"], f["text_b"])]
            yield f[["a", "b"]][np.array(linked, bool)]

    return both.mapInPandas(of, "a long, b long")


def bucket_blocks(shared: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, i, j, band, own, node, root, n, sig): the classes of buckets that hold several components, by pairs of blocks.

    A class is in block ``own``, and comes once for each pair (i, j) its block is part of.
    """
    rows = shared.select("key", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rows = rows.join(open_.select("key", "c"), "key")
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "node", "root")
    return rows.join(nodes.select("node", "n", "sig"), "node").select("key", "i", "j", "band", "own", "node", "root", "n", "sig")


def likely_in_block(g: pd.DataFrame, steps: list[tuple[int, int]], percent: int) -> np.ndarray:
    """(x, y, matches): row pairs of one pair of blocks, in different components, that the signatures leave possible."""
    sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), -1)
    root, n, own = (g[c].to_numpy() for c in ("root", "n", "own"))
    i, j = g["i"].iat[0], g["j"].iat[0]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = [np.empty((0, 3), np.int64)]
    for x in left:
        others = right[right > x] if i == j else right
        others = others[(root[others] != root[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
        if len(others):
            alive, matches = alike(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], steps)
            found.append(np.column_stack([np.full(len(alive), x), others[alive], matches[alive]]))
    return np.concatenate(found)


def by_group(blocks: DataFrame, of_group, schema: str) -> DataFrame:
    """``of_group`` applied to each (key, i, j), with a task's small groups handed over together."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last group of a batch may go on in the next
        for f in frames:
            f = f if rest is None else pd.concat([rest, f])
            if not len(f):
                continue
            names = f[["key", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1)]
            out = [of_group(f.iloc[s:e]) for s, e in zip(cuts, cuts[1:])]
            rest = f.iloc[cuts[-1] :]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest):
            yield of_group(rest)

    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(of, schema)


def _ordered(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def best_mates(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): for each class of a group its most similar mate of another component.

    The most similar mate of all is so in every bucket that both share; it is
    named in the first of these only.
    """
    steps, percent = plan.least_matches(), plan.percent

    def of_group(g: pd.DataFrame) -> pd.DataFrame:
        p, node = likely_in_block(g, steps, percent), g["node"].to_numpy()
        p = np.concatenate([p, p[:, [1, 0, 2]]])
        p = p[np.lexsort((node[p[:, 1]], -p[:, 2], p[:, 0]))]
        p = _first_band(g, p[np.unique(p[:, 0], return_index=True)[1]])
        return _ordered(node[p[:, 0]], node[p[:, 1]])

    return by_group(blocks, of_group, "a long, b long").distinct()


def undecided(blocks: DataFrame, plan: Plan) -> DataFrame:
    """The rows of ``blocks``, without signatures, that are in a likely pair whose first common band is this one."""
    steps, percent = plan.least_matches(), plan.percent

    def of_group(g: pd.DataFrame) -> pd.DataFrame:
        p = _first_band(g, likely_in_block(g, steps, percent))
        return g.iloc[np.unique(p[:, :2])][["key", "i", "j", "band", "own", "node", "root"]]

    return by_group(blocks, of_group, "key long, i int, j int, band int, own int, node long, root long")


def _first_band(g: pd.DataFrame, p: np.ndarray) -> np.ndarray:
    """The pairs that no earlier bucket has in common."""
    sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), -1, BAND_ROWS)
    first = [(sig[x] == sig[y]).all(axis=1).argmax() for x, y, _ in p]
    return p[np.array(first, int) == g["band"].iat[0]]


def links_in_blocks(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): the likely pairs of each group, confirmed on their full sets within the task."""
    steps, percent = plan.least_matches(), plan.percent

    def of_group(g: pd.DataFrame) -> pd.DataFrame:
        p, node = _first_band(g, likely_in_block(g, steps, percent)), g["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        linked = np.array([similar_at_least(sets[x], sets[y], percent) for x, y, _ in p], bool)
        return _ordered(node[p[linked, 0]], node[p[linked, 1]])

    return by_group(blocks, of_group, "a long, b long").distinct()


def full_sets(texts: DataFrame, plan: Plan) -> DataFrame:
    """(node, shingles): the full set of each whole text."""
    k = plan.shingle

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "shingles": [shingle_set(t, k).tobytes() for t in f["text"]]})

    return texts.mapInPandas(of, "node long, shingles binary")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the least doc_id that links lead to. Null, empty and
    wordless texts have no shingles and are linked with nothing. A row without
    doc_id is linked with nothing and kept, its component_id null. Rows that
    repeat a doc_id stand for one document: it is linked by each of their texts.
    Other columns are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sketched = written(sketches(docs, plan), "near-sketches")
    named = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Classes of equal sets; the least doc_id stands for each.
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = named.join(classes.withColumn("doc_id", F.col("node")), ["doc_id", "set_key"])
    nodes = written(nodes.dropDuplicates(["node", "set_key"]).select("node", F.col("n_shingles").alias("n"), "sig", "bands"), "near-classes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    shared = written(buckets.join(hubs.select("key", "hub"), "key").select("key", "band", "node", "hub"), "near-buckets")
    likely = shared.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = written(texts.join(likely, "node"), "near-texts")

    first = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(likely_pairs(first, nodes, plan), "near-pairs")
    links = written(confirmed_pairs(tried, texts, plan), "near-links")
    while True:
        roots = connected_components(links, "near-roots")
        blocks = bucket_blocks(shared, nodes, roots)
        more = written(best_mates(blocks, plan).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        found = written(confirmed_pairs(more, texts, plan), "near-links")
        tried, links = tried.unionByName(more), links.unionByName(found)
        if found.isEmpty():
            break
    apart = written(undecided(blocks, plan), "near-apart")
    apart = apart.join(nodes.select("node", "n", "sig"), "node")
    apart = apart.join(full_sets(texts.join(apart.select("node").distinct(), "node"), plan), "node")
    links = links.unionByName(written(links_in_blocks(apart, plan), "near-links"))
    # Equal sets under two ids, and two sets under one id, join their documents too.
    member = written(named.join(classes, "set_key").select("doc_id", "node").distinct(), "near-member")
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    same = member.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    roots = connected_components(links.select("a", "b").unionByName(same), "near-roots")
    roots = member.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    of = roots.groupBy("doc_id").agg(F.min("root").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
