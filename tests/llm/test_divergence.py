"""Divergence of sources against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from linkwatch.llm import divergence
from tests.llm.helpers import awkward, empty, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, top=divergence.TOP):
    """The whole report in plain Python; docs are (text, lang, source)."""
    count, in_docs, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        count.update((lang, source, t) for t in terms)
        in_docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in in_docs.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        v = len(kept)
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 1) // (total[s] + v) for s in sources for t in kept}
        of_all = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (of_all[t] + 1) // (sum(of_all.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s, t], q[t]), t) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, x, n, k) for k, (n, x) in enumerate(rows, 1) if part == "pair" or k <= top]
    return sorted(out, key=repr)


def corpus(seed: int):
    rng = random.Random(seed)
    words = [w for w in "the of and Überall straße naïve data Data DATA x y z 漢字 né né2né \U0001f600 café ÀÉ the-end".split()] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    docs = []
    for i in range(120):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "d", "é", None, "A"])
        docs.append((" ".join(rng.choices(words, weights=[1 + (hash_of(w, source) % 9) for w in words], k=rng.randint(0, 80))), lang, source))
    return [*docs, ("", "de", "only"), (None, "de", "other"), ("rare once", "de", "third"), ("alone " * 9, "it", "a"), ("alone", "it", "a"), ("alone", "it", "a")]


def hash_of(word: str, source: str | None) -> int:
    return sum(map(ord, word)) * (1 + len(source or "")) + ord((source or "z")[0])


DDL = "text string, lang string, source string"


@pytest.mark.parametrize("bits, terms, sources", [(64, divergence.TERMS, divergence.SOURCES), (3, divergence.TERMS, divergence.SOURCES), (64, 5, 2), (4, 3, 1)])
def test_equals_plain_python(spark, monkeypatch, bits, terms, sources):
    """Also with digests that many terms share, and with many small blocks."""
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    docs = corpus(2)
    got = divergence.audit_sources(spark.createDataFrame(docs, DDL).repartition(3), bits=bits)
    assert rows_of(got) == plain(docs)


def test_ties_are_ranked_by_text(spark):
    """All terms are equally frequent; the first by code points are shown."""
    terms = [chr(97 + i) + chr(97 + j) for i in range(20) for j in range(20)] + ["é", "ÿ", "漢", "\U0001f600"]
    docs = [(" ".join(terms), "en", "a")] * 3 + [("other", "en", "b")] * 3
    got = divergence.audit_sources(spark.createDataFrame(docs, DDL))
    assert rows_of(got) == plain(docs)


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**15, 9 * 10**18 - 5, 3)], "c long, n long, v long").select(divergence.probability(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**15 + 1) // (9 * 10**18 - 2)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = rows_of(divergence.audit_sources(docs))
    assert got == plain([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert divergence.audit_sources(empty(spark)).collect() == []


def test_terms_of_bytes_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + " Aé\u00a0B\u2003c\u2028D1e_F\x85g \U0001f600É\x1cH\x00i"
    for t in (text, text * 3, "", "\x1c\x85", "z"):
        want = [x.translate(LOWER) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
        assert [x.decode() for x in divergence.terms_of(t.encode())] == want


def test_folders_of_the_counts_need_no_sort(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with divergence._unsorted(spark):
        assert int(spark.conf.get(key)) >= 2
    assert spark.conf.get(key) == before
