"""Operators that SQL can't express, against plain Python or by held-out accuracy."""

from __future__ import annotations

import html
import io
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwatch.llm import catalog, decontamination, near_dup, quality_rules, warc_zip
from linkwatch.llm.common import read_table
from linkwatch.llm.components import connected_components
from linkwatch.llm.html_text import article_text
from linkwatch.llm.line_crf import LineField
from tests.llm.helpers import DOCS, prose

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain_groups(texts: dict[int, str], size: int, percent: int) -> dict[int, int]:
    """Least doc_id of each component, by all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        w = plain_words(w)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    of = {}
    for i, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in of.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    docs = read_table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, near_dup.Plan(size, percent)).collect()}
    assert got == plain_groups(texts, size, percent)


def test_near_copies_around_the_threshold(spark):
    """One text with more and more words changed, in one bucket for the most part."""
    rng, base = random.Random(3), prose(3, 10, 15).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(0, 9)):
            w[k] = f"new{rng.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(w), "en", "a", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == plain_groups({r[0]: r[1] for r in rows}, 3, 85)


def test_pruning_keeps_linked_pairs():
    """The least matches let pass nearly all pairs at the threshold, and few at a half."""
    steps, rng = near_dup.Plan().least_matches(), np.random.default_rng(1)
    n = steps[-1][0]
    for chance, least, most in ((0.85, 0.9999, 1.0), (0.5, 0.0, 0.01)):
        a = np.zeros((5000, n), np.uint32)
        b = (rng.random((5000, n)) > chance).astype(np.uint32)
        alive, _ = near_dup.alike(a, b, steps)
        assert least <= len(alive) / 5000 <= most


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 200 for i in range(200, 260)}


def test_rule_counts_by_hand(spark):
    docs = read_table(spark, SF, "documents")
    out = {r["doc_id"]: r for r in quality_rules.judge_documents(docs).collect()}
    for r in docs.collect():
        w, lines = plain_words(r["text"]), [x for x in r["text"].split("\n") if plain_words(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        got = out[r["doc_id"]]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"]), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got["base_failed"] and got["kept"])


def test_label_model_finds_the_unreliable_rule():
    rng, k = random.Random(2), len(quality_rules.RULES)
    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = []
        for j in range(k):
            reject = rng.random() < ((0.5 if j == 1 else 0.02) if good else (0.5 if j == 1 else 0.9))
            votes.append(0 if rng.random() < 0.2 else -1 if reject else 1)
        patterns[tuple(votes)] += 1
    m = quality_rules.fit_label_model(list(patterns.items()))
    assert abs(m.prior - 0.8) < 0.03
    assert abs(m.reject_good[1] - m.reject_bad[1]) < 0.1
    assert m.reject_bad[0] > 0.8 and m.reject_good[0] < 0.05


@pytest.mark.parametrize("name, label, least", [("op3_quality_crf", "quality", 0.95), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    out = catalog.queries()[name](spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out")
    rows = out.select("predicted", label).collect()
    assert len(rows) > 30
    assert sum(a == b for a, b in rows) / len(rows) >= least


def test_marginals_equal_enumeration():
    moves, potentials = np.array([[0.3, -0.2], [0.1, 0.6]]), np.array([0.5, -1.0, 0.2, 0.9])
    field = LineField(np.zeros(1), np.ones(1), np.zeros(1), moves, (1.0, 0.0))
    total, good = 0.0, np.zeros(4)
    for bits in range(16):
        y = [bits >> k & 1 for k in range(4)]
        p = np.exp(sum(potentials[k] * y[k] for k in range(4)) + sum(moves[y[k], y[k + 1]] for k in range(3)))
        total, good = total + p, good + p * np.array(y)
    assert np.allclose(field.marginals(potentials), good / total)


def test_article_of_the_test_pages(spark):
    """The pages hold their article in one element, so a pattern can cut it out."""
    for r in read_table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        parts = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(?:p|h1)>", "\0", body.replace("<br>", " "))).split("\0")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert article_text(r["html"]) == want


def test_article_among_other_parts():
    page = """<body><div class=top-menu><a href=a>A menu that goes on for long</a></div><div><div id=story><h2>Head &lt;1&gt;</h2>
      <p>Some   long text of an article, <a href=b>with a link</a> and <b>bold</b> words, long enough.</p><ul><li>one<li>two</ul>
      <div class="ad-box">Buy this now</div><p>The end&nbsp;of it<script>var x = "<p>no</p>";</script>.</p></div></div>
      <aside>Aside text</aside><div class="comments"><p>Readers say a lot of things here, in long and winding sentences.</p></div></body>"""
    assert article_text(page).split("\n") == ["Head <1>", "Some long text of an article, with a link and bold words, long enough.", "one", "two", "The end of it."]
    assert article_text("<p>cut <a hre") == "cut"
    assert article_text("<div>" * 3000 + "deep") == "deep"


def test_zip_directories():
    """Plain and ZIP64 directories, with comments and with more entries than fit 16 bits."""
    for many in (0, 70_000):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            z.comment = b"PK\x05 not the end"
            with z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
                f.write(b"records")
            for k in range(many):
                z.writestr(zipfile.ZipInfo(str(k)), b"")
        members = warc_zip.directory(raw, len(raw.getvalue()))
        assert len(members) == many + 1
        at, size = warc_zip.member_range(raw, members["archive/data.warc.gz"])
        assert raw.getvalue()[at : at + size] == b"records"
    # Numbers over 32 bits stand in the extra field.
    extra = struct.pack("<2H3Q", 1, 24, 5 << 32, 5 << 32, 6 << 32)
    entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"x" + extra
    tail = entry + struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    tail += struct.pack("<4sLQL", b"PK\x06\x07", 0, len(entry), 1) + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.directory(io.BytesIO(tail), len(tail)) == {"x": (0, 6 << 32, 5 << 32)}


def test_records_round_trip():
    for kind in ("response", "revisit"):
        record = warc_zip.warc_record(7, "http://a/ä b", b"<p>\r\n\r\nx</p>", "8a" * 20, kind, 9 if kind == "revisit" else None)
        row = warc_zip.parse_record(record)
        assert (row["page_id"], row["payload_bytes"], row["record_type"], row["refers_to"]) == (7, 12, kind, 9 if kind == "revisit" else None)
        assert row["intact"] == (kind == "revisit")  # the digest above isn't that of the payload


def test_leaks_with_changes(spark):
    item = prose(77, 1, 40)
    w = item.split(" ")
    one = w[:20] + ["other"] + w[21:]
    many = [x if k % 6 else "other" for k, x in enumerate(w)]
    texts = {1: f"{prose(1)} {item.upper()} {prose(2)}", 2: f"{prose(3)}\n{' '.join(one)}\n{prose(4)}", 3: " ".join(many) + prose(5), 4: prose(6), 5: " ".join(w[:36]), 6: " ".join(w[:20])}
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], DOCS)
    bench = spark.createDataFrame([(9, item), (8, prose(78, 1, 30))], "item_id long, text string")
    got = {r["doc_id"]: round(r["similarity"], 3) for r in decontamination.find_leaks(docs, bench, 0.75).collect()}
    assert got == {1: 1.0, 2: round(31 / 41, 3), 5: round(32 / 36, 3)}


def test_simhash_and_blocks(spark):
    """Each pair of fingerprints within the radius shares a listed block value."""
    rng = random.Random(5)
    words = [w for w in prose(9).split()]
    row = spark.createDataFrame([(words,)], "w array<string>").select(decontamination.simhash(F.col("w")).alias("p"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")).first()
    want = 0
    for b in range(64):
        if sum(h >> b & 1 for h in row["h"]) > len(words) / 2:
            want |= 1 << b
    assert row["p"] % 2**64 == want
    size = 64 // decontamination.BLOCKS
    for _ in range(200):
        flips = sum(1 << k for k in rng.sample(range(64), decontamination.RADIUS))
        assert any((flips >> size * b & ((1 << size) - 1)).bit_count() <= decontamination.RADIUS // decontamination.BLOCKS for b in range(decontamination.BLOCKS))


def test_pipeline_against_plain_python(spark):
    """Stage by stage on the small tables: what each must drop is dropped, and no more."""
    docs = read_table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in quality_rules.judge_documents(docs).where("kept").collect()}
    one = stages["quality_rules"](spark, docs, SF)
    assert {r["doc_id"] for r in one.collect()} == kept
    three = stages["near_dedup"](spark, one, SF)
    groups = plain_groups({r["doc_id"]: r["text"] for r in one.collect()}, 5, 80)
    assert {r["doc_id"] for r in three.collect()} == {i for i, g in groups.items() if i == g}
    four = stages["decontamination"](spark, three, SF)
    bench = [" ".join(plain_words(r["text"])) for r in read_table(spark, SF, "benchmark").collect()]
    whole = {r["doc_id"] for r in three.collect() if any(b in " ".join(plain_words(r["text"])) for b in bench)}
    left = {r["doc_id"] for r in four.collect()}
    assert whole and not whole & left
    assert left | whole == {r["doc_id"] for r in three.collect()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 0
