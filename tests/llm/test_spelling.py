"""Spelling variants against SQL and all pairs in plain Python."""

from __future__ import annotations

import binascii
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from linkwatch.llm import spelling
from tests.llm.helpers import awkward, empty, rows_of
from tools.oracle_check import _rows, duck

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans(spelling._UPPER, spelling._LOWER)


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs):
    """The whole operator in plain Python; docs are (doc_id, text)."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(ASCII_LOWER)
            h = binascii.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % spelling.SLIPS == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words]


def variants(seed: int, n: int = 60):
    """Words with variants, chains of them, anagrams, letters beyond ASCII and long words."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßÀ÷") for _ in range(rng.randint(5, 9))) for _ in range(n)] + ["ab" * 300, "ab" * 300 + "c", "÷××÷×"]
    base += ["".join(p) for p in itertools.islice(itertools.permutations("abcdef"), 80)]
    words = list(base)
    for w in base:
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("abcdeé")
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    return [(i, " ".join(rng.choice([w.upper(), w] if w.isascii() else [w]) + rng.choice([" ", "1", "\n"]) for w in rng.choices(words, weights=[1 + 40 / (1 + k) for k in range(len(words))], k=300))) for i in range(12)]


@pytest.mark.parametrize("letters", [spelling.CELL_LETTERS, 200, 20])
def test_equals_plain_python(spark, monkeypatch, letters):
    """With cells of the usual size, with trees, and with cells of a few words and parts of them."""
    monkeypatch.setattr(spelling, "CELL_LETTERS", letters)
    docs = [*variants(1), (None, "abcde " * 4), (50, None), (51, ""), (51, "abcdf abcdf abcdf abcdff")]
    got = spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got) == sorted(plain(docs), key=repr)


def test_equal_points_in_many_parts(spark, monkeypatch):
    """Anagrams are one point, which no tree splits."""
    monkeypatch.setattr(spelling, "CELL_LETTERS", 60)
    words = ["".join(p) for p in itertools.islice(itertools.permutations("abcdef"), 200)] + ["abcdeg", "abcde", "abcdfee"]
    docs = [(i, " ".join(words)) for i in range(4)]
    got = spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got) == sorted(plain(docs), key=repr)


def test_equals_sql_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_LETTERS", 900)
    df = spelling.spelling_groups(spark.read.parquet(f"{SF}/documents.parquet"))
    rel = duck(SF).sql(spelling.ORACLE_SQL)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_boxes_reach_every_near_word():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcdef") for _ in range(rng.choice([6, 7]))) for _ in range(1500)})
    short = [w for w in words if len(w) == 6]
    counts = spelling.points(words)[0]
    cells = spelling.Cells.fit(counts[[len(w) == 6 for w in words]], 40)
    assert cells.leaves > 20
    leaf = {}
    for n, rows in cells.reached(counts, spelling.Queries(np.arange(len(words)), *(np.full(len(words), -2, np.int8),) * 2)):
        leaf |= {int(i): n for i in rows}
    reached = {}
    for n, rows in cells.reached(counts, spelling.Queries.of(np.arange(len(words)), np.array([len(w) == 6 for w in words]))):
        for i in rows.tolist():
            assert n not in reached.setdefault(i, set())
            reached[i].add(n)
    at = {w: i for i, w in enumerate(words)}
    for a in words:
        assert all(leaf[at[b]] in reached[at[a]] for b in short if one_edit(a, b) and len(b) <= len(a))
    assert np.mean([len(x) for x in reached.values()]) < cells.leaves / 2


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = rows_of(spelling.spelling_groups(docs))
    assert got == sorted(plain([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    assert spelling.spelling_groups(empty(spark)).collect() == []
