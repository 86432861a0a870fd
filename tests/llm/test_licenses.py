"""Notices that no line, paragraph or whole text holds by itself."""

from __future__ import annotations

import re
import textwrap

import pytest

from linkwatch.llm import licenses
from tests.llm.helpers import DOCS, prose


def grams(words):
    return set(zip(words, words[1:]))


def plain_runs(text):
    """Licence -> Dice of the best run of words, by all runs of each template's sizes."""
    w, out = re.sub("[^a-z0-9]+", " ", text.lower()).split(), {}
    for name, body in licenses.TEMPLATES + licenses.NOTICES:
        v = re.sub("[^a-z0-9]+", " ", body.lower()).split()
        t = grams(v)
        for i in range(len(w)):
            for j in range(i + 2, min(len(w), i + 1 + int((len(v) - 1) * 1.5 + 1e-9)) + 1):
                if w[i : i + 2] and tuple(w[i : i + 2]) in t and tuple(w[j - 2 : j]) in t:
                    g = grams(w[i:j])
                    dice = 2 * len(g & t) / (len(g) + len(t))
                    if dice >= licenses.THRESHOLD:
                        out[name] = max(out.get(name, 0), dice)
    return out


def test_notices_over_paragraphs_and_in_prose(spark):
    body = {name: text for name, text in licenses.TEMPLATES + licenses.NOTICES}
    mit = body["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    gpl = "\n\n".join(re.split(r"(?<=version\.) ", body["GPL-3.0"]))
    texts = {
        1: f"{mit}\n\n{prose(1)}",
        2: f"{prose(2)}\n\n{gpl}\n\n{prose(3)}",
        3: "We hope that you enjoyed reading this. Licensed under CC BY 4.0.",
        4: textwrap.fill(f"{prose(4, 2)} {body['MPL-2.0']} {prose(5, 2)}", 72),
        5: "\n".join(f"# {x}" for x in textwrap.wrap(f"{prose(6, 1)} {body['BSD-3-Clause']}", 60)) + "\n" + prose(7),
        6: f"{prose(8)} {body['GPL-2.0']} {prose(9)}",
        7: prose(10),
        8: f"{prose(11, 1)} {body['LGPL-3.0'].replace('hope', 'very good hope')} {prose(12, 1)}",
    }
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()] + [(None, texts[3], "en", "a", 1)], DOCS)
    rows = licenses.scan_licenses(docs).collect()
    got = {(r["doc_id"], r["license"]): r["dice"] for r in rows}
    assert {(1, "MIT"), (2, "GPL-3.0"), (3, "CC-BY-4.0"), (None, "CC-BY-4.0"), (4, "MPL-2.0"), (5, "BSD-3-Clause"), (6, "GPL-2.0"), (8, "LGPL-3.0")} <= set(got)
    assert {r["span_kind"] for r in rows} == {"words"}
    want = {(i, name): d for i, t in texts.items() for name, d in plain_runs(t).items()}
    want |= {(None, name): d for name, d in plain_runs(texts[3]).items()}
    assert got == pytest.approx(want)
    assert next(r["span_no"] for r in rows if r["doc_id"] == 3 and r["license"] == "CC-BY-4.0") == 7


def test_whole_lines_come_first(spark):
    docs = spark.createDataFrame([(1, f"{prose(1)}\nLicensed under the MIT License. Enjoy\n{prose(2)}", "en", "a", 1)], DOCS)
    assert [(r["license"], r["span_kind"]) for r in licenses.scan_licenses(docs).collect()] == [("MIT", "line")]
