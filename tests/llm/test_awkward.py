"""Each operator and stage on awkward and on empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwatch.llm import decontamination, html_text, licenses, line_crf, line_dedup, mixing, near_dup, quality_rules, toxicity, warc_zip
from tests.llm.helpers import CLASHING, awkward, empty, prose, rows_of


def benchmark(spark):
    return spark.createDataFrame([(1, prose(10).split("\n")[2]), (1, prose(10).split("\n")[2]), (2, None), (3, ""), (4, "too short"), (None, prose(55, 1))], "item_id long, text string")


def labels(spark):
    rows = [(i, i % 2, i % 2) for i in (4, 5, 6, 10, 20, 21, 22, 30)] + [(None, 1, 1), (10, None, None), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/a b\n").alias("url"), *[c for c in docs.columns if c not in ("doc_id", "html")], F.col("text").alias("html"))


OPERATORS = {
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "html": lambda s, d: html_text.main_text(pages(d)).select("page_id", "url", "text", "n_chars"),
    "crf": lambda s, d: line_crf.quality_scores(d, labels(s)),
    "rules": lambda s, d: quality_rules.judge_documents(d),
    "warc": lambda s, d: warc_zip.archive_round_trip(pages(d)),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)),
    "mixing": lambda s, d: mixing.mix_documents(d),
    "leaks": lambda s, d: decontamination.find_leaks(d, benchmark(s)),
    "near": lambda s, d: near_dup.near_duplicates(d),
}
ONE_ROW_EACH = ("html", "crf", "rules", "warc", "lines", "toxicity", "mixing", "near")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    out = OPERATORS[name](spark, docs)
    first, second = rows_of(out), rows_of(OPERATORS[name](spark, docs))
    assert first == second
    if name in ONE_ROW_EACH:
        key = "page_id" if name in ("html", "warc") else "doc_id"
        assert rows_of(out.select(key)) == rows_of(docs.select("doc_id"))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


def test_without_labels_or_items(spark):
    docs = awkward(spark)
    none = labels(spark).where("false")
    assert {r["score"] for r in line_crf.quality_scores(docs, none).collect()} == {0.5}
    assert all(r["score"] < 1e-9 and r["predicted"] == 0 for r in toxicity.toxicity_scores(docs, none).collect())
    assert decontamination.find_leaks(docs, benchmark(spark).where("false")).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward(spark)
    out = stage(spark, docs, str(tmp_path))
    assert out.collect() is not None
    assert stage(spark, empty(spark), str(tmp_path)).collect() == []
    if name != "mixing":
        assert out.columns == docs.columns
        assert all(r[c] == "mine" for r in out.collect() for c in CLASHING)


def test_results_of_null_and_empty(spark):
    docs = awkward(spark)
    near = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    assert near[None]["kept"] and near[None]["component_id"] is None
    assert near[1]["n_shingles"] == near[2]["n_shingles"] == near[3]["n_shingles"] == 0 and near[2]["kept"]
    assert near[4]["n_shingles"] == 1
    assert [near[i]["component_id"] for i in (10, 20, 21, 22)] == [10] * 4
    assert [near[i]["kept"] for i in (10, 20, 21, 22)] == [True, False, False, False]
    rules = [r for r in quality_rules.judge_documents(docs).collect() if r["doc_id"] in (1, 2, 3)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in rules)
    mixed = [r for r in mixing.mix_documents(docs).collect()]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs.where("doc_id >= 10 or doc_id < 4")).collect()}
    assert lines[1]["text"] is None and lines[2]["text"] == "" and lines[3]["text"] == " \t\n\r\n "
    assert lines[10]["n_removed"] == 0 and lines[20]["text"] == "" and lines[22]["n_removed"] == 0 or lines[22]["n_removed"] < 6
    held = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels(spark)).collect()}
    assert all(0 <= v <= 1 for v in held.values())


def test_two_texts_of_one_doc_id_join_their_groups(spark):
    a, b = prose(301), prose(302)
    docs = spark.createDataFrame([(6, a), (6, b), (7, a), (3, b), (9, prose(303))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (6, 3, False), (6, 3, False), (7, 3, False), (9, 9, True)]
