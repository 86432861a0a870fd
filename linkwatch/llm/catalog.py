"""The registered queries of the corpus operators, one for each, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from linkwatch.llm import decontamination, divergence, html_text, licenses, line_crf, line_dedup, mixing, near_dup, pieces, quality_rules, spelling, toxicity, warc_zip
from linkwatch.llm.common import read_table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its lines."""
    return line_crf.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the voting rules for every document."""
    return quality_rules.judge_documents(read_table(spark, sf_dir, "documents"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to ZIP packages and read back."""
    out = warc_zip.archive_round_trip(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stood earlier."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression."""
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by every document."""
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and the text they stand for, as digests."""
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.piece_digests(read_table(spark, sf_dir, "documents"), model)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the others of its language, and its own terms."""
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_licenses, op2_html_text, op3_quality_crf, op4_quality_rules, op5_warc_zip, op6_line_dedup, op7_toxicity, op8_mixing, op9_decontamination, op10_near_dup, op11_pieces, op12_spelling, op13_divergence)
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.ORACLE_SQL,
        "op5_warc_zip": warc_zip.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
        "op9_decontamination": decontamination.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
        "op13_divergence": divergence.ORACLE_SQL,
    }
