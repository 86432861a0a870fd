"""The corpus pipeline: quality, line dedup, near dedup, decontamination, mix.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns
a DataFrame; ``run`` writes each result as Parquet under ``spark.checkpoint.dir``
and reads it back as the next stage's documents. All but the last stage return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwatch.llm.common import read_table, written
from linkwatch.llm.decontamination import without_leaks
from linkwatch.llm.line_dedup import dedup_lines
from linkwatch.llm.mixing import mix_documents
from linkwatch.llm.near_dup import Plan, near_duplicates
from linkwatch.llm.quality_rules import keep_quality

#: Near duplicates of the pipeline: shingles of five words, similarity of 0.8 or more.
NEAR = Plan(shingle=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the voting rules keep."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stood earlier; those that lose every line go.

    ``n_chars`` is that of the new text.
    """
    cut = dedup_lines(docs)
    left = cut.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Rows that repeat a doc_id are one document and stay together.
    """
    kept = near_duplicates(docs, NEAR).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document that is left."""
    return mix_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: The label model of the first stage is fitted by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
