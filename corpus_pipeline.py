"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm import decontamination, jaccard, mixing, pii, quality
from veduta.llm.common import Scratch, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one: no column of an operator's own can clash with theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_veduta_row"))


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(c if c in ("doc_id", "text") else f"_veduta_row.`{c}`").alias(c) for c in docs.columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null, empty and wordless texts go; repeated rows share their fate; no rows give none."""
    return _unpacked(quality.resample(_packed(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id, of each group linked by five-word shingle Jaccard similarity of 0.8 or more.

    Null ids come last; texts without words, null ones too, all stay; of rows that repeat the one that stays, one stays.
    """
    return _unpacked(jaccard.keep_one(_packed(docs), 5, 80), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, judged each by its text: null and empty texts stay, repeated rows share their fate."""
    return _unpacked(decontamination.clean(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal values replaced by pseudonyms; n_chars follows the text, null for a null one."""
    out = _unpacked(pii.pseudonymise(_packed(docs)), docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix: doc_id, source, size, source_size, target, taken. Null texts have size 0, a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
]

#: The classifier's hashed models have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back as the next one's input.

    Extra columns, whatever their names, go through all stages but the last. Empty tables give no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
