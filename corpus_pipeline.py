"""A training-data pipeline over documents, in stages: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage reads what its predecessor wrote, as Parquet in the shared folder. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsight.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from quillsight.llm.common import fresh, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.5 or more go. It is learned from the labelled rows among docs.

    Null and empty texts have no match and stay; repeated rows fare alike; without labels only the hand-made list counts; no rows give no rows.
    """
    return toxicity.drop_toxic(docs, toxicity.learn_grammar(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on ten sources or more go but for their first place; n_chars follows the text. Every document stays.

    A null text stays null, a null source is a site of its own; rows with one id and text fare alike; no rows give no rows.
    """
    (n_removed,) = fresh(docs, "n_removed")
    cleaned = line_dedup.line_dedup(docs)
    changed = F.col(n_removed) > 0
    own = {"n_chars": F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return cleaned.select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id.

    Texts without words are a class if their bytes are equal (a null is empty); a null id counts as the smallest; of rows that are equal in id and words one
    stays; no rows give no rows.
    """
    return near_dedup.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; repeated rows fare alike; no items take nothing away; no rows give no rows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, taken of the documents with words taken.

    Null and empty texts have no words and aren't taken; a null source is a source of its own; rows that share an id are ordered by size; no rows give no rows.
    """
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Learned grammars and alignments have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
