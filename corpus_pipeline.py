"""A corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontaminate, jaccard_join, langid, packing, toxicity
from tallyspark.llm.queries import toxicity_lexicon
from tallyspark.llm.tables import held_out, saved, table
from tallyspark.llm.tokens import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the model is learnt from the labelled documents of the corpus."""
    model = langid.fit(table(spark, sf_dir, "documents").filter(~held_out(3, 1)))
    return langid.identified(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.accepted(docs, toxicity_lexicon(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row for each piece."""
    cut = saved(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=0), "pipeline-pieces")
    return packing.packed(cut, ["doc_id"])


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
