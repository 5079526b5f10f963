"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing and packing, over all documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of documents.

Defined results: extra columns, whatever their names, are dropped; a text that is null, empty or of under 50 words fails
the base rules of the first stage; null ids, langs and sources pass as they are; repeated rows are near duplicates of
each other and stay together, as they have one id; ties and very long texts are treated as each operator's docstring
says; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from gleaner.llm.keys import without_keys
from gleaner.llm.queries import table, tokenizer_path
from gleaner.llm.store import made, saved, sweep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the learned list rejects go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    verdict = quality_rules.with_verdict(docs, rules)
    return verdict.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents left without a word go with them."""
    out = line_dedup.dedup_lines(docs)
    left = out.where("lines_dropped = 0 OR regexp_like(text, '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    groups = ngram_join.ngram_jaccard_join(docs)
    dropped = saved(groups.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return without_keys(docs, dropped, "doc_id").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights; those of rare cells are repeated as often as these need it."""
    taken = mixing.mix(docs).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 at most."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: The first stage is learned and the third is a similarity join; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's own tables, and what it read, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    began = len(made)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, began, docs)
    return docs
