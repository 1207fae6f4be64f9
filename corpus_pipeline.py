"""The corpus pipeline: quality rules, line deduplication, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; n_chars follows the text where lines go. Near copies share
nearly all lines, so most go in the line stage, as documents of which too little is left; what is left as a near copy of
another goes in the stage after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from tidespan.session import store


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line. One that lost lines and has fewer words left than the quality rules ask for goes with them: what it says is said before."""
    done = line_dedup.without_later_lines(docs)
    words = F.size(quality_rules.words_of(F.col("text")))
    return done.where((F.col("n_removed") == 0) | (words >= quality_rules.QualityRules().min_words)).select(*docs.columns)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least doc_id."""
    return ngram_join.one_of_each(docs)


def leak_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a packed piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("decontamination", leak_stage),
    ("best_fit_packing", pack_stage),
]

#: Tokenising and packing have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
