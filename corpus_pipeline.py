"""From raw documents to packed training tokens: toxic documents go, one of each group of near duplicates stays, passages of
test items are cut out, sources are mixed along their schedule, and token ids are packed.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read as the next one's documents.
Rows come back from Parquet in any order, so mixing adds their position and packing goes by it. Nulls, empty tables and columns
of other names are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrier.llm import curriculum, decontam, ngram_join, rans, toxicity
from harrier.llm.common import documents, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chain of classifiers does not say toxic; those without words stay."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id."""
    return ngram_join.deduplicate(docs)


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with test items; those that lose most of their words go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), report=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source is asked for, with epoch, n_tokens and position; by default each comes at least once."""
    return curriculum.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of coded token ids in the training order, and the row of their frequency table."""
    return rans.pack(docs, order=curriculum.training_order())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_test_items),
    ("mix_sources", mix_sources),
    ("token_blocks", pack_tokens),
]

#: Classifiers and token merges are beyond SQL; tests/llm/test_edges.py holds the stages and the packed order against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
