"""From raw documents to packed training sequences in five stages.

Each stage works on all documents that the one before kept; all but the last return
the columns of ``documents``.  The last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.block_naming import drop_duplicates
from llm.common import cut_lineage, free_name, table
from llm.jaccard_join import keep_first
from llm.language import ADDED, fold, predict, train
from llm.mixing import mixed_documents
from llm.packing import pack
from llm.queries import WEIGHTS, source_levels
from nearkin.session import remove_tables, written_tables


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the classifier knows; the rejected ones go."""
    model = train(docs.where(fold() != 0))
    added = tuple(free_name(docs.columns, name) for name in ADDED)
    return predict(docs, model, added).where(~F.col(added[2])).select(docs.columns)


def keep_one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def keep_one_of_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, n=5, percent=80)


def mix_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, source_levels(), WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_one_of_equal_texts),
    ("jaccard_join", keep_one_of_similar_texts),
    ("mixing", mix_to_target_weights),
    ("packing", pack_sequences),
]

#: Language ID, the choice of tokens and packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written but its result goes once that is written, and its input with it."""
    docs, first = table(spark, sf_dir, "documents"), written_tables()
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        remove_tables(spark, first, written_tables() - 1)
        first = written_tables() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
