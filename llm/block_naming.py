"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text, with every run of white space turned into one space, is cut into blocks of a
fixed number of characters.  The distinct blocks are sorted and numbered, so equal
blocks and only equal blocks have equal integer names.  Then adjacent names are paired
and the distinct pairs are sorted and numbered in turn, until one name is left for each
text: with its number of blocks it identifies the whole text without collisions.

Distinct blocks and pairs are aggregated in the map tasks before they are shuffled, so a
text that a third of all rows share costs one row per task; groups are written before their rows
are joined to them, so adaptive execution can split a hot one.  Blocks are given their
names by a digest, after a check over all distinct blocks that no two share a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import cut_lineage, quiet_shuffles

BLOCK_CHARS = 4096


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _digest(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names for distinct rows: place in the sorted partition that their hash assigns."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_texts(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, row, text_sha256, blocks, name``: equal ``(blocks, name)`` means equal normalised text.

    ``row`` tells apart rows with one doc_id.  A null text counts as empty; an empty
    one has no blocks and the name -1.
    """
    quiet_shuffles(docs.sparkSession)
    texts = docs.select("doc_id", normalised("text").alias("text"))
    rows = cut_lineage(
        texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(_blocks(F.col("text"), block_chars), _digest).alias("digests"))
        .withColumn("row", F.monotonically_increasing_id()).withColumn("blocks", F.size("digests").cast("long"))
    )
    blocks = texts.select(F.explode(_blocks(F.col("text"), block_chars)).alias("block")).distinct()
    names = cut_lineage(_numbered(blocks, "block").select(_digest(F.col("block")).alias("digest"), "name"))
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        raise ValueError("two different blocks have one MD5 digest; choose another block size")
    level = cut_lineage(
        rows.select("row", "blocks", F.posexplode("digests").alias("at", "digest")).join(names, "digest")
        .select("row", "at", "name", F.col("blocks").alias("left"))
    )
    done = level.where("left = 1").select("row", "name")
    level = level.where("left > 1")
    while not level.isEmpty():
        even = F.col("at") % 2 == 0
        pairs = level.groupBy("row", "left", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r")
        )
        pairs = cut_lineage(pairs)
        names = cut_lineage(_numbered(pairs.select("l", "r").distinct(), "l", "r"))
        level = cut_lineage(
            pairs.join(names, ["l", "r"]).select("row", "at", "name", F.ceil(F.col("left") / 2).alias("left"))
        )
        done = done.unionByName(level.where("left = 1").select("row", "name"))
        level = level.where("left > 1")
    return rows.drop("digests").join(done, "row", "left").withColumn("name", F.coalesce("name", F.lit(-1)))


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays (null ids last); of repeated rows with
    that id exactly one has ``kept``.  Null and empty texts are equal to each other.
    """
    named = cut_lineage(name_texts(docs, block_chars))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = cut_lineage(named.groupBy("blocks", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size")))
    return named.join(groups, ["blocks", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns whatever their names, that ``exact_duplicates`` keeps."""
    found = cut_lineage(exact_duplicates(docs, block_chars))
    by_row = found.groupBy(F.struct("doc_id", "text_sha256").alias("k")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    by_row = cut_lineage(by_row)
    sha = F.sha2(normalised("text"), 256)
    rows = docs.select(F.struct("doc_id", sha.alias("text_sha256")).alias("k"), F.struct("*").alias("row"))
    left = rows.join(by_row.where("not kept").select("k"), "k", "left_anti")
    repeated = cut_lineage(by_row.where("kept and n > 1").select("k"))
    if not repeated.isEmpty():
        once = left.join(repeated, "k", "left_semi").dropDuplicates(["k"])
        left = left.join(repeated, "k", "left_anti").unionByName(once)
    return left.select("row.*")
