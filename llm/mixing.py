"""Mixing sources to target weights by budgets that flow down a tree of domains, languages and sources.

A node's budget is shared among its children by weight.  A child that cannot use its
share (its documents, read at most ``epochs`` times, hold fewer tokens) takes all it has,
and what it leaves goes to its siblings by weight; only what no sibling can take has
already been kept from the parent, whose own siblings got it.  Shares are whole tokens:
the remainders of the division go one by one to the children in order of name.

A leaf with budget ``b`` and ``t`` tokens reads its documents ``b div t`` times in full
and then the first ``b mod t`` tokens of one more epoch.  The order in an epoch is the MD5
of seed, epoch and doc_id, so the last document taken is cut.

The tree has one row per source; only its windows see whole groups.  Documents are put in
order by range partitions and one sum per partition, so a source with a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import cut_lineage, free_name, quiet_shuffles, text_digest
from nearkin.operators.order import totals_before

Weights = Mapping[tuple[str, ...], int]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_tokens(text: str = "text") -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parents: list[str], label: str) -> DataFrame:
    """``nodes`` (parents, label, weight, capacity, budget of the parent) with each node's own budget.

    Children in order of capacity per weight fill up first; the first that is not
    filled by its share ends the row of full ones, and the rest share what is left.
    """
    big = "cast({} as decimal(20,0))".format
    group = Window.partitionBy(*parents)
    order = group.orderBy("ratio", label)
    # A decimal with 18 places cannot wrap as div does, and tells ratios of weights below 10**9 apart.
    nodes = nodes.where("weight > 0").withColumn("ratio", F.expr(f"{big('capacity')} / {big('weight')}"))
    nodes = nodes.withColumns({
        "before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("full", F.expr(f"{big('capacity')} * {big('open')} <= {big('weight')} * {big('budget - before')}"))
    nodes = nodes.withColumns({
        "left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)),
        "weights": F.sum(F.when(~F.col("full"), F.col("weight"))).over(group),
    }).withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr(f"{big('weight')} * {big('left')} div {big('weights')}")))
    nodes = nodes.withColumns({
        "odd": F.col("left") - F.sum(F.when(~F.col("full"), F.col("share"))).over(group),
        "turn": F.row_number().over(Window.partitionBy(*parents, "full").orderBy(label)),
    })
    return nodes.withColumn(
        "share", F.col("share") + F.when(~F.col("full") & (F.col("turn") <= F.col("odd")), 1).otherwise(0)
    ).select(*parents, label, F.col("share").cast("long").alias("budget"))


def _weights(leaves: DataFrame, levels: list[str], weights: Weights) -> Column:
    """The weight of the node that the given level columns name; nodes not listed have weight 1."""
    found = F.lit(1)
    for path, weight in weights.items():
        if len(path) == len(levels):
            same = [F.col(c) == v for c, v in zip(levels, path)]
            test = same[0]
            for x in same[1:]:
                test = test & x
            found = F.when(test, F.lit(int(weight))).otherwise(found)
    return found.cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: Weights, budget: int, epochs: int) -> DataFrame:
    """``levels, tokens, budget`` for every leaf; ``leaves`` has one row per leaf with its tokens.

    ``weights`` gives positive whole numbers to nodes by path, and 0 to leave a node out.
    A budget beyond what all leaves hold is cut to that.
    """
    if any(not 0 <= w < 10**9 for w in weights.values()):
        raise ValueError("weights must be whole numbers from 0 to 10**9 - 1")
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for depth in range(1, len(levels) + 1):  # a node of weight 0 offers nothing
        leaves = leaves.withColumn("capacity", F.when(_weights(leaves, levels[:depth], weights) > 0, F.col("capacity")).otherwise(0))
    total = leaves.agg(F.sum("capacity")).first()[0] or 0
    given = None
    for depth, label in enumerate(levels, 1):
        parents = levels[: depth - 1]
        nodes = leaves.groupBy(*parents, label).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weights(nodes, levels[:depth], weights))
        nodes = nodes.withColumn("budget", F.lit(min(budget, total)).cast("long")) if given is None else nodes.join(given, parents)
        given = _fill(nodes, parents, label)
    return leaves.select(*levels, "tokens").join(given, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: Weights, budget: int | None = None,
    percent: int = 100, epochs: int = 4, seed: int = 7,
) -> DataFrame:
    """One row per document and epoch in the mixture: doc_id, the levels, n_tokens, epoch, take_tokens.

    ``levels`` names the tree's levels from the root and how to read them from a row; a null
    becomes the node ''.  ``budget`` is in tokens, or ``percent`` of all tokens.  A document
    without tokens takes part in no epoch.  Repeated rows are documents of their own; among
    equal places in an epoch the longer comes first.
    """
    return _mix(_measured(docs, levels), list(levels), weights, budget, percent, epochs, seed)


def _measured(docs: DataFrame, levels: dict[str, Column], *more: Column) -> DataFrame:
    quiet_shuffles(docs.sparkSession)
    return cut_lineage(docs.select(
        "doc_id", *more, *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()), word_tokens().alias("n_tokens")
    ).where("n_tokens > 0"))


def _mix(
    rows: DataFrame, names: list[str], weights: Weights, budget: int | None = None, percent: int = 100, epochs: int = 4, seed: int = 7,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """The mixture of measured rows; the columns ``more`` go with a row and break ties of its place in an epoch."""
    leaves = cut_lineage(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")))
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    given = cut_lineage(
        budgets(leaves, names, weights, budget, epochs).where("budget > 0").select(
            *names, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest")
        )
    )
    drawn = rows.join(given, names)
    whole = drawn.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1))).select(
        "doc_id", *more, *names, "n_tokens", "epoch", F.col("n_tokens").alias("take_tokens")
    )
    place = F.md5(F.concat_ws("-", F.lit(seed), "full", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ordered = drawn.where("rest > 0").withColumn("place", F.concat(place, F.format_string("%012d", F.lit(10**12 - 1) - F.col("n_tokens")), *(F.hex(m) for m in more)))
    partly = (
        totals_before(ordered, "place", ["n_tokens"], tuple(names)).where("n_tokens_before < rest")
        .select("doc_id", *more, *names, "n_tokens", F.col("full").alias("epoch"),
                F.least("n_tokens", F.col("rest") - F.col("n_tokens_before")).alias("take_tokens"))
    )
    return whole.unionByName(partly)


def _first_words(text: pa.Scalar, count: int) -> str:
    raw = text.as_buffer().to_pybytes()
    at = next(word.end() for n, word in enumerate(_WORD.finditer(raw), 1) if n == count)
    return raw[:at].decode()


def _cut(take: str, own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            wanted, held = batch.column(take).to_pylist(), batch.column(own).to_pylist()
            if wanted != held:
                texts = [_first_words(x, t) if t < o else x.as_py() for x, t, o in zip(batch.column("text"), wanted, held)]
                batch = batch.set_column(place, "text", pa.array(texts, batch.schema.field("text").type))
            yield batch

    return run


def mixed_documents(docs: DataFrame, levels: dict[str, Column], weights: Weights, **options) -> DataFrame:
    """The mixture as documents, all columns whatever their names, one row per document and epoch.

    The last document of a leaf's epoch is cut after its last token; a column n_chars then
    follows the text.  Rows that share a doc_id, a leaf and their text count as copies of one document.
    """
    names = list(levels)
    measured = _measured(docs, levels, text_digest().alias("digest"))
    taken = _mix(measured, names, weights, more=("digest",), **options)
    # Rows with equal keys have equal texts and may stand in for each other, so one is drawn for all.
    key = F.struct("doc_id", "digest", *names, F.col("n_tokens").alias("tokens")).alias("k")
    repeated = cut_lineage(measured.groupBy(key).count().where("count > 1").select("k"))
    taken = taken.groupBy(key, "epoch").agg(F.sum("take_tokens").alias("total"), F.count("*").alias("n")).select("k", F.explode(F.expr(
        "transform(sequence(1, cast(n as int)), i -> greatest(0, least(k.tokens, total - (i - 1) * k.tokens)))"
    )).alias("take")).where("take > 0")
    leaf = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()]
    rows = docs.select(
        F.struct("doc_id", text_digest().alias("digest"), *leaf, word_tokens().alias("tokens")).alias("k"), F.struct("*").alias("row")
    ).where("k.tokens > 0")
    if not repeated.isEmpty():
        first = rows.join(repeated, "k", "left_semi").dropDuplicates(["k"])
        rows = rows.join(repeated, "k", "left_anti").unionByName(first)
    columns = docs.columns
    take = free_name(columns, "take")
    own = free_name([*columns, take], "tokens")
    found = rows.join(cut_lineage(taken), "k").select("row.*", F.col("take").alias(take), F.col("k.tokens").alias(own))
    cut = found.mapInArrow(_cut(take, own), found.schema)
    if "n_chars" in columns:
        partly = F.col(take) < F.col(own)
        cut = cut.withColumn("n_chars", F.when(partly, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(columns)
