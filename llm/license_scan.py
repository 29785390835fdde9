"""License scans by diagonal voting, with DataFrame functions only.

Every rolling k-gram of words is hashed; those whose hash belongs to a template are joined
with the templates' positions, words compared as well.  A hit of document position ``p`` on
template position ``t`` votes for the diagonal ``p - t``.  A diagonal with a vote for every
k-gram of a template is a verbatim copy that starts there.  Diagonals of one document and
template that lie within ``gap`` of each other are merged, which bridges inserted, missing
or replaced words.  A merged span is verified by the share of the template's words that stand
in order (longest common subsequence) in the words at its diagonal, ``gap`` more on both sides.

The templates are short lists given by the caller; their k-grams are literals of the plan.
Hits travel by document, one row each, and each document sends one row more; texts do not
travel at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_GRAMS = 20_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # found only where all its words stand
    names: tuple[str, ...] = ()  # words that must stand, as they tell it from other licenses

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        """Short enough for a k-gram to outlast one changed word."""
        return min(3 if self.base or len(self.words) > 5 else 2, len(self.words))

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


#: Phrases and labels that are searched word for word.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
#: Longer texts that may be changed a little.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0", names=("apache",)),
    Template("mit", "released under the mit license", names=("mit",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", names=("gnu",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", names=("cc", "by", "nc")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", names=("mozilla",)),
)


def scan_words(text: str = "text") -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, at + i) for i in range(k)))


def _hits(words: Column, n: Column, k: int, wanted: list[int], reach: int) -> Column:
    """Position, hash, words and surroundings of every k-gram whose hash is wanted."""
    places = F.filter(F.sequence(F.lit(0), n - k), lambda i: _hash(words, i, k).isin(wanted))
    return F.transform(places, lambda i: F.struct(
        i.alias("pos"), _hash(words, i, k).alias("hash"), F.array_join(F.slice(words, i + 1, k), " ").alias("gram"),
        F.slice(words, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + k)).alias("near"),
    ))


def _in_order(template: Column, words: Column) -> Column:
    """How many of the template's words stand in ``words`` in order: the longest common subsequence."""

    def row(old: Column, word: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(words)), F.array(F.lit(0)), lambda new, j: F.concat(new, F.array(F.greatest(
            F.element_at(new, -1), F.get(old, j), F.get(old, j - 1) + (F.get(words, j - 1) == word).cast("int")
        ))))

    return F.element_at(F.aggregate(template, F.array_repeat(F.lit(0), F.size(words) + 1), row), -1)


def _standing(t: Column, at: Column, pos: Column, near: Column, reach: int, gap: int) -> Column:
    """Template words in order around a hit; 0 where a name is missing, null where the hit only goes on from the one before."""
    here = F.least(pos, F.lit(reach))  # the hit's place in ``near``
    first = F.greatest(here - at - gap, F.lit(0))
    words = F.slice(near, first + 1, here - at - first + F.size(t["list"]) + gap)
    starts = (at == 0) | (here == 0) | (F.get(near, here - 1) != F.get(t["list"], at - 1))
    named = F.forall(t["names"], lambda w: F.array_contains(words, w))
    return F.when(~t["base"] & starts, F.when(named, _in_order(t["list"], words)).otherwise(0))


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``hash, gram, template, at`` of every k-gram of every template."""
    rows = [
        F.struct(F.lit(n).alias("template"), F.lit(i).alias("at"), F.lit(t.k).alias("k"), F.lit(" ".join(t.words[i : i + t.k])).alias("gram"))
        for n, t in enumerate(templates) for i in range(t.grams)
    ]
    if not rows or len(rows) > MOST_GRAMS:
        raise ValueError(f"templates must hold 1 to {MOST_GRAMS} k-grams")
    table = spark.range(1).select(F.inline(F.array(*rows)))
    parts = F.split("gram", " ")
    found = F.lit(None).cast("long")
    for k in sorted({t.k for t in templates}):
        found = F.when(F.col("k") == k, _hash(parts, F.lit(0), k)).otherwise(found)
    return table.withColumn("hash", found).drop("k")


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES, gap: int = 2, cover: float = 0.8
) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists label, start, end (first to last k-gram found, end not included) and cover of every span found.
    Null and empty texts have no words and no labels.  Rows with one doc_id stay separate rows.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    by_k: dict[int, list[int]] = {}
    for r in grams.select("hash", F.size(F.split("gram", " ")).alias("k")).distinct().collect():
        by_k.setdefault(r["k"], []).append(r["hash"])
    words, n = F.col("words"), F.col("n_words").cast("int")
    reach = max((len(t.words) for t in templates if not t.base), default=0) + gap
    hits = [F.when(n >= k, _hits(words, n, k, own, reach)) for k, own in sorted(by_k.items())]
    none = F.array().cast("array<struct<pos:int,hash:bigint,gram:string,near:array<string>>>")
    rows = (
        docs.select("doc_id", scan_words().alias("words")).withColumn("row", F.monotonically_increasing_id())
        .withColumn("n_words", F.size("words").cast("long"))
        .select("row", "doc_id", "n_words", F.concat(*(F.coalesce(h, none) for h in hits)).alias("hits"))
        .select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    )
    about = F.array(*(
        F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.grams).alias("grams"), F.lit(len(t.words)).alias("words"),
                 F.array(*map(F.lit, t.words)).alias("list"), F.array(*map(F.lit, t.names)).cast("array<string>").alias("names"))
        for t in templates
    ))
    standing = _standing(F.get(about, F.col("template")), F.col("at"), F.col("pos"), F.col("near"), reach, gap)
    voted = rows.join(F.broadcast(grams), ["hash", "gram"], "left").select(
        "row", "doc_id", "n_words", "template", "at", (F.col("pos") - F.col("at")).alias("diagonal"), standing.alias("standing")
    ).repartition("row")
    keys = ["row", "doc_id", "n_words", "template"]
    diagonals = voted.groupBy(*keys, "diagonal").agg(F.collect_set("at").alias("at"), F.max("standing").alias("standing")).withColumn(
        "t", F.get(about, F.col("template"))
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("t.base") | (F.col("diagonal") - F.lag("diagonal").over(along) > gap)
    diagonals = diagonals.withColumn("far", F.coalesce(far, F.lit(True)).cast("int"))
    merged = diagonals.withColumn("span", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*keys, "span").agg(
        F.first("t").alias("t"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.max("standing").alias("standing"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("start"), F.max(F.col("diagonal") + F.array_max("at")).alias("last"),
    )
    share = F.when(F.col("t.base"), F.size("at") / F.col("t.grams")).otherwise(F.col("standing") / F.col("t.words"))
    spans = spans.withColumn("cover", F.when(F.col("template").isNotNull(), share).otherwise(0.0)).withColumn(
        "found", F.when(F.col("t.base"), F.col("cover") == 1).otherwise(F.col("cover") >= cover)
    )
    base = F.col("found") & F.col("t.base")
    one = F.struct(
        F.col("t.label").alias("label"), F.col("start").cast("long").alias("start"),
        (F.col("last") + F.col("t.words") - F.col("t.grams") + 1).cast("long").alias("end"), "cover",
    )
    listed = "array_join(array_sort(collect_set(case when {} then t.label end)), ',')".format
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("high"))).cast("long").alias("last_word"),
        F.expr(listed("found and t.base")).alias("base_labels"),
        F.expr(listed("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found") | ~F.col("t.base"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), one))).alias("spans"),
    ).drop("row")
