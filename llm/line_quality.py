"""Quality rules with cross-document line frequency, with DataFrame functions only.

Each text is measured where it lies: words, characters, symbols, repeated lines and repeated
windows of words.  Its lines, with in lower case with white space normalised, are hashed.
A line found in more documents of its host than the limits allow is taken for boilerplate
and goes; a document that loses too large a share of its characters is depleted and rejected.

Documents of a host with the same text count as one, so copies alone make no line frequent.
Distinct lines are gathered per text before they are counted, and counts are summed in the
map tasks, so a host with a third of all documents or a line in each of them is spread over
many tasks.  The frequent lines are written before they are joined, and so are the losses, so
adaptive execution sees two plain shuffles and splits a partition that holds one hot line or text.

Lines are told apart by 64-bit hashes together with their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import cut_lineage, quiet_shuffles, text_digest

WORD = r"[^\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"

#: A line goes beyond this many documents of its host, and beyond this share of them.
MOST_DOCUMENTS, MOST_PER_THOUSAND = 6, 1
#: A document is depleted when it loses more than this share of the characters of its lines.
MOST_LOST_PERCENT = 50


def _step(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns computed once per row; a projection alone would repeat their expressions where they are used."""
    return frame.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("step")).select(
        *frame.columns, "step.*"
    )


def with_repeated_windows(frame: DataFrame, n: int = 3) -> DataFrame:
    """The frame with ``n_repeat_words``: how many words stand in windows of ``n`` words that occur twice or more, first ones included.

    ``hashes`` holds a 64-bit hash for each word.  Windows are sorted by a hash of theirs, so equal ones
    become neighbours; neighbours count as equal if their words' hashes are.  Texts whose windows all differ are not sorted.
    """
    keys = F.transform("hashes", lambda h, i: F.xxhash64(h, *(F.get("hashes", i + k) for k in range(1, n))))
    frame = _step(frame, keys=F.slice(keys, F.lit(1), F.greatest(F.size("hashes") - (n - 1), F.lit(0))))
    ordered = F.sort_array(F.transform("keys", lambda key, i: F.struct(key.alias("key"), i.alias("at"))))
    none = F.array().cast("array<struct<key:bigint,at:int>>")
    frame = _step(frame, ordered=F.when(F.size(F.array_distinct("keys")) < F.size("keys"), ordered).otherwise(none)).drop("keys")

    def same(a: Column, b: Column) -> Column:
        found = a["key"] == b["key"]
        for k in range(n):
            found = found & (F.get("hashes", a["at"] + k) == F.get("hashes", b["at"] + k))
        return F.coalesce(found, F.lit(False))

    again = F.filter("ordered", lambda x, j: same(x, F.get("ordered", j - 1)) | same(x, F.get("ordered", j + 1)))
    frame = _step(frame, starts=F.sort_array(F.transform(again, lambda x: x["at"]))).drop("ordered", "hashes")
    covered = F.transform("starts", lambda s, j: F.coalesce(F.least(F.get("starts", j + 1) - s, F.lit(n)), F.lit(n)))
    return frame.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda total, s: total + s)).drop("starts")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with white space normalised."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))))


def _without(text: str, characters: str) -> Column:
    left = F.col(text)
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return left


def measure(docs: DataFrame, host: Column) -> DataFrame:
    """Per row: doc_id, host, digest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines (key, chars)."""
    text = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = _step(
        text, words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lines=_lines(F.col("text"))
    ).select(
        "doc_id", "host", text_digest().alias("digest"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(_without("text", SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(line_key(x).alias("key"), F.length(x).alias("chars"))).alias("lines"),
    )
    return with_repeated_windows(counted)


def frequent_lines(
    texts: DataFrame, most_documents: int = MOST_DOCUMENTS, per_thousand: int = MOST_PER_THOUSAND
) -> DataFrame:
    """``host, key, documents`` of the lines above both limits; ``texts`` (host, lines) has one row per distinct text of a host."""
    seen = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    often = seen.groupBy("host", "key").agg(F.count("*").alias("documents")).where(F.col("documents") > most_documents)
    hosts = cut_lineage(texts.groupBy("host").agg(F.count("*").alias("all")))
    return cut_lineage(often).join(hosts, "host").where(F.col("documents") * 1000 > F.col("all") * per_thousand).select("host", "key", "documents")


def losses(measured: DataFrame, most_documents: int = MOST_DOCUMENTS, per_thousand: int = MOST_PER_THOUSAND) -> DataFrame:
    """``host, digest, lost_chars, lost_lines, lost_keys`` of the texts that hold lines above the limits."""
    texts = cut_lineage(measured.groupBy("host", "digest").agg(F.first("lines").alias("lines")))
    often = cut_lineage(frequent_lines(texts, most_documents, per_thousand))
    found = texts.select("host", "digest", F.inline("lines")).join(often.select("host", "key"), ["host", "key"])
    return cut_lineage(found.groupBy("host", "digest").agg(
        F.sum("chars").cast("long").alias("lost_chars"), F.count("*").alias("lost_lines"), F.collect_set("key").alias("lost_keys")
    ))


def judge(
    docs: DataFrame, host: Column | str = "source", most_documents: int = MOST_DOCUMENTS, per_thousand: int = MOST_PER_THOUSAND,
    most_lost: int = MOST_LOST_PERCENT,
) -> DataFrame:
    """Per document: doc_id, the counts of ``measure``, lost_chars, lost_lines, base_failed, kept.

    A null text counts as empty, a null host as a host named ''.  Texts of fewer than 50 words
    and those with more than half of their words in repeated windows fail; of the others
    those stay that lose no more than ``most_lost`` percent of the characters of their lines.  Repeated rows are judged
    alike and each gives a row; other columns are not read, whatever their names.  An empty table
    gives no row.  Arrays of a text's words and lines are held by its own task only.
    """
    return _judged(docs, host, most_documents, per_thousand, most_lost).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "lost_lines", "base_failed", "kept"
    )


def _judged(docs: DataFrame, host: Column | str, most_documents: int, per_thousand: int, most_lost: int) -> DataFrame:
    quiet_shuffles(docs.sparkSession)
    measured = cut_lineage(measure(docs, F.col(host) if isinstance(host, str) else host))
    lost = losses(measured, most_documents, per_thousand)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(lost, ["host", "digest"], "left").withColumns({
        "lost_chars": F.coalesce("lost_chars", F.lit(0).cast("long")), "lost_lines": F.coalesce("lost_lines", F.lit(0).cast("long")),
        "base_failed": failed,
        "line_chars": F.aggregate("lines", F.lit(0).cast("long"), lambda total, x: total + x["chars"]),
    }).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("line_chars")))


def clean(
    docs: DataFrame, host: Column | str = "source", most_documents: int = MOST_DOCUMENTS, per_thousand: int = MOST_PER_THOUSAND,
    most_lost: int = MOST_LOST_PERCENT,
) -> DataFrame:
    """The documents that ``judge`` keeps, all columns, without their frequent lines.

    Lines without a word stay.  Rows with one host and text get the same verdict, so each
    repeated row stays or goes with the others.
    """
    verdicts = _judged(docs, host, most_documents, per_thousand, most_lost).where("kept").select(
        F.struct("host", "digest").alias("v"), "lost_keys"
    ).dropDuplicates(["v"])
    verdicts = cut_lineage(verdicts)
    name = F.coalesce((F.col(host) if isinstance(host, str) else host).cast("string"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), F.struct(name.alias("host"), text_digest().alias("digest")).alias("v"))
    text = F.col("row.text")
    left = F.filter(F.split(text, "\n"), lambda line: ~(line.rlike(WORD) & F.array_contains("lost_keys", line_key(line))))
    cleaned = F.when(F.col("lost_keys").isNull(), text).otherwise(F.array_join(left, "\n"))
    return own.join(verdicts, "v").select(F.col("row").withField("text", cleaned).alias("row")).select("row.*")
