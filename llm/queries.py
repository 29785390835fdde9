"""The registered queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.block_naming import exact_duplicates
from llm.common import table
from llm.conversation_repair import fingerprints, repair
from llm.fill_in_middle import fill_in_middle, restored
from llm.html_text import extract
from llm.jaccard_join import near_duplicates
from llm.language import identify
from llm.license_scan import scan
from llm.line_quality import judge
from llm.mixing import mix
from llm.mixing_sql import mixing_sql
from llm.packing import pack
from llm.permutation_index import nearest
from llm.substring_dedup import remove_repeats
from llm.url_filter import filter_urls

#: The mixture's tree: sources belong to three domains, English weighs most, one source is favoured.
WEIGHTS = {
    ("web",): 5, ("books",): 3, ("code",): 2,
    ("web", "en"): 4, ("books", "en"): 3, ("code", "en"): 3,
    ("web", "en", "src0"): 2, ("web", "en", "src3"): 9, ("books", "fr", "src4"): 4,
}


#: Host and path with what the rule decides.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def source_levels() -> dict:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]*)$", 1)
    third = F.coalesce(number.try_cast("long") if hasattr(number, "try_cast") else number.cast("long"), F.lit(0)) % 3
    return {
        "domain": F.when(third == 0, "web").when(third == 1, "books").otherwise("code"),
        "language": F.col("lang"), "origin": F.col("source"),
    }


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), source_levels(), WEIGHTS)


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), n=3, percent=90)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), RULES)


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("row")


def op6_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op7_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept_text")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).drop("spans")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults that conversation and turn decide; nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    fault = F.col("fault")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fault"))
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    found, turns = repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def by_conversation(frame: DataFrame, *columns: str) -> DataFrame:
        return frame.select(F.struct("conv_id").alias("conv"), *columns)

    return (
        by_conversation(conversations).distinct()
        .join(by_conversation(found, *counts, "audit"), "conv", "left").join(by_conversation(fingerprints(turns), "sha256"), "conv", "left")
        .select(
            "conv.conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


def op12_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), host="source")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_in_middle(table(spark, folder, "documents"))
    return found.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(), 256)}).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_block_naming": op6_block_naming,
    "op7_permutation_index": op7_permutation_index,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language": op9_language,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_quality": op12_line_quality,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op1_mixing": mixing_sql(WEIGHTS),
    "op3_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
             p AS (SELECT page_id,
                          coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
             r(suffix, prefix, rule, verdict) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
                 ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
             f AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
                   FROM p LEFT JOIN r ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict,
               CASE WHEN rule IS NULL THEN 'none' ELSE 'rule' END AS via
        FROM f WHERE n = 1
    """,
    "op6_block_naming": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
             g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
    """,
    "op12_line_quality": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
             l AS (SELECT doc_id, host, text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]{2,}|[\x09-\x0D]', ' ', 'g'), ' ')) AS norm
                   FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
             hosts AS (SELECT host, count(DISTINCT text) AS all_texts FROM t GROUP BY host),
             often AS (SELECT host, norm FROM l JOIN hosts USING (host) GROUP BY host, norm
                       HAVING count(DISTINCT text) > 6 AND count(DISTINCT text) * 1000 > max(all_texts) * 1),
             lost AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars,
                             coalesce(sum(length(line)) FILTER (WHERE o.norm IS NOT NULL), 0) AS lost_chars, count(o.norm) AS lost_lines
                      FROM l LEFT JOIN often o USING (host, norm) GROUP BY doc_id),
             w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
             win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
                     FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
             again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
             covered AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS n FROM again) GROUP BY doc_id),
             m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                          CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                          CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                          CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, CAST(coalesce(lost_lines, 0) AS BIGINT) AS lost_lines, coalesce(line_chars, 0) AS line_chars
                   FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN covered USING (doc_id)),
             b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT * EXCLUDE (line_chars), NOT base_failed AND 100 * lost_chars <= 50 * line_chars AS kept FROM b
    """,
    "op13_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                          CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                          CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
             c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                               WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
             p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
               CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
