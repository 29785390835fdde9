"""URL filters with redirect equivalence, with DataFrame functions only.

A rule is a host and a path.  It fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's; of several rules the longest decides.

URLs that redirect to each other, or name each other as canonical, are aliases.  Aliases
are the connected components over those edges, computed with distributed star steps.
A URL without a rule takes over the decision of its aliases: it is allowed if one of them
is explicitly allowed, else blocked if one of them is blocked, else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import connected_components, cut_lineage, quiet_shuffles

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 20_000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What two URLs of one page share: host, path and query, without scheme and fragment."""
    return F.concat(host(url), F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1), F.lit("")))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``host, path, rule, allowed`` of every distinct host and path that a rule fits.

    A rule is a pair of ``host/path`` and ``allow`` or ``block``; given both ways, it allows.
    """
    if not rules or len(rules) > MOST_RULES:
        raise ValueError(f"give 1 to {MOST_RULES} rules")
    table = urls.sparkSession.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(r.partition("/")[0].lower()).alias("suffix"), F.lit("/" + r.partition("/")[2] if "/" in r else "").alias("begin"),
                 F.lit(r).alias("rule"), F.lit(kind == "allow").alias("allowed"))
        for r, kind in rules
    ))))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    each = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    # The rules are literals of the plan, at most MOST_RULES.
    fitting = each.join(F.broadcast(table), "suffix").where(F.startswith("path", "begin"))
    best = F.max(F.struct(F.length("rule"), "allowed", "rule"))
    return fitting.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.allowed")


#: What may hold text that looks like a tag: comments, and elements whose text is not read as tags.
_NOT_READ = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|noscript|template|xmp|iframe)\b.*?(?:</\1\s*>|\z)"
_TAGS = r"(?i)<(?:link|meta)\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
_ATTRIBUTE = r"""\s([a-zA-Z][-a-zA-Z0-9:_]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_PIECE = r"(?i)&#[0-9]{1,7};?|&#x[0-9a-f]{1,6};?|&(?:amp|lt|gt|quot|apos);|&|[^&]+"
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
_SCHEME = r"^[a-zA-Z][-a-zA-Z0-9+.]*:"


def decoded(text: Column) -> Column:
    """The text with character references decoded; those beyond ASCII, which no plain URL holds, stay."""

    def piece(p: Column) -> Column:
        hexadecimal = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+)", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(F.nullif(F.regexp_extract(p, r"^&#([0-9]+)", 1), F.lit(""))).cast("int")
        named = F.when(F.lit(False), p)
        for name, character in _NAMED.items():
            named = named.when(F.lower(p) == name, F.lit(character))
        return F.coalesce(F.when((code > 0) & (code < 128), F.char(code)), named, p)

    return F.when(F.instr(text, "&") > 0, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), piece), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path from ``/`` on with its ``.`` and ``..`` steps taken."""
    steps = F.split(path, "/")
    nothing = F.array().cast("array<string>")
    walked = F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), nothing, lambda done, step: (
        F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(step == ".", done).otherwise(F.array_append(done, step))
    ))
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    found = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(F.size(walked) > 0, ends).otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), found).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """The whole URL that a reference on a page stands for; null if it names no page of the web."""
    own = F.regexp_extract(base, r"^([^:/?#]+)://", 1)
    site = F.concat(own, F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"^(.*/)?", 0)
    tail = F.regexp_extract(target, r"[?#].*$", 0)
    steps = F.regexp_extract(target, r"^[^?#]*", 0)
    return (
        F.when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(own, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, without_dots(steps), tail))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path(base), target))
        .when((target == "") | F.startswith(target, F.lit("#")), F.lit(None))
        .otherwise(F.concat(site, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), steps)), tail))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges ``a, b`` (addresses) from a page to its canonical address and to where it refreshes to.

    Only tags count that a browser would read as such: none in comments, scripts and the like,
    and of an attribute given twice the first.
    """
    read = F.regexp_replace(F.coalesce("html", F.lit("")), _NOT_READ, " ")
    candidate = pages.where(F.col("html").rlike(r"(?i)canonical|refresh"))
    tags = candidate.select("url", F.explode(F.regexp_extract_all(read, F.lit(_TAGS), F.lit(0))).alias("tag"))
    # A generator keeps an expression in one place; a projection or a filter would repeat it.
    parts = tags.select("url", F.lower(F.substring("tag", 2, 4)).alias("kind"), F.explode(F.array(F.struct(
        F.transform(F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
        F.transform(F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(2)), lambda v: decoded(F.regexp_replace(v, r"^[\"']|[\"']$", ""))).alias("values"),
    ))).alias("t"))

    def value(name: str) -> Column:
        at = F.array_position("t.names", name)
        return F.coalesce(F.get("t.values", F.when(at > 0, at - 1).otherwise(-1).cast("int")), F.lit(""))

    canonical = F.when(F.array_contains(F.split(F.lower(F.trim(value("rel"))), r"\s+"), "canonical"), value("href"))
    refresh = F.when(F.lower(F.trim(value("http-equiv"))) == "refresh", F.regexp_extract(value("content"), r"(?i)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1))
    found = parts.select("url", F.explode(F.array(F.trim(F.when(F.col("kind") == "link", canonical).otherwise(refresh)))).alias("to")).where("to != ''")
    found = found.select("url", F.explode(F.array(resolve(F.col("url"), F.col("to")))).alias("to")).where("to is not null")
    return found.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b")).where("a != '' and b != ''")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, via (``rule``, ``alias`` or ``none``).

    Edges come from the pages' html and from ``redirects`` (columns ``source``, ``target``, whole
    URLs).  A null url and one without ``://`` has empty host and path, no rule and no alias; it is
    allowed.  Rows are judged one by one, so repeated ids and urls give repeated rows.
    """
    quiet_shuffles(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).where("a != '' and b != ''"))
    aliases = connected_components(cut_lineage(edges.where("a != b").distinct()))
    # An address's own host and path decide about it, wherever it came from.
    own = aliases.select("node", "component", F.regexp_extract("node", r"^[^/?]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    by_group = own.join(judge(own, rules), ["host", "path"]).groupBy("component").agg(F.max("allowed").alias("group_allowed"))
    decided = aliases.join(by_group, "component").select("node", "group_allowed")
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    judged = parts.join(judge(parts, rules), ["host", "path"], "left").join(decided, "node", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.when(F.coalesce("allowed", "group_allowed", F.lit(True)), "allow").otherwise("block").alias("verdict"),
        F.when(F.col("allowed").isNotNull(), "rule").when(F.col("group_allowed").isNotNull(), "alias").otherwise("none").alias("via"),
    )
