"""The mixture as SQL for DuckDB, to check the operator against."""

from __future__ import annotations

from collections.abc import Mapping


def mixing_sql(
    weights: Mapping[tuple[str, ...], int], levels: tuple[str, ...] = ("domain", "language", "origin"), percent: int = 100, epochs: int = 4, seed: int = 7,
) -> str:
    """Shares level by level, then whole epochs and the first tokens of one more."""

    def weight(depth: int) -> str:
        cases = " ".join(
            "WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(levels, path)) + f" THEN {w}"
            for path, w in weights.items() if len(path) == depth
        )
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    views = [f"""m AS (SELECT doc_id, CASE n % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
            coalesce(lang, '') AS language, coalesce(source, '') AS origin, n_tokens
        FROM (SELECT *, coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]*)$', 1) AS BIGINT), 0) AS n,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents) WHERE n_tokens > 0)""",
        f"leaves AS (SELECT {', '.join(levels)}, sum(n_tokens) AS tokens, sum(n_tokens) * {epochs} AS capacity FROM m GROUP BY ALL)",
        f"level_0 AS (SELECT CAST(least(sum(tokens) * {percent} // 100, sum(capacity)) AS HUGEINT) AS budget FROM leaves)"]
    for depth, label in enumerate(levels, 1):
        parents = list(levels[: depth - 1])
        keys, group = ", ".join([*parents, label]), f"PARTITION BY {', '.join(parents)}" if parents else ""
        both = f"{group}{',' if parents else 'PARTITION BY'} is_full"
        join = f"JOIN level_{depth - 1} USING ({', '.join(parents)})" if parents else ", level_0"
        views += [
            f"nodes_{depth} AS (SELECT *, {weight(depth)} AS weight FROM (SELECT {keys}, CAST(sum(capacity) AS HUGEINT) AS capacity FROM leaves GROUP BY ALL) {join})",
            f"""filled_{depth} AS (SELECT *, capacity * open <= weight * (budget - before) AS is_full FROM (SELECT *,
                coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
                FROM nodes_{depth} WINDOW o AS ({group} ORDER BY capacity / weight, {label})))""",
            f"""shared_{depth} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE weight * rest // weights END AS share FROM (SELECT *,
                budget - coalesce(sum(capacity) FILTER (WHERE is_full) OVER ({group}), 0) AS rest,
                sum(weight) FILTER (WHERE NOT is_full) OVER ({group}) AS weights FROM filled_{depth}))""",
            f"""level_{depth} AS (SELECT {keys}, share + CASE WHEN NOT is_full AND turn <= rest - given THEN 1 ELSE 0 END AS budget FROM (SELECT *,
                sum(share) FILTER (WHERE NOT is_full) OVER ({group}) AS given, row_number() OVER ({both} ORDER BY {label}) AS turn FROM shared_{depth}))""",
        ]
    names = ", ".join(levels)
    views += [
        f"drawn AS (SELECT m.*, CAST(budget // tokens AS BIGINT) AS whole, CAST(budget % tokens AS BIGINT) AS rest FROM m JOIN leaves USING ({names}) JOIN level_{len(levels)} USING ({names}))",
        f"""cut AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {names} ORDER BY md5(concat_ws('-', {seed}, whole, coalesce(CAST(doc_id AS VARCHAR), ''))), n_tokens DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn)""",
    ]
    return f"""WITH {', '.join(views)}
        SELECT doc_id, {names}, CAST(n_tokens AS BIGINT) AS n_tokens, epoch, CAST(n_tokens AS BIGINT) AS take_tokens FROM (SELECT *, unnest(range(whole)) AS epoch FROM drawn)
        UNION ALL SELECT doc_id, {names}, CAST(n_tokens AS BIGINT), whole, CAST(least(n_tokens, rest - before) AS BIGINT) FROM cut WHERE before < rest"""
