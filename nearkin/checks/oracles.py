"""DuckDB SQL with the same results as the registered queries.

Each oracle is a WITH chain over the given tables; ``_with`` collects the views
a statement needs.
"""

from __future__ import annotations

import re

from nearkin.checks.queries import (
    BATCHES,
    EXPECTED_DIM,
    FILTER_CLUSTERS,
    FILTER_NATIONS,
    FIRST_PROBES,
    FIRST_SPEAKERS,
    FULL_STEPS,
    LIMIT,
    N_PROBES,
    TOP_K,
)
from nearkin.checks.fixtures import CLUSTERS, SPEAKERS, WIDTH


def _unit(v: str) -> str:
    length = f"sqrt(list_dot_product({v}, {v}))"
    return (
        f"CASE WHEN {length} > 1e-12 THEN list_transform({v}, lambda x: x / {length}) ELSE {v} END"
    )


def _r6(x: str) -> str:
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def _cosine(a: str, b: str) -> str:
    lengths = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(1 - list_dot_product({a}, {b}) / nullif({lengths}, 0))"


def _mean(view: str, keys: str, vector: str = "embedding") -> str:
    """Rows (keys, vector), elements averaged one by one."""
    return f"""SELECT {keys}, list(m ORDER BY pos) AS {vector} FROM (
        SELECT {keys}, pos, avg(value) AS m FROM (
            SELECT {keys}, generate_subscripts({vector}, 1) AS pos, unnest({vector}) AS value
            FROM {view}) GROUP BY {keys}, pos) GROUP BY {keys}"""


def _elements(view: str, keys: str, vector: str = "embedding") -> str:
    return f"""SELECT {keys}, CAST(pos AS INTEGER) AS pos, {_r6('value')} AS value FROM (
        SELECT {keys}, generate_subscripts({vector}, 1) AS pos, unnest({vector}) AS value
        FROM {view})"""


VIEWS = {
    "b": f"""SELECT vec_id, embedding, CAST(vec_id % {SPEAKERS} AS INTEGER) AS sp,
        CAST(floor(vec_id / {SPEAKERS}) AS INTEGER) AS u FROM embeddings""",
    "c": "SELECT *, CASE WHEN sp % 10 = 9 THEN 0 ELSE u % 4 END AS vid FROM b",
    "fx_clips": """SELECT vec_id AS id, concat('id', CAST(10000 + sp AS VARCHAR)) AS speaker_id,
        concat('/wav/id', CAST(10000 + sp AS VARCHAR), '/vid', CAST(vid AS VARCHAR), '/',
               lpad(CAST(u AS VARCHAR), 5, '0'), '.wav') AS file_path, sp, vid, u,
        list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS embedding FROM c""",
    "marked": """SELECT *, max(vid) OVER s AS last_vid, min(vid) OVER s AS first_vid
        FROM fx_clips WINDOW s AS (PARTITION BY speaker_id)""",
    "split": """SELECT *, CASE WHEN vid = last_vid AND first_vid < last_vid THEN 'probe'
        ELSE 'gallery' END AS part FROM marked""",
    "fx_gallery": "SELECT id, speaker_id, file_path, embedding FROM split WHERE part = 'gallery'",
    "fx_probes": f"""SELECT id AS query_id, speaker_id, file_path, {_unit('embedding')} AS embedding
        FROM split WHERE part = 'probe'""",
    "fx_metadata_raw": """SELECT concat(' id', CAST(10000 + sp AS VARCHAR)) AS id_raw,
        CASE WHEN sp % 8 = 7 THEN 'x' WHEN sp % 2 = 0 THEN ' M ' ELSE 'f' END AS gender_raw,
        CASE WHEN sp % 13 = 12 THEN NULL ELSE n_name END AS nationality_raw
        FROM (SELECT DISTINCT sp FROM fx_clips WHERE sp <> 38) s LEFT JOIN nation ON n_nationkey = sp % 5""",
    "fx_metadata": """SELECT trim(id_raw) AS speaker_id,
        CASE lower(trim(gender_raw)) WHEN 'm' THEN 'male' WHEN 'male' THEN 'male'
            WHEN 'f' THEN 'female' WHEN 'female' THEN 'female' ELSE 'unknown' END AS gender,
        coalesce(trim(nationality_raw), 'unknown') AS nationality FROM fx_metadata_raw""",
    "fx_speakers": """SELECT speaker_id, coalesce(gender, 'unknown') AS gender,
        coalesce(nationality, 'unknown') AS nationality
        FROM (SELECT DISTINCT speaker_id FROM fx_clips) LEFT JOIN fx_metadata USING (speaker_id)""",
    "fx_speakers_old": """SELECT DISTINCT speaker_id, 'unknown' AS gender, 'unknown' AS nationality
        FROM fx_clips WHERE sp < 10""",
    "fx_seeds": f"""SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster_id,
        {_unit('embedding')} AS centroid FROM fx_gallery ORDER BY id LIMIT {CLUSTERS}""",
    "fx_unit": f"SELECT id, {_unit('embedding')} AS embedding FROM fx_gallery",
    "step_assigned": """SELECT cluster_id, embedding FROM (
        SELECT s.cluster_id, g.embedding, row_number() OVER (PARTITION BY g.id
            ORDER BY list_dot_product(g.embedding, s.centroid) DESC, s.cluster_id) AS r
        FROM fx_unit g, fx_seeds s) WHERE r = 1""",
    "step_mean": _mean("step_assigned", "cluster_id"),
    "fx_clusters": f"SELECT cluster_id, {_unit('embedding')} AS centroid FROM step_mean",
    "fx_gallery_clustered": """SELECT id, speaker_id, embedding, cluster_id FROM (
        SELECT g.*, c.cluster_id, row_number() OVER (PARTITION BY g.id
            ORDER BY list_dot_product(g.embedding, c.centroid) DESC, c.cluster_id) AS r
        FROM fx_gallery g, fx_clusters c) WHERE r = 1""",
    "fx_frames": """SELECT sp AS clip_id, u % 3 AS layer, u AS frame, id % 7 <> 0 AS valid, embedding
        FROM fx_clips""",
    "own_mean": _mean("fx_gallery", "speaker_id"),
    "paired": """SELECT g.id, g.speaker_id, g.embedding AS a, m.embedding AS b
        FROM fx_gallery g JOIN own_mean m USING (speaker_id)""",
    "speaker_vectors": f"SELECT speaker_id, {_unit('embedding')} AS embedding FROM own_mean",
    "located": """SELECT g.id, g.speaker_id, s.gender, s.nationality
        FROM fx_gallery g JOIN fx_speakers s USING (speaker_id)""",
    "categorised": """SELECT 'gender' AS category, s.gender AS category_value, g.embedding
        FROM fx_gallery g JOIN fx_speakers s USING (speaker_id) WHERE s.gender <> 'unknown'
        UNION ALL
        SELECT 'gender_nationality', concat(s.gender, ':', s.nationality), g.embedding
        FROM fx_gallery g JOIN fx_speakers s USING (speaker_id)
        WHERE s.gender <> 'unknown' AND s.nationality <> 'unknown'""",
    "category_mean": _mean("categorised", "category, category_value"),
    "category_unit": f"""SELECT category, category_value AS label, {_unit('embedding')} AS embedding
        FROM category_mean""",
    "groups": """SELECT gender AS key, speaker_id FROM fx_speakers
        UNION ALL SELECT concat(gender, ':', nationality), speaker_id FROM fx_speakers""",
    "pooled": f"""SELECT clip_id, layer, pos, sum(CASE WHEN valid THEN value ELSE 0 END)
            / greatest(sum(valid::INTEGER), 1e-9) AS value FROM (
        SELECT clip_id, layer, frame, valid, generate_subscripts(embedding, 1) AS pos,
            unnest(embedding) AS value FROM fx_frames) GROUP BY clip_id, layer, pos""",
    "members": "SELECT DISTINCT cluster_id, speaker_id FROM fx_gallery_clustered",
}


def _routes(metric: str) -> dict[str, str]:
    """Routing views of one metric, with the metric's first letter as suffix."""
    m = metric[0]

    def far(a: str, b: str) -> str:
        return f"-list_dot_product({a}, {b})" if metric == "cosine" else f"list_distance({a}, {b})"

    return {
        f"best_gender_{m}": f"""SELECT query_id, label AS gender FROM (
            SELECT p.query_id, c.label, row_number() OVER (PARTITION BY p.query_id
                ORDER BY {far('c.embedding', 'p.embedding')}, c.label) AS r
            FROM fx_probes p, category_unit c WHERE c.category = 'gender') WHERE r = 1""",
        f"metadata_route_{m}": f"""SELECT query_id, CAST(r AS INTEGER) AS rank, label FROM (
            SELECT p.query_id, c.label, row_number() OVER (PARTITION BY p.query_id
                ORDER BY {far('c.embedding', 'p.embedding')}, c.label) AS r
            FROM fx_probes p JOIN best_gender_{m} g USING (query_id)
            JOIN category_unit c ON starts_with(c.label, concat(g.gender, ':'))
            WHERE c.category = 'gender_nationality') WHERE r <= {N_PROBES}""",
        f"cluster_route_{m}": f"""SELECT query_id, CAST(r AS INTEGER) AS rank, label FROM (
            SELECT p.query_id, c.cluster_id AS label, row_number() OVER (PARTITION BY p.query_id
                ORDER BY {far('c.centroid', 'p.embedding')}, c.cluster_id) AS r
            FROM fx_probes p, fx_clusters c) WHERE r <= {N_PROBES}""",
    }


def _searches(metric: str) -> dict[str, str]:
    """Hits and ranked speakers of all architectures for one metric."""
    m = metric[0]
    cosine = metric == "cosine"
    distance = _cosine("g.embedding", "p.embedding") if cosine else "list_distance(g.embedding, p.embedding)"
    score = "1 - least" if cosine else "-least"
    near = "list_dot_product(c.embedding, p.embedding)" if cosine else "-list_distance(c.embedding, p.embedding)"
    sources = {
        "brute": "fx_probes p, fx_gallery g",
        "metadata": f"""fx_probes p JOIN metadata_route_{m} r USING (query_id)
            JOIN fx_speakers s ON concat(s.gender, ':', s.nationality) = r.label
            JOIN fx_gallery g ON g.speaker_id = s.speaker_id""",
        "kmeans": f"""fx_probes p JOIN cluster_route_{m} r USING (query_id)
            JOIN fx_gallery_clustered g ON g.cluster_id = r.label""",
    }
    allowed = {
        "brute": "fx_probes p, speaker_vectors c",
        "metadata": f"""fx_probes p JOIN (SELECT DISTINCT r.query_id, s.speaker_id
            FROM metadata_route_{m} r JOIN fx_speakers s
            ON concat(s.gender, ':', s.nationality) = r.label) a USING (query_id)
            JOIN speaker_vectors c ON c.speaker_id = a.speaker_id""",
        "kmeans": f"""fx_probes p JOIN (SELECT DISTINCT r.query_id, s.speaker_id
            FROM cluster_route_{m} r JOIN members s ON s.cluster_id = r.label) a USING (query_id)
            JOIN speaker_vectors c ON c.speaker_id = a.speaker_id""",
    }
    views = {}
    for name, source in sources.items():
        views[f"knn_{name}_{m}"] = f"""SELECT query_id, CAST(r AS INTEGER) AS rank, id, speaker_id, distance
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                    ORDER BY distance NULLS LAST, id) AS r
                FROM (SELECT p.query_id, g.id, g.speaker_id, {distance} AS distance FROM {source}))
            WHERE r <= {LIMIT}"""
        views[f"hits_{name}_{m}"] = f"""SELECT query_id, speaker_id, count(*) AS votes,
            min(rank) AS first, min(distance) AS least FROM knn_{name}_{m} GROUP BY query_id, speaker_id"""
        for mode, order in (("closest", "first"), ("vote", "votes DESC, least NULLS LAST, first, speaker_id")):
            views[f"{mode}_{name}_{m}"] = f"""SELECT query_id, CAST(r AS INTEGER) AS rank, speaker_id,
                {score} AS score, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                    ORDER BY {order}) AS r FROM hits_{name}_{m}) WHERE r <= {TOP_K}"""
        views[f"centroid_{name}_{m}"] = f"""SELECT query_id, CAST(r AS INTEGER) AS rank, speaker_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, speaker_id) AS r
                FROM (SELECT p.query_id, c.speaker_id, {near} AS score FROM {allowed[name]}))
            WHERE r <= {TOP_K}"""
    return views


VIEWS |= _routes("cosine") | _routes("euclidean") | _searches("cosine") | _searches("euclidean")


def _training(name: str, steps: int, rows: str) -> dict[str, str]:
    """K-means steps from the seeds: centres move to all they have seen, by batch, or to the mean of their rows.

    Elements are summed as whole numbers, as training does.
    """
    views = {f"{name}_0": "SELECT cluster_id, centroid, 0 AS seen FROM fx_seeds"}
    for i in range(steps):
        views[f"{name}_near_{i}"] = f"""SELECT cluster_id, embedding FROM (
            SELECT c.cluster_id, g.embedding, row_number() OVER (PARTITION BY g.id ORDER BY
                list_dot_product(g.embedding, c.centroid) - list_dot_product(c.centroid, c.centroid) / 2 DESC, c.cluster_id) AS r
            FROM ({rows.format(batch=i)}) g, {name}_{i} c) WHERE r = 1"""
        views[f"{name}_sums_{i}"] = f"""SELECT cluster_id, list(m ORDER BY pos) AS total, any_value(n) AS n FROM (
            SELECT cluster_id, pos, sum(round(value * 16777216)) / 16777216 AS m, count(*) AS n FROM (
                SELECT cluster_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS value
                FROM {name}_near_{i}) GROUP BY cluster_id, pos) GROUP BY cluster_id"""
        seen = "0" if name.startswith("full") else "seen"
        views[f"{name}_{i + 1}"] = f"""SELECT cluster_id, CASE WHEN n IS NULL THEN centroid ELSE list_transform(
                range(1, {WIDTH + 1}), lambda i: (centroid[i] * {seen} + total[i]) / ({seen} + n)) END AS centroid,
            seen + coalesce(n, 0) AS seen FROM {name}_{i} LEFT JOIN {name}_sums_{i} USING (cluster_id)"""
    return views


VIEWS |= _training("full_step", FULL_STEPS, "SELECT * FROM fx_unit")
VIEWS |= _training("batch_step", BATCHES, f"""SELECT * FROM fx_unit
    WHERE (('0x' || substr(md5(concat('42:0:', id)), 1, 8))::BIGINT * {BATCHES}) >> 32 = {{batch}}""")


def _scores(name: str, ranked: str) -> dict[str, str]:
    """Outcome rows and metric views of one search."""
    return {
        f"out_{name}": f"""SELECT p.query_id, p.speaker_id AS truth,
            coalesce(t.speaker_id, '__NO_PREDICTION__') AS prediction,
            CASE WHEN t.query_id IS NULL THEN -1.0 ELSE t.score END AS score,
            CAST(p.speaker_id = coalesce(t.speaker_id, '') AS INTEGER) AS correct,
            CAST(EXISTS (SELECT 1 FROM {ranked} h WHERE h.query_id = p.query_id
                AND h.speaker_id = p.speaker_id) AS INTEGER) AS hit
            FROM fx_probes p LEFT JOIN {ranked} t ON t.query_id = p.query_id AND t.rank = 1""",
        f"class_{name}": f"""SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
            SELECT truth AS class, correct AS tp, 0 AS fp, 1 - correct AS fn FROM out_{name}
            UNION ALL SELECT prediction, 0, 1 - correct, 0 FROM out_{name}) GROUP BY class""",
        f"macro_{name}": f"""SELECT
            avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) * 100 AS precision,
            avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) * 100 AS recall,
            avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) * 100 AS f1
            FROM class_{name}""",
        f"far_{name}": f"""SELECT t.score,
            sum(CASE WHEN o.correct = 0 AND o.s >= t.score THEN 1 ELSE 0 END)
                / nullif(sum(1 - o.correct), 0) AS far,
            sum(CASE WHEN o.correct = 1 AND o.s < t.score THEN 1 ELSE 0 END)
                / nullif(sum(o.correct), 0) AS frr
            FROM (SELECT DISTINCT CAST(score AS FLOAT) AS score FROM out_{name}) t,
                (SELECT CAST(score AS FLOAT) AS s, correct FROM out_{name}) o GROUP BY t.score""",
        f"eer_{name}": f"""SELECT coalesce((SELECT (far + frr) / 2 * 100 FROM far_{name}
            WHERE far IS NOT NULL AND frr IS NOT NULL ORDER BY abs(far - frr), score LIMIT 1), 0) AS eer""",
        f"metrics_{name}": f"""SELECT avg(correct) * 100 AS top1_accuracy, avg(hit) * 100 AS hit_k,
            any_value(precision) AS precision, any_value(recall) AS recall, any_value(f1) AS f1,
            any_value(eer) AS eer FROM out_{name}, macro_{name}, eer_{name}""",
    }


SEARCHES = [
    (f"{mode}_{name}_{metric[0]}", architecture, aggregation, metric, depth)
    for metric in ("cosine", "euclidean")
    for name, architecture, depth in (
        ("brute", "brute_force", 1),
        ("metadata", "metadata_hierarchy", N_PROBES),
        ("kmeans", "kmeans_clusters", N_PROBES),
    )
    for mode, aggregation in (
        ("centroid", "speaker_centroid"), ("closest", "closest"), ("vote", "vote"),
    )
]
for _search in SEARCHES:
    VIEWS |= _scores(_search[0], _search[0])

_WORDS = re.compile(r"\w+")


def _with(select: str) -> str:
    """Prefix a statement with the views it uses, in order of definition."""
    wanted, open_ = set(), [select]
    while open_:
        for word in set(_WORDS.findall(open_.pop())) & VIEWS.keys() - wanted:
            wanted.add(word)
            open_.append(VIEWS[word])
    views = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in VIEWS.items() if n in wanted)
    return f"WITH {views}\n{select}" if views else select


METRICS = ("top1_accuracy", "hit_k", "precision", "recall", "f1", "eer")


def _metric_row(name: str, names=METRICS, view: str | None = None) -> str:
    columns = ", ".join(f"{_r6(n)} AS {n}" for n in names)
    return f"SELECT {columns} FROM {view or f'metrics_{name}'}"


def _sweep() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{architecture}' AS architecture, '{aggregation}' AS aggregation,
        '{metric}' AS metric, CAST({depth} AS INTEGER) AS cluster_probes, {', '.join(METRICS)}
        FROM metrics_{view}"""
        for view, architecture, aggregation, metric, depth in SEARCHES
    )


def _profile() -> str:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", column_name AS "column",
        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
            WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date'
            WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
            WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE column_type END AS "type",
        true AS "nullable", (SELECT count(*) FROM {n}) AS "rows" FROM (DESCRIBE {n})"""
        for n in names
    )


def _search_row(view: str) -> str:
    return f"SELECT query_id, rank, speaker_id, {_r6('score')} AS score FROM {view}"


def _knn_row(view: str) -> str:
    return f"SELECT query_id, rank, id, speaker_id, {_r6('distance')} AS distance FROM {view}"


def _length(v: str = "embedding") -> str:
    return f"CAST(len({v}) AS INTEGER) AS dim, {_r6(f'sqrt(list_dot_product({v}, {v}))')} AS norm"


_STATEMENTS = {
    "gallery_scan": f"SELECT speaker_id, file_path, {_length()} FROM fx_gallery",
    "probe_scan": f"SELECT query_id, speaker_id, file_path, {_length()} FROM fx_probes",
    "speaker_metadata": "SELECT speaker_id, gender, nationality FROM fx_metadata",
    "speakers_with_default": "SELECT speaker_id, gender, nationality FROM fx_speakers",
    "speakers_insert_absent": """SELECT * FROM fx_speakers_old UNION ALL
        SELECT n.* FROM fx_speakers n WHERE NOT EXISTS
        (SELECT 1 FROM fx_speakers_old o WHERE o.speaker_id = n.speaker_id)""",
    "assign_ids": "SELECT file_path, row_number() OVER (ORDER BY file_path) AS row_id FROM fx_clips",
    "assign_ids_append": """SELECT file_path, row_number() OVER (ORDER BY id % 3 <> 0, file_path) AS row_id FROM fx_clips""",
    "clip_catalog": "SELECT file_path, speaker_id, id * 100 + 44 AS size FROM fx_clips",
    "clip_catalog_speakers": """SELECT speaker_id, count(*) AS clips, CAST(sum(id * 100 + 44) AS BIGINT) AS bytes
        FROM fx_clips GROUP BY speaker_id""",
    "fixed_decimals": """SELECT id, printf('%.2f', (id * 10 + 5) / 1000.0::DOUBLE) AS two,
        printf('%.1f', -((id * 10 + 5) / 1000.0::DOUBLE)) AS one FROM fx_clips""",
    "path_parse": """SELECT file_path, split_part(file_path, '/', -3) AS speaker_id,
        split_part(file_path, '/', -2) AS video_id, ends_with(file_path, '.wav') AS is_wav FROM fx_clips""",
    "resume_pending": "SELECT file_path, speaker_id FROM fx_clips WHERE id % 3 <> 0",
    "clips_by_size": """SELECT row_number() OVER (ORDER BY size DESC, file_path) AS pos, file_path, size
        FROM (SELECT file_path, CAST(length(file_path) * 1000 + u AS INTEGER) AS size FROM fx_clips)""",
    "first_n_speakers": f"""SELECT id, speaker_id FROM fx_clips WHERE speaker_id IN
        (SELECT DISTINCT speaker_id FROM fx_clips ORDER BY speaker_id LIMIT {FIRST_SPEAKERS})""",
    "catalog_counts": """SELECT 'gallery' AS part, count(*) AS utterances,
            count(DISTINCT speaker_id) AS speakers FROM fx_gallery
        UNION ALL SELECT 'probes', count(*), count(DISTINCT speaker_id) FROM fx_probes""",
    "holdout_split": "SELECT id, part FROM split",
    "limit_probes": f"SELECT query_id, speaker_id FROM fx_probes ORDER BY query_id LIMIT {FIRST_PROBES}",
    "dim_violations": f"""SELECT id, CAST(len(embedding) AS INTEGER) AS dim FROM fx_clips
        WHERE len(embedding) <> {EXPECTED_DIM}""",
    "distance_cosine": f"SELECT id, speaker_id, {_r6(_cosine('a', 'b'))} AS distance FROM paired",
    "distance_euclidean": f"SELECT id, speaker_id, {_r6('list_distance(a, b)')} AS distance FROM paired",
    "dot_product": f"SELECT id, speaker_id, {_r6('list_dot_product(a, b)')} AS value FROM paired",
    "score_from_distance": f"""SELECT id, {_r6(f"1 - {_cosine('a', 'b')}")} AS score_cosine,
        {_r6('-list_distance(a, b)')} AS score_euclidean FROM paired""",
    "l2_normalize": _elements(f"(SELECT id, {_unit('embedding')} AS embedding FROM fx_clips)", "id"),
    "vector_text_roundtrip": f"""SELECT id, CAST(pos AS INTEGER) AS pos,
        {_r6("CAST(text AS DOUBLE)")} AS value, text FROM (
        SELECT id, generate_subscripts(embedding, 1) AS pos,
            format('{{:.12g}}', unnest(embedding)) AS text FROM fx_clips)""",
    "masked_mean_pool": f"""SELECT clip_id, layer, CAST(pos AS INTEGER) AS pos,
        {_r6('value')} AS value FROM pooled""",
    "layer_mean_pool": f"""SELECT clip_id, CAST(pos AS INTEGER) AS pos, {_r6('avg(value)')} AS value
        FROM pooled WHERE layer > 0 GROUP BY clip_id, pos""",
    "gallery_with_speakers": "SELECT id, speaker_id, gender, nationality FROM located",
    "filter_gender": "SELECT id, speaker_id FROM located WHERE gender = 'female'",
    "filter_gender_nat": f"""SELECT id, speaker_id FROM located WHERE gender = 'male'
        AND nationality IN ({', '.join(repr(n) for n in FILTER_NATIONS)})""",
    "filter_cluster": f"""SELECT id, speaker_id FROM fx_gallery_clustered
        WHERE cluster_id IN ({', '.join(map(str, FILTER_CLUSTERS))})""",
    "vector_mean": _elements("own_mean", "speaker_id"),
    "speaker_centroids": _elements("speaker_vectors", "speaker_id"),
    "metadata_centroids": _elements("category_mean", "category, category_value"),
    "metadata_groups": """SELECT key, row_number() OVER (PARTITION BY key ORDER BY speaker_id) AS pos,
        speaker_id FROM groups""",
    "cluster_memberships": "SELECT cluster_id, speaker_id FROM members",
    "kmeans_step": _elements("fx_clusters", "cluster_id", "centroid"),
    "cluster_assign": "SELECT id, cluster_id FROM fx_gallery_clustered",
    "kmeans_full_batch": _elements(f"full_step_{FULL_STEPS}", "cluster_id", "centroid"),
    "kmeans_mini_batch": _elements(f"batch_step_{BATCHES}", "cluster_id", "centroid"),
    "kmeans_labels": f"""SELECT id, cluster_id FROM (
        SELECT g.id, c.cluster_id, row_number() OVER (PARTITION BY g.id
            ORDER BY list_distance(g.embedding, c.centroid), c.cluster_id) AS r
        FROM fx_unit g, full_step_{FULL_STEPS} c) WHERE r = 1""",
    "route_gender": "SELECT query_id, CAST(1 AS INTEGER) AS rank, gender AS label FROM best_gender_c",
    "route_metadata": "SELECT query_id, rank, label FROM metadata_route_c",
    "route_cluster": "SELECT query_id, rank, label FROM cluster_route_c",
    "allowed_speakers": """SELECT DISTINCT query_id, speaker_id
        FROM cluster_route_c JOIN members ON cluster_id = label""",
    "allowed_speakers_metadata": """SELECT DISTINCT query_id, speaker_id FROM metadata_route_c
        JOIN fx_speakers ON concat(gender, ':', nationality) = label""",
    "knn_brute_cosine": _knn_row("knn_brute_c"),
    "knn_brute_euclidean": _knn_row("knn_brute_e"),
    "knn_brute_grid": _knn_row("knn_brute_c"),
    "knn_metadata": _knn_row("knn_metadata_c"),
    "knn_kmeans": _knn_row("knn_kmeans_c"),
    "knn_kmeans_grid": _knn_row("knn_kmeans_c"),
    "rank_closest": f"SELECT query_id, rank, speaker_id, {_r6('score')} AS score, votes FROM closest_brute_c",
    "rank_vote": f"SELECT query_id, rank, speaker_id, {_r6('score')} AS score, votes FROM vote_brute_c",
    **{
        f"{mode}_{name}": _search_row(f"{mode}_{name}_c")
        for mode in ("centroid", "closest", "vote") for name in ("brute", "metadata", "kmeans")
    },
    "fallback_no_gender": _knn_row("knn_brute_c"),
    "fallback_gender_only": f"""SELECT query_id, CAST(r AS INTEGER) AS rank, id, speaker_id, {_r6('distance')} AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, id) AS r FROM (
            SELECT p.query_id, g.id, g.speaker_id, {_cosine('g.embedding', 'p.embedding')} AS distance
            FROM fx_probes p JOIN best_gender_c b USING (query_id)
            JOIN (SELECT query_id, label FROM metadata_route_c UNION ALL SELECT query_id, 'male' FROM fx_probes) r
                ON r.query_id = p.query_id AND (b.gender = 'male') = (r.label = 'male')
            JOIN fx_speakers s ON r.label = CASE WHEN b.gender = 'male' THEN s.gender ELSE concat(s.gender, ':', s.nationality) END
            JOIN fx_gallery g ON g.speaker_id = s.speaker_id)) WHERE r <= {LIMIT}""",
    "fallback_no_clusters": _search_row("centroid_brute_c"),
    "fallback_empty_clusters": f"""SELECT query_id, CAST(r AS INTEGER) AS rank, speaker_id, {_r6('score')} AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, speaker_id) AS r FROM (
            SELECT p.query_id, c.speaker_id, list_dot_product(c.embedding, p.embedding) AS score
            FROM fx_probes p JOIN (SELECT query_id, label FROM cluster_route_c WHERE rank = 1) r USING (query_id), speaker_vectors c
            WHERE r.label IN ({', '.join(map(str, FILTER_CLUSTERS))})
                OR EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = r.label AND m.speaker_id = c.speaker_id))) WHERE r <= {TOP_K}""",
    "fallback_no_hits": """SELECT speaker_id AS truth, '__NO_PREDICTION__' AS prediction, -1.0::DOUBLE AS score, CAST(0 AS INTEGER) AS correct,
        count(*) AS probes FROM fx_probes GROUP BY speaker_id""",
    "top1_accuracy": _metric_row("closest_kmeans_c", METRICS[:1]),
    "hit_at_k": _metric_row("closest_kmeans_c", METRICS[1:2]),
    "macro_prf": _metric_row("closest_kmeans_c", METRICS[2:5]),
    "per_class_counts": """SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
        CAST(fn AS BIGINT) AS fn FROM class_closest_kmeans_c""",
    "eer": _metric_row("closest_brute_c", METRICS[5:]),
    "speaker_metrics": _metric_row("closest_kmeans_c"),
    "sweep_results": f"""SELECT architecture, aggregation, metric, cluster_probes,
        {', '.join(f'{_r6(n)} AS {n}' for n in METRICS)} FROM ({_sweep()})""",
    "results_table": f"""SELECT architecture, aggregation, metric, cluster_probes,
        {', '.join(f"printf('%.2f', {n}) AS {n}" for n in METRICS[:5])} FROM ({_sweep()})""",
    "database_summary": """SELECT (SELECT count(*) FROM fx_speakers) AS speakers,
        (SELECT count(*) FROM fx_gallery) AS audio_embeddings,
        (SELECT count(*) FROM category_mean) AS metadata_centroids,
        (SELECT count(*) FROM fx_clusters) AS cluster_centroids""",
    "contract_check": f"""SELECT * FROM (
        SELECT 'missing_columns' AS check_name, CAST(0 AS BIGINT) AS violations
        UNION ALL SELECT 'no_rows', CAST(count(*) = 0 AS BIGINT) FROM fx_clips
        UNION ALL SELECT 'missing_label', count(*) FROM fx_clips WHERE speaker_id IS NULL
        UNION ALL SELECT 'missing_vector', count(*) FROM fx_clips WHERE embedding IS NULL
        UNION ALL SELECT 'wrong_width', count(*) FROM fx_clips WHERE len(embedding) <> {WIDTH})""",
    "stage_check": f"""SELECT 'gallery' AS input, * FROM (
        SELECT 'missing_columns' AS check_name, CAST(0 AS BIGINT) AS violations
        UNION ALL SELECT 'no_rows', CAST(count(*) = 0 AS BIGINT) FROM fx_clips
        UNION ALL SELECT 'missing_label', count(*) FROM fx_clips WHERE speaker_id IS NULL
        UNION ALL SELECT 'missing_vector', count(*) FROM fx_clips WHERE embedding IS NULL
        UNION ALL SELECT 'wrong_width', count(*) FROM fx_clips WHERE len(embedding) <> {EXPECTED_DIM})
        UNION ALL SELECT 'metadata', * FROM (SELECT 'missing_columns', CAST(0 AS BIGINT)
        UNION ALL SELECT 'no_rows', CAST(count(*) = 0 AS BIGINT) FROM fx_metadata
        UNION ALL SELECT 'missing_label', count(*) FROM fx_metadata WHERE speaker_id IS NULL)""",
    "table_profile": _profile(),
}

ORACLES = {name: _with(statement) for name, statement in _STATEMENTS.items()}
