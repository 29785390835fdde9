"""Versions of tables, the gallery's layout, commit logs, continued numbering, bitmaps, exact decimals."""

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import nearkin.plans.enroll as enrolment
from nearkin.functions.text import fixed_decimals
from nearkin.models import Model
from nearkin.operators.routing import (
    BLOCK_BITS,
    allowed_bitmaps,
    allowed_speakers,
    bucket_bitmaps,
    is_set,
    members_of,
    number_speakers,
)
from nearkin.plans.enroll import append_clips, enroll, open_model
from nearkin.plans.profile import database_tables
from nearkin.plans.search import routed_utterances, search
from nearkin.plans.sweep import results_table
from nearkin.sources.tables import (
    BEFORE,
    LIVE,
    MARK,
    Rebuild,
    append_finished,
    assign_ids,
    ensure_tables,
    finished_clips,
    model_table,
    number_new,
    properties,
)

PEOPLE = "speaker_id string, gender string, nationality string"
CLIPS = "speaker_id string, file_path string, embedding array<double>"


@pytest.fixture(scope="module")
def clips(spark):
    draw = np.random.default_rng(4)
    rows = []
    for s in range(12):
        middle = draw.normal(size=4)
        rows += [(f"id{s:02d}", f"/wav/id{s:02d}/v{i % 4}/{i:03d}.wav", (middle + 0.1 * draw.normal(size=4)).tolist()) for i in range(20)]
    return spark.createDataFrame(rows, CLIPS)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"id{s:02d}", "male" if s % 2 else "female", ["X", "Y", ""][s % 3]) for s in range(11)]
    return spark.createDataFrame(rows, PEOPLE)


def tables_of(spark, model):
    return {t: sorted(map(str, model_table(spark, model, t).collect())) for t in ("speakers", "audio_embeddings", "cluster_centroids", "speaker_centroids")}


def test_a_failed_enrolment_leaves_the_old_tables(spark, clips, people, monkeypatch):
    model = Model("safe", 4, "safe_model")
    enroll(model, clips, people, clusters=4)
    before, known = tables_of(spark, model), properties(spark, model)
    versions = {t.name for t in spark.catalog.listTables(model.namespace)}

    def broken(*_, **__):
        raise RuntimeError("stopped in the middle")

    with monkeypatch.context() as patched:
        patched.setattr(enrolment, "described_speakers", broken)
        with pytest.raises(RuntimeError, match="in the middle"):
            enroll(model, clips.where("speaker_id < 'id05'"), people, clusters=2)
    assert tables_of(spark, model) == before and properties(spark, model) == known
    assert {t.name for t in spark.catalog.listTables(model.namespace)} == versions

    for bad in ("speaker_id", "embedding"):
        nulls = clips.withColumn(bad, F.when(F.col("file_path") != "/wav/id03/v1/001.wav", F.col(bad)))
        with pytest.raises(ValueError, match="cannot be enrolled: .*: 1}"):
            enroll(model, nulls, people, clusters=2)
    assert tables_of(spark, model) == before


def test_versions_change_together_and_old_ones_go(spark, clips, people):
    model = Model("turns", 4, "turns_model")
    ensure_tables(spark, model)
    empty = properties(spark, model)
    with Rebuild(spark, model) as new:
        new.write(people, "speakers")
        new.write(spark.createDataFrame([(0, [1.0])], "cluster_id int, centroid array<double>"), "cluster_centroids", rows=F.count("*"))
        assert new.counts["cluster_centroids"] == {"rows": 1}
        assert properties(spark, model) == empty and model_table(spark, model, "speakers").count() == 0
        new.commit(last_id=7)
    known = properties(spark, model)
    assert model_table(spark, model, "speakers").count() == 11 and known[MARK] == "7"
    assert known[BEFORE + "speakers"] == empty[LIVE + "speakers"]
    old = spark.table(f"{model.namespace}.{empty[LIVE + 'speakers']}")  # a search may still be reading it
    assert old.count() == 0
    with Rebuild(spark, model) as again:
        again.write(people.limit(3), "speakers")
        again.commit()
    names = {t.name for t in spark.catalog.listTables(model.namespace)}
    assert empty[LIVE + "speakers"] not in names and known[LIVE + "speakers"] in names
    assert set(database_tables(spark, model.namespace)) == {"speakers", "audio_embeddings", "metadata_centroids", "cluster_centroids"}
    with pytest.raises(KeyError, match="no table"):
        model_table(spark, model, "speakers__x")


@pytest.mark.parametrize("layout", [("speaker_group", "cluster_id"), None])
def test_a_search_by_metadata_reads_routed_folders_only(spark, clips, people, layout):
    model = Model("laid", 4, "laid_model")
    enrolled = enroll(model, clips, people, clusters=3, layout=layout)
    assert "nationality" in enrolled.gallery.columns and enrolled.gallery.where("speaker_group = 'female:'").count() == 40
    probes = clips.where("speaker_id in ('id00', 'id06') and file_path like '%/v0/%'").select(
        F.xxhash64("file_path").alias("query_id"), "speaker_id", "embedding"
    )
    plain = enrolled.gallery.drop("gender", "nationality", "speaker_group")
    for n in (1, 2):
        got = search(probes, enrolled, architecture="metadata_hierarchy", top_k=3, n_probes=n)
        want = search(probes, type(enrolled)(plain, enrolled.speakers, enrolled.metadata_centroids, width=4), architecture="metadata_hierarchy", top_k=3, n_probes=n)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if layout and len(layout) == 2:
        routed = probes.withColumn("routed", F.array(F.lit("female:X")))
        from nearkin.plans.search import routed_groups

        kept = routed_groups(routed, enrolled.gallery, enrolled.speakers)
        assert "dynamicpruning" in kept._jdf.queryExecution().optimizedPlan().toString()
        assert "PartitionFilters" in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 40
        free = probes.withColumn("routed", F.lit(None).cast("array<string>"))
        assert routed_groups(free, enrolled.gallery, enrolled.speakers).count() == 240
        gender = probes.withColumn("routed", F.array(F.lit("male")))
        assert routed_groups(gender, enrolled.gallery, enrolled.speakers).count() == 100
        none = probes.withColumn("routed", F.array().cast("array<string>"))
        assert routed_utterances(none, enrolled, "metadata_hierarchy", "cosine", 5).count() == 0


def test_stored_centroids_are_searched(spark, clips, people):
    model = Model("stored", 4, "stored_model")
    enrolled = enroll(model, clips, people, clusters=3)
    probes = clips.where("file_path like '%/v0/000.wav'").select(F.xxhash64("file_path").alias("query_id"), "speaker_id", "embedding")
    bare = type(enrolled)(enrolled.gallery, enrolled.speakers, enrolled.metadata_centroids, enrolled.cluster_centroids, width=4)
    for architecture in ("brute_force", "kmeans_clusters", "metadata_hierarchy"):
        rows = [
            sorted((r.query_id, r["rank"], r.speaker_id, round(r.score, 9)) for r in search(probes, e, architecture=architecture, aggregation="speaker_centroid").collect())
            for e in (enrolled, bare)
        ]
        assert rows[0] == rows[1] and rows[0]


def test_appended_clips_go_on_counting(spark, clips, people):
    model = Model("grows", 4, "grows_model")
    first = clips.where("speaker_id < 'id08'")
    enroll(model, first, people, clusters=3)
    assert properties(spark, model)[MARK] == "160"
    assert append_clips(model, clips, people) == 80 and append_clips(model, clips, people) == 0
    stored = open_model(spark, model).gallery.orderBy("id").collect()
    assert [r["id"] for r in stored] == list(range(1, 241)) and properties(spark, model)[MARK] == "240"
    assert [r["file_path"] for r in stored[160:]] == sorted(r["file_path"] for r in clips.where("speaker_id >= 'id08'").collect())
    assert all(r["cluster_id"] is not None and r["speaker_group"] for r in stored)
    assert model_table(spark, model, "speakers").count() == 12
    # a mark stays above rows that have been removed
    with Rebuild(spark, model) as new:
        new.write(open_model(spark, model).gallery.where("id <= 100"), "audio_embeddings")
        new.commit()
    assert append_clips(model, clips.where("speaker_id = 'id11'"), people) == 20
    assert open_model(spark, model).gallery.agg(F.min(F.when(F.col("speaker_id") == "id11", F.col("id")))).first()[0] == 241


def test_numbers_continue_after_the_mark(spark):
    frame = spark.createDataFrame([(f"p{i:02d}",) for i in range(30)], "file_path string")
    first = assign_ids(frame.where("file_path < 'p10'"))
    more = number_new(first, frame)
    assert sorted(map(tuple, more.collect())) == [(f"p{i:02d}", i + 1) for i in range(10, 30)]
    assert min(r["row_id"] for r in number_new(first, frame, mark=500).collect()) == 501
    assert number_new(assign_ids(frame), frame).count() == 0
    assert number_new(first.limit(0), frame).count() == 30


def test_a_batch_counts_once(spark, tmp_path):
    store, schema = str(tmp_path / "done"), "file_path string, v int"

    def batch(*rows):
        return spark.createDataFrame(rows, schema)

    append_finished(batch(("a", 1), ("b", 1)), store, "one")
    append_finished(batch(("a", 2), ("b", 2)), store, "one")
    append_finished(batch(("c", 3)), store, "two")
    lost = batch(("d", 4)).withColumns({"_batch": F.lit("three"), "_attempt": F.lit("x")})
    lost.write.mode("append").partitionBy("_batch", "_attempt").parquet(f"{store}/rows")
    found = finished_clips(spark, store, schema)
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 1), ("c", 3)]
    append_finished(batch(("d", 5)), store, "three")
    assert sorted(map(tuple, finished_clips(spark, store, schema).collect())) == [("a", 1), ("b", 1), ("c", 3), ("d", 5)]


def test_bitmaps(spark):
    rows = [(f"s{i:06d}", b) for i in range(70_000) for b in ("x",) if i % 7 == 0] + [("s000003", "y"), ("s069999", "y"), (None, "y")]
    members = spark.createDataFrame(rows, "speaker_id string, bucket string").repartition(6)
    everyone = spark.range(70_000).select(F.format_string("s%06d", "id").alias("speaker_id"))
    numbers = number_speakers(everyone)
    bitmaps = bucket_bitmaps(members, numbers, "bucket")
    assert bitmaps.where("label = 'x'").count() == -(-70_000 // BLOCK_BITS)
    routes = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "none")], "query_id long, label string")
    allowed = allowed_bitmaps(routes, bitmaps)
    got = {q: {r.speaker_id for r in members_of(allowed, numbers, "query_id").where(F.col("query_id") == q).collect()} for q in (1, 2, 3)}
    x = {s for s, b in rows if b == "x"}
    assert got == {1: x | {"s000003", "s069999"}, 2: {"s000003", "s069999"}, 3: set()}
    assert members_of(allowed, numbers, "query_id").count() == len(got[1]) + 2
    candidates = numbers.withColumn("block", F.bitmap_bucket_number("number")).join(allowed.where("query_id = 1"), "block")
    assert {r.speaker_id for r in candidates.where(is_set(F.col("bitmap"), F.col("number"))).collect()} == got[1]
    listed = allowed_speakers(routes, members.where("speaker_id is not null"), "bucket")
    assert listed.where("query_id = 2").count() == 2 and listed.count() == len(got[1]) + 2


def test_decimals_are_those_of_the_binary_value(spark):
    draw = np.random.default_rng(9)
    values = [0.175, 2.675, 0.125, 0.375, 2.5, 0.05, 0.25, 0.005, 0.015, 1.005, 99.995, 100.0, 0.0, 1e-300, 0.0049999, 12345678.125, 2.0**39 + 0.25]
    values += (draw.integers(0, 20_000, 2000) / 200).tolist() + (draw.random(2000) * 100).tolist() + (draw.random(500) * 10.0 ** draw.integers(-6, 11, 500)).tolist()
    values += [-v for v in values if v >= 0.05]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_decimals(F.col("v")).alias("two"), fixed_decimals(F.col("v"), 1).alias("one")).collect()
    for r in rows:
        assert (r.two, r.one) == (f"{r.v:.2f}", f"{r.v:.1f}")
        assert Decimal(r.two) == Decimal(r.v).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    none = spark.createDataFrame([(None,), (float("nan"),), (1e300,)], "v double").select(fixed_decimals(F.col("v"))).collect()
    assert none[0][0] is None and none[1][0] == "NaN" and none[2][0].endswith(".00")
    with pytest.raises(ValueError):
        fixed_decimals(F.col("v"), 3)


def test_results_table_rounds_the_binary_value(spark):
    names = ["top1_accuracy", "hit_k", "precision", "recall", "f1", "eer"]
    frame = spark.createDataFrame([("a", "b", "c", 1, 0.175, 2.675, 9.375, 100.0, 66.665, 1.0)],
                                  f"architecture string, aggregation string, metric string, cluster_probes int, {', '.join(n + ' double' for n in names)}")
    row = results_table(frame).first()
    assert [row[n] for n in names[:5]] == ["0.17", "2.67", "9.38", "100.00", f"{66.665:.2f}"]


def test_tables_of_a_stage_are_removed(spark):
    from nearkin.session import cut_lineage, remove_tables, written_tables

    first = written_tables()
    frames = [cut_lineage(spark.range(n)) for n in (3, 4, 5)]
    remove_tables(spark, first, first + 2)
    assert frames[2].count() == 5 and written_tables() == first + 3
    for gone in frames[:2]:
        with pytest.raises(Exception, match="(?i)not.exist|no such file"):
            gone.collect()
    remove_tables(spark, first, first + 3)
    remove_tables(spark, first, first + 3)
