import os

import pytest
from pyspark.sql import functions as F

from nearkin.models import Model
from nearkin.operators.clips import drop_failed, first_probes, split_holdout
from nearkin.operators.clusters import lloyd_step, train_clusters
from nearkin.plans import profile
from nearkin.plans.enroll import enroll, open_model
from nearkin.plans.search import search
from nearkin.plans.sweep import report, sweep
from nearkin.sources import readers
from nearkin.sources.tables import (
    append_finished,
    ensure_tables,
    finished_clips,
    insert_absent,
    model_table,
    rebuild,
    save_results,
)


def write(path, text):
    path.write_text(text)
    return str(path)


def metadata(spark, path):
    return {r[0]: (r[1], r[2]) for r in readers.read_metadata(spark, path).collect()}


@pytest.mark.parametrize("sep", ["\t", ","])
def test_metadata_file(spark, tmp_path, sep):
    lines = [
        "VoxCeleb1 ID,VGGFace1 ID,Gender,Nationality,Set", "id1,A,m,Ireland,dev", " id2 ,B,F, New Zealand ,dev",
        "id3,C,other,,dev", ",D,m,India,dev", "id1,A,f,USA,test",
    ]
    path = write(tmp_path / "m.csv", "\n".join(line.replace(",", sep) for line in lines) + "\n")
    assert metadata(spark, path) == {
        "id1": ("female", "USA"), "id2": ("female", "New Zealand"), "id3": ("unknown", ""),
    }


def test_metadata_without_columns_or_file(spark, tmp_path):
    path = write(tmp_path / "m.csv", "VoxCeleb1 ID,Other\nid1,x\n")
    assert metadata(spark, path) == {"id1": ("unknown", "unknown")}
    assert metadata(spark, str(tmp_path / "absent.csv")) == {}
    assert metadata(spark, None) == {}


def test_clip_tree(spark, tmp_path):
    for name, size in (("id1/v1/1.wav", 5), ("id1/v1/1.txt", 1), ("id2/v2/9.wav", 7)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    found = readers.clip_catalog(spark, str(tmp_path))
    got = sorted((os.path.basename(r["file_path"]), r["speaker_id"], r["size"]) for r in found.collect())
    assert got == [("1.wav", "id1", 5), ("9.wav", "id2", 7)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_inputs_under_other_names(spark):
    raw = spark.createDataFrame([(1, [3.0, 4.0], "a", "p")], "query_id long, x array<float>, speakers string, file_paths string")
    row = readers.as_probes(raw).first()
    assert (row["speaker_id"], row["file_path"]) == ("a", "p")
    assert row["embedding"] == pytest.approx([0.6, 0.8])
    assert readers.as_probes(raw.drop("file_paths")).first()["file_path"] is None
    with pytest.raises(ValueError, match="speakers"):
        readers.as_probes(raw.drop("speakers"))
    with pytest.raises(ValueError, match="embeddings"):
        readers.as_probes(raw.drop("x"))


def test_every_row_is_checked_for_width(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, embedding array<double>")
    assert [tuple(r) for r in readers.dim_violations(rows, 2).collect()] == [(2, 1)]
    with pytest.raises(Exception, match="expected vectors of width 2, got 1"):
        readers.require_dim(rows, 2).collect()
    assert readers.require_dim(rows.where("id <> 2"), 2).count() == 2


def test_gallery_filter_rules(spark):
    rows = spark.createDataFrame(
        [("male", "X", 0), ("male", "Y", 1), ("female", "X", None)], "gender string, nationality string, cluster_id int"
    )

    def n(**conditions):
        return rows.where(readers.gallery_filter(**conditions)).count()

    assert n() == 3 and n(gender="male") == 2
    assert n(gender="male", nationalities=["X"]) == 1 and n(gender="male", nationalities=[]) == 2
    assert n(clusters=[0, 1]) == 2 and n(clusters=[]) == 0 and n(clusters=None) == 3


def test_split_has_no_overlap(spark):
    clips = spark.createDataFrame(
        [("a", "v1", 1), ("a", "v2", 2), ("a", "v2", 3), ("b", "v9", 4), ("c", "v10", 5), ("c", "v9", 6)],
        "speaker_id string, video_id string, id long",
    )
    gallery, probes = split_holdout(clips)
    assert sorted(r["id"] for r in probes.collect()) == [2, 3, 6]
    pair = ["speaker_id", "video_id"]
    assert gallery.select(pair).intersect(probes.select(pair)).count() == 0
    assert gallery.count() + probes.count() == clips.count()


def test_failed_clips_are_set_aside(spark):
    clips = spark.createDataFrame([(1, None), (2, "broken")], "id long, error string")
    usable, quarantine = drop_failed(clips)
    assert [r["id"] for r in usable.collect()] == [1] and [r["id"] for r in quarantine.collect()] == [2]
    assert first_probes(clips, None) is clips


def test_resumable_store(spark, tmp_path):
    store, schema = str(tmp_path / "done"), "file_path string, v int"
    assert finished_clips(spark, store, schema).count() == 0
    append_finished(spark.createDataFrame([("a", 1)], schema), store)
    append_finished(spark.createDataFrame([("b", 2)], schema), store)
    assert sorted(r["file_path"] for r in finished_clips(spark, store, schema).collect()) == ["a", "b"]


@pytest.fixture(scope="module")
def clips(spark):
    import random

    random.seed(3)
    rows = []
    for s in range(12):
        centre = [random.gauss(0, 1) for _ in range(4)]
        for i in range(20):
            rows.append((f"id{s:02d}", f"/wav/id{s:02d}/v{i % 4}/{i:03d}.wav", [c + random.gauss(0, 0.1) for c in centre]))
    return spark.createDataFrame(rows, "speaker_id string, file_path string, embedding array<double>")


def test_enrolment_then_search(spark, clips, tmp_path):
    model = Model("tiny", 4, "tiny_model")
    known = spark.createDataFrame(
        [(f"id{s:02d}", "male" if s % 2 else "female", "XY"[s % 3 % 2]) for s in range(11)],
        "speaker_id string, gender string, nationality string",
    )
    enrolled = enroll(model, clips, known, clusters=6)
    summary = profile.database_summary(enrolled).first().asDict()
    assert summary == {"speakers": 12, "audio_embeddings": 240, "metadata_centroids": 6, "cluster_centroids": 6}
    stored = enrolled.gallery.orderBy("id").collect()
    assert [r["id"] for r in stored] == list(range(1, 241))
    assert [r["file_path"] for r in stored] == sorted(r["file_path"] for r in stored)
    assert all(r["cluster_id"] is not None for r in stored)
    last = model_table(spark, model, "speakers").where("speaker_id = 'id11'").first()
    assert (last["gender"], last["nationality"]) == ("unknown", "unknown")

    again = open_model(spark, model)
    probes = clips.limit(40).select(F.xxhash64("file_path").alias("query_id"), "speaker_id", "embedding")
    for architecture in ("brute_force", "kmeans_clusters"):
        top = search(probes, again, architecture=architecture, top_k=1).join(
            probes.withColumnRenamed("speaker_id", "truth"), "query_id"
        )
        assert top.where("speaker_id <> truth").count() == 0
    one = again.gallery.where("cluster_id = 3")
    assert "PartitionFilters: [isnotnull(cluster_id" in one._jdf.queryExecution().executedPlan().toString()

    # speakers that are there are kept as they are
    insert_absent(spark.createDataFrame([("id00", "x", "x"), ("new", "male", "Z")], known.schema), model)
    people = {r["speaker_id"]: r["gender"] for r in model_table(spark, model, "speakers").collect()}
    assert people["id00"] == "female" and people["new"] == "male" and len(people) == 13

    results = sweep(probes, again, cluster_probes=(1, 2), metadata_probes=(1,))
    save_results(results.withColumn("model", F.lit(model.name)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("model = 'tiny'").count() == 12
    row = report(results, profile.database_summary(again), model=model.name, query_count=40).first()
    assert row["database_summary"]["speakers"] == 13 and len(row["results_by_metric"]["cosine"]) == 12
    described = profile.table_profile(profile.database_tables(spark, model.namespace))
    assert {(r["table"], r["rows"]) for r in described.collect()} == {
        ("speakers", 13), ("audio_embeddings", 240), ("metadata_centroids", 6), ("cluster_centroids", 6),
    }


def test_tables_are_kept_and_replaced(spark):
    model = Model("kept", 2, "kept_model")
    ensure_tables(spark, model)
    rows = spark.createDataFrame([(1, "a", "p", [1.0, 2.0], None), (2, "a", "q", [1.0, 3.0], 4)],
                                 "id long, speaker_id string, file_path string, embedding array<double>, cluster_id int")
    rebuild(rows, model, "audio_embeddings")
    ensure_tables(spark, model)
    assert model_table(spark, model, "audio_embeddings").count() == 2
    rebuild(rows.where("id = 1"), model, "audio_embeddings")
    assert [r["cluster_id"] for r in model_table(spark, model, "audio_embeddings").collect()] == [None]
    with pytest.raises(KeyError):
        model_table(spark, model, "other")


def test_wrong_width_stops_the_enrolment(spark, clips):
    with pytest.raises(Exception, match="expected vectors of width 5"):
        enroll(Model("wide", 5, "wide_model"), clips, spark.createDataFrame([], "speaker_id string, gender string, nationality string"))


def test_training_repeats_and_steps_lower_the_cost(spark, clips):
    gallery = clips.select(F.xxhash64("file_path").alias("id"), "speaker_id", "embedding")
    first = train_clusters(gallery, 5)
    second = train_clusters(gallery.repartition(7), 5)
    centres = [sorted((r["cluster_id"], r["centroid"]) for r in t.centroids.collect()) for t in (first, second)]
    assert centres[0] == centres[1]
    assert all(sum(x * x for x in c) == pytest.approx(1) for _, c in centres[0])
    labelled = first.label(gallery)
    assert labelled.where("cluster_id IS NULL").count() == 0 and labelled.count() == 240

    from nearkin.functions.vectors import dot, l2_normalize
    from nearkin.operators.clusters import assign_clusters

    centroids = spark.createDataFrame(
        [(i, r["embedding"]) for i, r in enumerate(gallery.orderBy("id").limit(5).collect())],
        "cluster_id int, centroid array<double>",
    ).withColumn("centroid", l2_normalize(F.col("centroid")))
    closeness = []
    for _ in range(3):
        placed = assign_clusters(gallery, centroids).join(centroids, "cluster_id")
        closeness.append(placed.agg(F.sum(dot(l2_normalize(F.col("embedding")), F.col("centroid")))).first()[0])
        centroids = spark.createDataFrame(lloyd_step(gallery, centroids).collect(), centroids.schema)
    assert closeness == sorted(closeness)


def test_checks_on_inputs(spark):
    frame = spark.createDataFrame([("a", "p", [1.0, 2.0]), (None, "q", [1.0]), ("b", "r", None)],
                                  "speaker_id string, file_path string, embedding array<double>")
    got = {r["check_name"]: r["violations"] for r in profile.contract_check(frame, 2).collect()}
    assert got == {"missing_columns": 0, "no_rows": 0, "missing_label": 1, "missing_vector": 1, "wrong_width": 1}
    got = {r["check_name"]: r["violations"] for r in profile.contract_check(frame.drop("file_path").limit(0), 2).collect()}
    assert got["missing_columns"] == 1 and got["no_rows"] == 1
    people = spark.createDataFrame([("a", "male", "X")], "speaker_id string, gender string, nationality string")
    checks = profile.stage_check("populate", {"gallery": frame, "metadata": people}, 2)
    assert checks.count() == 8 and checks.where("input = 'metadata' AND violations > 0").count() == 0
    with pytest.raises(ValueError, match="Unknown stage"):
        profile.stage_check("serve", {}, 2)
    with pytest.raises(ValueError, match="needs the input"):
        profile.stage_check("evaluate", {}, 2)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_non_finite_vectors_are_refused(spark, bad):
    from nearkin.operators.topk import to_matrix
    from nearkin.sources.readers import as_probes, require_dim

    frame = spark.createDataFrame([(1, "a", [1.0, bad])], "query_id long, speaker_id string, embedding array<double>")
    for checked in (require_dim(frame, 2), as_probes(frame)):
        with pytest.raises(Exception, match="non-finite elements in a vector: 1"):
            checked.collect()
    import pyarrow as pa

    with pytest.raises(ValueError, match="non-finite"):
        to_matrix(pa.array([[1.0, bad]], pa.list_(pa.float64())))


def test_only_one_row_of_a_new_key(spark):
    from nearkin.sources.tables import with_absent

    schema = "speaker_id string, gender string"
    old, new = spark.createDataFrame([("b", "x")], schema), spark.createDataFrame([("a", "m"), ("a", "f"), ("b", "y")], schema)
    assert sorted(map(tuple, with_absent(old, new).collect())) == [("a", "f"), ("b", "x")]


def test_metadata_quotes_and_missing_id(spark, tmp_path):
    from nearkin.sources.readers import read_metadata

    quoted, without = tmp_path / "q.csv", tmp_path / "w.csv"
    quoted.write_text('VoxCeleb1 ID,Gender,Nationality\nid1,m,"Say ""x"", y"\n')
    without.write_text("Gender,Nationality\nm,X\n")
    assert [r["nationality"] for r in read_metadata(spark, str(quoted)).collect()] == ['Say "x", y']
    assert read_metadata(spark, str(without)).count() == 0
