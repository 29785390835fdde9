import random

import pytest
from pyspark.sql import functions as F

from nearkin.functions import text, vectors as vec
from nearkin.models import get_model


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_products_and_distances(spark):
    a, b = arr(3, 4), arr(4, 3)
    assert one(spark, vec.dot(a, b)) == 24
    assert one(spark, vec.norm(a)) == 5
    assert one(spark, vec.cosine_distance(a, b)) == pytest.approx(1 - 24 / 25)
    assert one(spark, vec.euclidean_distance(a, b)) == pytest.approx(2**0.5)
    assert one(spark, vec.cosine_distance(a, arr(0, 0))) is None


def test_normalise_leaves_short_vectors(spark):
    assert one(spark, vec.l2_normalize(arr(3, 4))) == [0.6, 0.8]
    assert one(spark, vec.l2_normalize(arr(0, 0))) == [0, 0]
    assert one(spark, vec.l2_normalize(arr(1e-13, 0))) == [1e-13, 0]


def test_metric_dispatch(spark):
    assert one(spark, vec.score_from_distance("cosine", F.lit(0.25))) == 0.75
    assert one(spark, vec.score_from_distance("euclidean", F.lit(0.25))) == -0.25
    for call in (vec.check_metric, lambda m: vec.distance(m, arr(1), arr(1))):
        with pytest.raises(ValueError, match="no metric"):
            call("manhattan")
    with pytest.raises(KeyError, match="Unknown model"):
        get_model("nothing")


def test_vector_text(spark):
    random.seed(1)
    values = [0.0, 1.0, -1.0, 100.0, 1e-4, 1.5e-5, 123456789012.0, 1e12, 0.1, -2.5e20, 1 / 3]
    values += [-0.06384302303195, 0.5 + 2**-13, 0.0123456789012500, 1.00000000000500, 999999999999.5]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-8, 14) for _ in range(300)]
    rows = spark.createDataFrame([(values,)], "v array<double>")
    written = rows.select(vec.format_vector(F.col("v")).alias("t")).first()["t"]
    assert written == "[" + ",".join(f"{v:.12g}" for v in values) + "]"
    back = spark.createDataFrame([(written,)], "t string").select(vec.parse_vector(F.col("t")).alias("v"))
    assert back.first()["v"] == pytest.approx(values, rel=1e-11)
    with pytest.raises(Exception, match="not a vector"):
        one(spark, vec.parse_vector(F.lit("abc")))


def test_labels_and_paths(spark):
    genders = {" M ": "male", "male\n": "male", "\tF": "female", "x": "unknown", "": "unknown", None: "unknown"}
    for raw, want in genders.items():
        assert one(spark, text.clean_gender(F.lit(raw).cast("string"))) == want
    assert one(spark, text.clean_nationality(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, text.clean_nationality(F.lit(" New Zealand "))) == "New Zealand"
    label = F.lit("male:A:B")
    assert one(spark, text.nationality_of(label)) == "A:B"
    assert one(spark, text.gender_of(label)) == "male"
    assert one(spark, text.nationality_of(F.lit("male"))) is None
    path = F.lit("/wav/id1/vid2/00001.wav")
    assert one(spark, text.speaker_of(path)) == "id1"
    assert one(spark, text.video_of(path)) == "vid2"
    assert one(spark, text.is_clip(path)) and not one(spark, text.is_clip(F.lit("a.txt")))
