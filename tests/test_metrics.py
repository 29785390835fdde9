import random

import pytest

from nearkin.operators.metrics import (
    accuracy,
    class_counts,
    equal_error_rate,
    macro_scores,
    outcomes,
    speaker_metrics,
)

RANKED = "query_id long, rank int, speaker_id string, score double"


def make(spark, truths, ranked):
    probes = spark.createDataFrame(list(enumerate(truths)), "query_id long, speaker_id string")
    return outcomes(probes, spark.createDataFrame(ranked, RANKED))


def eer_loop(rows):
    pos, neg = [s for s, c in rows if c], [s for s, c in rows if not c]
    if not pos or not neg:
        return 0.0
    best = None
    for t in sorted({s for s, _ in rows}):
        far, frr = sum(s >= t for s in neg) / len(neg), sum(s < t for s in pos) / len(pos)
        if best is None or abs(far - frr) < best[0]:
            best = (abs(far - frr), (far + frr) / 2 * 100)
    return best[1]


@pytest.mark.parametrize("seed", range(4))
def test_eer_equals_the_threshold_loop(spark, seed):
    random.seed(seed)
    rows = [(round(random.gauss(0.3 * (i % 2), 0.3), 2), i % 2) for i in range(150)]
    frame = spark.createDataFrame(rows, "score double, correct int")
    assert equal_error_rate(frame).first()["eer"] == pytest.approx(eer_loop(rows))


@pytest.mark.parametrize("rows", [[], [(0.5, 1), (0.4, 1)], [(0.5, 0)], [(0.5, 1), (0.5, 0)]])
def test_eer_edges(spark, rows):
    frame = spark.createDataFrame(rows, "score double, correct int")
    assert equal_error_rate(frame).first()["eer"] == pytest.approx(eer_loop(rows))


def test_probes_without_hits_count(spark):
    rows = make(spark, ["a", "b", "c"], [(0, 1, "a", 0.9), (0, 2, "b", 0.5), (1, 1, "a", 0.8), (1, 2, "b", 0.7)])
    got = {r["query_id"]: r for r in rows.collect()}
    assert (got[2]["prediction"], got[2]["score"], got[2]["hit"]) == ("__NO_PREDICTION__", -1.0, 0)
    score = accuracy(rows).first()
    assert score["top1_accuracy"] == pytest.approx(100 / 3)
    assert score["hit_k"] == pytest.approx(200 / 3)
    counts = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in class_counts(rows).collect()}
    assert counts == {"a": (1, 1, 0), "b": (0, 0, 1), "c": (0, 0, 1), "__NO_PREDICTION__": (0, 1, 0)}
    macro = macro_scores(class_counts(rows)).first()
    assert macro["precision"] == pytest.approx(100 * 0.5 / 4)
    assert macro["recall"] == pytest.approx(100 * 1 / 4)
    assert macro["f1"] == pytest.approx(100 * (2 / 3) / 4)


def test_a_hit_without_a_score_is_still_a_hit(spark):
    got = make(spark, ["a"], [(0, 1, "a", None)]).first()
    assert (got["prediction"], got["score"], got["correct"]) == ("a", None, 1)


def test_no_probes_give_zeros(spark):
    empty = spark.createDataFrame([], "query_id long, speaker_id string")
    row = speaker_metrics(outcomes(empty, spark.createDataFrame([], RANKED))).first()
    assert row.asDict() == dict.fromkeys(
        ("top1_accuracy", "hit_k", "precision", "recall", "f1", "eer"), 0.0
    )
