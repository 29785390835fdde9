"""Scores of ranked speakers against the truth.

``probes`` holds one row per probe with ``query_id`` and the true ``speaker_id``;
``ranked`` holds ``query_id, rank, speaker_id, score``.  ``by`` names columns that
separate several searches held in one frame; both frames carry them.
All metrics are percentages, and zero where nothing can be measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.operators.order import totals_before

NO_PREDICTION = "__NO_PREDICTION__"
NO_SCORE = -1.0
METRIC_NAMES = ("top1_accuracy", "hit_k", "precision", "recall", "f1", "eer")


def outcomes(probes: DataFrame, ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per probe: ``truth, prediction, score, correct, hit``.

    Probes without hits stay, with the no-prediction label and score.
    """
    truth = probes.select(*by, "query_id", F.col("speaker_id").alias("truth"))
    joined = truth.join(ranked, [*by, "query_id"], "left")
    first = F.col("rank") == 1
    # null: no hit at all; a hit at a zero vector has a null score of its own
    best = F.max(F.when(first, F.struct("speaker_id", "score")))
    rows = joined.groupBy(*by, "query_id", "truth").agg(
        best.alias("best"),
        F.coalesce(F.max((F.col("speaker_id") == F.col("truth")).cast("int")), F.lit(0)).alias("hit"),
    )
    prediction = F.coalesce(F.col("best.speaker_id"), F.lit(NO_PREDICTION))
    return rows.select(
        *by, "query_id", "truth", prediction.alias("prediction"),
        F.when(F.col("best").isNull(), F.lit(NO_SCORE)).otherwise(F.col("best.score")).alias("score"),
        (F.col("truth") == prediction).cast("int").alias("correct"), "hit",
    )


def _percent(share: Column) -> Column:
    return F.coalesce(share * 100.0, F.lit(0.0))


def accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Top-1 accuracy and hit@k."""
    return rows.groupBy(*by).agg(
        _percent(F.avg("correct")).alias("top1_accuracy"), _percent(F.avg("hit")).alias("hit_k")
    )


def class_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(class, tp, fp, fn)`` over all true and predicted labels."""
    right = F.col("correct")
    sides = F.array(
        F.struct(F.col("truth").alias("class"), right.alias("tp"), F.lit(0).alias("fp"),
                 (1 - right).alias("fn")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("tp"), (1 - right).alias("fp"),
                 F.lit(0).alias("fn")),
    )
    exploded = rows.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    return exploded.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def macro_scores(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 averaged over classes; F1 is averaged per class."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(whole: Column, part: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return counts.groupBy(*by).agg(
        _percent(F.avg(share(tp + fp, tp))).alias("precision"),
        _percent(F.avg(share(tp + fn, tp))).alias("recall"),
        _percent(F.avg(share(2 * tp + fp + fn, 2 * tp))).alias("f1"),
    )


def equal_error_rate(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal error rate of accepting a top-1 result by its score.

    Every distinct score, in single precision, is a threshold.  The one with the least gap between
    false acceptance and false rejection wins, the lowest on ties.  A missing
    score is below every threshold.
    """
    if not by:
        return _as_one_group(equal_error_rate, rows, ["eer"])
    score = F.coalesce(F.col("score").cast("float").cast("double"), F.lit(float("-inf")))
    per_score = rows.groupBy(*by, score.alias("score")).agg(
        F.sum("correct").alias("pos"), F.sum(1 - F.col("correct")).alias("neg")
    )
    summed = totals_before(per_score, "score", ["pos", "neg"], by)
    totals = rows.groupBy(*by).agg(
        F.sum("correct").alias("all_pos"), F.sum(1 - F.col("correct")).alias("all_neg")
    )
    # rejected positives scored lower; accepted negatives are those that did not
    far = (F.col("all_neg") - F.col("neg_before")) / F.nullif("all_neg", F.lit(0))
    frr = F.col("pos_before") / F.nullif("all_pos", F.lit(0))
    rates = summed.join(totals, list(by)).select(
        *by, "score", F.abs(far - frr).alias("gap"), ((far + frr) / 2).alias("rate")
    )
    best = F.min_by("rate", F.when(F.col("gap").isNotNull(), F.struct("gap", "score")))
    return rates.groupBy(*by).agg(_percent(best).alias("eer"))


def speaker_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All six metrics, one row per search."""
    if not by:
        return _as_one_group(speaker_metrics, rows, list(METRIC_NAMES))
    keys = list(by)
    macro = macro_scores(class_counts(rows, by), by)
    return accuracy(rows, by).join(macro, keys).join(equal_error_rate(rows, by), keys)


def _as_one_group(measure, rows: DataFrame, names: list[str]) -> DataFrame:
    """One row also for no probes at all, then with zeros."""
    measured = measure(rows.withColumn("_all", F.lit(0)), ("_all",))
    return measured.agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
