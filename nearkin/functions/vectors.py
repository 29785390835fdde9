"""Vector arithmetic as Spark columns over ``array<double>``.

Everything here stays in the JVM. A value that several lambda steps need is
bound once through ``_let``: inside a lambda Spark would evaluate it again for
every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean")
# Vectors no longer than this keep their length when normalised.
NORM_FLOOR = 1e-12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def as_double(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(a: Column) -> Column:
    return _let(
        norm(a),
        lambda n: F.when(n > NORM_FLOOR, F.transform(a, lambda x: x / n)).otherwise(a),
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """Null when either vector is zero, so such rows sort last."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.lit(1.0) - dot(a, b) / lengths)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
            F.lit(0.0),
            lambda total, x: total + x,
        )
    )


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; choose from {', '.join(METRICS)}")
    return metric


def distance(metric: str, a: Column, b: Column) -> Column:
    check_metric(metric)
    return cosine_distance(a, b) if metric == "cosine" else euclidean_distance(a, b)


def score_from_distance(metric: str, d: Column) -> Column:
    check_metric(metric)
    return F.lit(1.0) - d if metric == "cosine" else -d


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` to ``array<double>``; anything else raises when evaluated."""
    values = F.from_json(text, "array<double>")
    return F.when(values.isNotNull(), values).otherwise(
        F.raise_error(F.concat(F.lit("not a vector: "), F.coalesce(text, F.lit("null"))))
    )


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """What ``a * b`` lost to rounding, exactly (Dekker's product)."""

    def high(x: Column) -> Column:
        return x * 134217729.0 - (x * 134217729.0 - x)

    ah, bh = high(a), high(b)
    al, bl = a - ah, b - bh
    return ((ah * bh - product) + ah * bl + al * bh) + al * bl


def round_12(x: Column) -> Column:
    """The nearest number with 12 significant digits, judged on the exact binary value.

    Outside 1e-11 .. 1e12 the printed digits are rounded instead.
    """
    exponent = F.substring_index(F.format_string("%.11e", x), "e", -1).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(11) - exponent)

    def rounded(power: Column) -> Column:
        scaled = F.abs(x) * power
        whole = F.floor(scaled).cast("double")
        rest = (scaled - whole - 0.5) + _product_error(F.abs(x), power, scaled)
        up = (rest > 0) | ((rest == 0) & (whole % 2 == 1))
        return F.signum(x) * (whole + up.cast("int")) / power

    exact = (F.abs(x) >= 1e-11) & (F.abs(x) < 1e12)
    return F.when(exact, _let(scale, rounded)).otherwise(x)


def format_number_12(x: Column) -> Column:
    """A number with 12 significant digits in general notation, zeros cut."""
    scientific = F.format_string("%.11e", round_12(x))

    def general(s: Column) -> Column:
        exponent = F.substring_index(s, "e", -1).cast("int")
        mantissa = F.regexp_replace(F.substring_index(s, "e", 1), r"\.?0+$", "")
        fixed = F.regexp_replace(s.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
        return F.when(x == 0, "0").when(exponent.between(-4, 11), fixed).otherwise(
            F.concat(mantissa, F.lit("e"), F.substring_index(s, "e", -1))
        )

    return _let(scientific, general)


def format_vector(a: Column) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.transform(a, format_number_12), ","), F.lit("]")
    )


def round6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)
