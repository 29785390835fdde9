from pyspark.sql import functions as F

from nearkin.operators.order import number_rows, totals_before


def test_rows_are_numbered_over_all_partitions(spark):
    # A third of the rows share the leading value.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 101).alias("a"), F.col("id").alias("b")
    )
    got = number_rows(rows, [F.desc("a"), F.asc("b")], "n").orderBy("n").collect()
    want = sorted(((r["a"], r["b"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(*w, i + 1) for i, w in enumerate(want)]


def test_totals_before(spark):
    rows = spark.range(2000).select(
        (F.col("id") % 2).alias("g"), (F.col("id") * 37 % 2000).alias("x"), (F.col("id") % 5).alias("v")
    )
    got = totals_before(rows, "x", ["v"], ("g",)).collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["x"]):
            assert r["v_before"] == total
            total += r["v"]
