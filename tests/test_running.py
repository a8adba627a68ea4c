from pyspark.sql import functions as F

from quire.operators.running import hash_bin, running_total, running_totals


def test_running_total_over_bins_and_groups(spark):
    rows = [(g, i, None if i == 5 else i) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn("h", F.xxhash64("i")).withColumn("bin", hash_bin(F.col("h"), 8))
    got = running_total(df, "v", "bin", ["h"], "sum", ["g"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])
        total = 0
        for r in mine:
            total += r["v"] or 0
            assert r["sum"] == total
    assert {r["bin"] for r in got} <= set(range(8))


def test_several_totals_at_once(spark):
    df = spark.createDataFrame([(i, i % 3, 1) for i in range(20)], "i int, v int, w int").withColumn("bin", (F.col("i") / 7).cast("int"))
    got = sorted(running_totals(df, {"a": "v", "b": "w"}, "bin", ["i"]).collect(), key=lambda r: r["i"])
    assert [r["b"] for r in got] == list(range(1, 21)) and got[-1]["a"] == sum(i % 3 for i in range(20))
    assert running_totals(df.limit(0), {"a": "v"}, "bin", ["i"]).count() == 0
