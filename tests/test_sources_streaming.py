import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import distributions as dist
from lamella.operators import kernels
from lamella.operators import tables as t
from lamella.sources import files
from lamella.streaming import flows
from tests.conftest import SMALL


def test_csv_round_trip_and_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b,c")], "k int, v double, s string")
    files.write_csv(df, str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), "k int, v double, s string").drop("_corrupt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_log_skips_half_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1, "s": "ok"}\n{"k": 2, "s": "ok"}\n{"k": 3, "s"')
    assert len(files.read_log(spark, str(tmp_path / "log.jsonl"), "k int, s string").collect()) == 2


def test_json_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e-310,), (123456.7890123456,), (None,)], "v double")
    got = [r[0] for r in df.select(files.clean_number(F.col("v"))).collect()]
    assert got == [None, None, 0.0, pytest.approx(123456.7890, abs=1e-4), None]


def test_partitions_discovery_publish(spark, tmp_path):
    df = spark.createDataFrame([("b1", "s1", [1.0]), ("b1", "s2", [1.0, 2.0])], "batch string, spot string, x array<double>")
    files.write_partitioned(df, str(tmp_path / "t"), ["batch", "spot"])
    keys = files.discover(spark, str(tmp_path / "t"), r"batch=(\w+)/spot=(\w+)/", ["batch", "spot"])
    assert sorted(map(tuple, keys.collect())) == [("b1", "s1"), ("b1", "s2")]
    assert files.narrow_arrays(spark, str(tmp_path / "t"), "x", 1).count() == 1
    files.publish(df, str(tmp_path / "p"))


def test_inverted_abstract(spark):
    df = spark.createDataFrame([(1, {"a": [1, 3], "b": [0], "c": [2]})], "k int, idx map<string,array<int>>")
    assert files.from_positions(df, "k", "idx").collect()[0]["text"] == "b a c a"


def test_one_to_one_refuses_duplicates(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(Exception, match="not unique"):
        t.one_to_one(a, b, ["k"]).collect()


def test_distributions():
    assert dist.t_cdf(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.975, abs=1e-8)
    assert dist.f_cdf(np.array([4.964602744]), 1, 10)[0] == pytest.approx(0.95, abs=1e-7)
    assert dist.chi2_cdf(np.array([18.307038053]), np.array([10.0]))[0] == pytest.approx(0.95, abs=1e-8)
    assert dist.normal_cdf(np.array([1.959963984540054]))[0] == pytest.approx(0.975, abs=1e-12)
    assert dist.quantile(lambda m: dist.t_cdf(m, 5.0), np.array([0.95]), -100, 100)[0] == pytest.approx(2.015048373, abs=1e-7)


def test_t_columns(spark):
    r = spark.createDataFrame([(0.975, 10.0), (None, 3.0)], "p double, df double").select(dist.t_quantile(F.col("p"), F.col("df")).alias("q")).collect()
    assert r[0]["q"] == pytest.approx(2.228138852, abs=1e-6) and (r[1]["q"] is None or np.isnan(r[1]["q"]))


def test_kernels_against_brute_force():
    r = np.random.default_rng(0)
    m = r.random((9, 13)) < 0.4
    ys, xs = np.nonzero(m)
    d = kernels.distance_array(m)
    for y in range(9):
        for x in range(13):
            assert d[y, x] == pytest.approx(np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()))
    for eight in (False, True):
        lab = kernels.label_array(m, eight)
        seen, want = {}, np.zeros_like(lab)
        for y, x in zip(ys, xs):
            if (y, x) in seen:
                continue
            stack, first = [(y, x)], y * 13 + x + 1
            while stack:
                p = stack.pop()
                if p in seen or not (0 <= p[0] < 9 and 0 <= p[1] < 13) or not m[p]:
                    continue
                seen[p] = 1
                want[p] = first
                stack += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
        assert (lab == want).all()
    assert kernels.hull_area(np.array([0, 0, 1]), np.array([0, 1, 0])) == pytest.approx(3.5)
    v = r.random((8, 8))
    assert kernels.gaussian_array(v, 0.8).sum() == pytest.approx(v.sum(), rel=0.2)


def stream(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{c} {k}" for c, k in spark.read.parquet(str(tmp_path / "in")).dtypes)
    return flows.follow(spark, str(tmp_path / "in"), schema)


def drained(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows_and_state(spark, tmp_path):
    s = stream(spark, tmp_path)
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    got = drained(spark, flows.windowed(s, "ts", "event_type", "value", "1000 days", "1 day"), "update", "w1")
    assert got.groupBy("event_type").agg(F.countDistinct("start")).count() == batch.select("event_type").distinct().count()
    total = drained(spark, flows.running_totals(s, "event_type", "value", "string"), "update", "w2").groupBy("event_type").agg(F.max("n").alias("n"))
    assert {r["event_type"]: r["n"] for r in total.collect()} == {r["event_type"]: r["count"] for r in batch.groupBy("event_type").count().collect()}
    assert drained(spark, flows.once(s, ["user_id"], "ts", "1000 days"), "append", "w3").count() == batch.select("user_id").distinct().count()


def test_incremental_work_is_done_once(spark, tmp_path):
    for _ in range(2):
        s = stream(spark, tmp_path) if not (tmp_path / "in").exists() else flows.follow(spark, str(tmp_path / "in"), ", ".join(f"{c} {k}" for c, k in spark.read.parquet(str(tmp_path / "in")).dtypes))
        flows.incremental(s, lambda d: d.select("user_id", "value"), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("user_id").distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
