"""Published golden values of the operators."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import catalog
from skyloom.functions import scaling as S
from skyloom.functions import text as X
from skyloom.operators import files, metrics, network, periods, series, splits, tensors
from skyloom.plans import config
from skyloom.sources import samples
from skyloom.streaming import twins


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_normalise(spark):
    df = S.with_bounds(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double"), "v")
    got = values(df, S.normalize(F.col("v"), F.col("_low"), F.col("_high")))
    assert min(got) == -1 and max(got) == 1
    known = values(df, S.normalize(F.col("v"), F.lit(0.0), F.lit(4.0)))
    assert min(known) > -1 and max(known) == 1


def test_normalise_log(spark):
    df = spark.createDataFrame([(-1e-7,), (1.0,), (10.0,), (100.0,)], "v double")
    got = values(df, S.normalize_log(F.col("v"), F.lit(-1e-6), F.lit(1000.0), F.lit(1e-8)))
    assert all(-1 < x < 1 for x in got)
    back = S.inverse_normalize_log(S.normalize_log(F.col("v"), F.lit(-1e-6), F.lit(1000.0), F.lit(1e-8)), F.lit(-1e-6), F.lit(1000.0), F.lit(1e-8))
    assert np.allclose(values(df, back), [-1e-7, 1, 10, 100])


def test_empty_range_is_null(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert values(df, S.normalize(F.col("v"), F.lit(5.0), F.lit(5.0))) == [None]
    with pytest.raises(ValueError):
        S.normalize(F.col("v"), F.lit(0), F.lit(1), [0, 1])


def test_post_process(spark):
    df = spark.createDataFrame([(n, y) for n in ("HRDPS_P_TT_10000", "HRDPS_P_PR_SFC", "HRDPS_P_UUC_10000", "nothing") for y in (-1.0, 1.0)], "variable string, y double")
    rows = catalog.with_variable(df, "variable").select("variable", "y", S.by_variable(F.col("y")).alias("v")).collect()
    got = {(r.variable, r.y): r.v for r in rows}
    assert got["HRDPS_P_TT_10000", 1.0] == 40 and got["HRDPS_P_UUC_10000", -1.0] == -100
    assert got["HRDPS_P_PR_SFC", -1.0] == pytest.approx(0, abs=1e-12) and got["HRDPS_P_PR_SFC", 1.0] == pytest.approx(0.001)
    assert got["nothing", 1.0] is None


def test_catalogue():
    rows = {r["name"]: r for r in catalog.variable_rows()}
    assert len(rows) == 60
    assert rows["TT850_anomaly"]["mean_min"] == -30 and rows["TT850"]["mean_min"] == -25
    assert rows["TT850"]["file_key"] == "TT_pressure_levels" and rows["HU500"]["file_key"] == "HU"


def test_split():
    assert splits.split_sizes(10) == (8, 1, 1)


def test_shuffled_split(spark):
    got = splits.split_by_rank(spark.range(10), [], shuffle_seed=1, id_col="id").orderBy("idx").collect()
    assert [r.split for r in got].count("train") == 8
    assert [r.id for r in got[:8]] != sorted(r.id for r in got[:8])


@pytest.mark.parametrize("case", [(0, 10, [0, 9, 10, 20], [0, 0, 1, 2]), (32, 32, [0, 1, 2], [0, 1, 2]), (32, 64, [0, 1, 2, 3, 4], [0, 0, 1, 1, 2])])
def test_save_index(spark, case):
    built_in, save, idx, want = case
    df = spark.createDataFrame([(i,) for i in idx], "i long").coalesce(1)
    assert values(df, splits.save_index(F.col("i"), save, built_in)) == want
    with pytest.raises(ValueError):
        splits.save_index(F.col("i"), 10, 4)


def test_index_out_of_range(spark):
    df = spark.range(5).withColumnRenamed("id", "idx")
    assert values(splits.at_index(df, "idx", [3]), "idx") == [3]
    with pytest.raises(Exception, match="out of range"):
        splits.at_index(df, "idx", [5]).collect()


def test_digests(spark):
    df = spark.createDataFrame([("train", 1), ("validation", 1), ("train", 2), ("train", 32)], "s string, n int").coalesce(1)
    assert values(df, X.hex_digest(X.state_text(F.col("s"), ["input1", "output1"], F.col("n")))) == ["b5e241cc", "594e9fc9", "2d41ca46", "75dc3e67"]
    assert values(spark.createDataFrame([("input1",), ("input2",)], "s string").coalesce(1), X.hex_digest(F.col("s"))) == ["1ea06586", "124d8541"]


def bucket_plan(n, limit, keep_start=0, keep_end=0):
    """Bucket of each of n points, by appending them one by one."""
    sizes = []
    for _ in range(n):
        sizes.append(1)
        if len(sizes) > limit:
            end = len(sizes) - keep_end
            middle = sizes[keep_start:end]
            sizes = sizes[:keep_start] + [sum(middle[i : i + 2]) for i in range(0, len(middle), 2)] + sizes[end:]
    return [b for b, size in enumerate(sizes) for _ in range(size)]


def test_compaction_plans():
    sizes = lambda *a: np.bincount(bucket_plan(*a)).tolist()
    assert len(sizes(101, 100)) == 51 and sizes(101, 100)[0] == 2
    assert len(sizes(101, 100, 5, 10)) == 58 and sizes(101, 100, 5, 10)[4] == 1
    assert len(sizes(201, 100)) == 51 and sizes(201, 100)[0] == 8


@pytest.mark.parametrize("limit,start,end", [(3, 0, 0), (2, 0, 0), (15, 0, 0), (16, 0, 0), (100, 5, 10), (20, 3, 5), (20, 0, 9), (9, 4, 0), (7, 3, 3), (12, 1, 10)])
def test_closed_form(spark, limit, start, end):
    points = [n for n in (1, 2, limit, limit + 1, limit + 2, 2 * limit + 3, 151, 400)]
    df = spark.createDataFrame([(n, i) for n in points for i in range(n)], "n long, i long")
    got = df.select("n", "i", series.bucket_of(F.col("i"), F.col("n"), limit, start, end).alias("b")).collect()
    plans = {n: bucket_plan(n, limit, start, end) for n in points}
    assert all(r.b == plans[r.n][r.i] for r in got)
    with pytest.raises(ValueError):
        series.bucket_of(F.col("i"), F.col("n"), 5, 3, 2)


def test_compaction_values(spark):
    df = spark.createDataFrame([("m", t, 1000.0 * t) for t in range(201)], "s string, t long, v double")
    got = series.compact(df, "s", ["t"], "t", "v", 100).orderBy("bucket").collect()
    assert len(got) == 51 and (got[0].time, got[0].lo, got[0].hi, got[0].cnt, got[0].value) == (3.5, 0, 7, 8, 3500)
    assert (got[-1].time, got[-1].lo, got[-1].value) == (200, None, 200000)


def test_minima(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("a", 3, 0.6), ("b", 1, float("nan")), ("b", 2, 1.0)], "m string, i int, v double")
    got = {r.m: (r.min_value, r.min_iteration) for r in metrics.minima(df, "m", "v", "i").collect()}
    assert got["a"] == (0.4, 2) and got["b"][1] == 1 and np.isnan(got["b"][0])


def test_durations(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0.1, 1, 59, 60, 61, 3600, 3661, 90061)], "s double").coalesce(1)
    assert values(df, X.readable_duration(F.col("s"))) == ["0 µs", "100 ms", "1 s", "59 s", "1 min 0 s", "1 min 1 s", "1 h 0 min", "1 h 1 min", "1 d 1 h"]


def test_values(spark):
    df = spark.createDataFrame([(x,) for x in (20.0, 0.001, 0.1, 100.3, 1500.456, 100200.2, 1.5e6)], "v double").coalesce(1)
    assert values(df, X.readable_value(F.col("v"))) == ["20", "1.0000e-03", "0.1000", "100.30", "1500.46", "100200", "1.5000e+06"]
    assert values(df.limit(1), X.readable_value(F.col("v"), high=1.0)) == ["2.0e+01"]


def test_memory(spark):
    df = spark.createDataFrame([(x,) for x in (500, 2048, 5 * 1024**2, 3 * 1024**3, 2 * 1024**4)], "b long").coalesce(1)
    assert values(df, X.readable_bytes(F.col("b"))) == ["500 B", "2 KB", "5 MB", "3 GB", "2 TB"]


def test_manifests(spark):
    df = spark.createDataFrame([(1, "f1\nf2\nf3"), (2, "f3\r\nf4\n\nf5\n  ")], "file int, text string")
    got = files.merge_manifests(files.lines(df, "file", "text")).orderBy("file", "line_no")
    assert values(got, "line") == ["f1", "f2", "f3", "f4", "f5", "  "]


def test_log_filter(spark):
    df = files.lines(spark.createDataFrame([("a", "x\n[WARNING] y"), ("b", "z")], "file string, text string"), "file", "text")
    assert files.filter_logs(df, ["[WARNING]"]).count() == 2
    assert values(files.without_match(df, ["[WARNING]"]), "file") == ["b"]
    assert files.filter_logs(df, []).count() == 0 and files.filter_logs(df, None).count() == 5


def test_periods(spark):
    a, b = periods.decode_period(F.col("p"))
    df = spark.createDataFrame([("2026010100_2026013123",)], "p string")
    assert df.select(a, b).first()[:] == (datetime(2026, 1, 1), datetime(2026, 1, 31, 23))
    split = lambda clamp: sorted(values(periods.split_period(spark, datetime(2026, 1, 1), datetime(2026, 1, 31, 23), 32, timedelta(hours=12), clamp), "period"))
    assert split(False) == ["2026010100_2026011612", "2026011700_2026020112"]
    assert split(True) == ["2026010100_2026011612", "2026011700_2026013112"]
    with pytest.raises(Exception, match="no period"):
        spark.createDataFrame([("20260101_20260131",)], "p string").select(a).collect()


def test_listing(spark):
    df = spark.createDataFrame([(f"f{i}",) for i in range(5)], "path string")
    got = files.batches_of_paths(df, "path", 2, "test").orderBy("batch").collect()
    assert [len(r.paths) for r in got] == [2, 2, 1] and got[2].manifest == "test_00000002.txt"


def test_retention(spark):
    df = spark.createDataFrame([(f"f{i}", i) for i in range(10)], "path string, mtime int")
    names = lambda **k: sorted(values(files.retention_plan(df, "path", "mtime", F.lit(10), **k), "path"))
    assert names(keep=5) == [f"f{i}" for i in range(5)]
    assert names(keep=5, older_than=F.lit(6), both=True) == [f"f{i}" for i in range(4)]
    assert names(keep=5, older_than=F.lit(100), both=True) == [] and len(names(keep=5, older_than=F.lit(100), both=True, compat=True)) == 5


def test_networks(spark):
    nets = {"default": network.Network(2, 2), "gated": network.Network(2, 2, ratio=4), "dense": network.Network(2, 2, depth=2, dense=True), "published": network.Network(5, 2, hidden=36)}
    got = {r.network: (r.parameters, r.trainable) for r in network.parameter_counts(network.layout_table(spark, nets, ("in.",))).collect()}
    assert {k: v[0] for k, v in got.items() if k != "total"} == {"default": 7_700_674, "gated": 7_915_714, "dense": 165_514, "published": 2_439_578}
    assert got["total"][0] == sum(v[0] for k, v in got.items() if k != "total") and 0 < got["default"][1] < got["default"][0]


def test_pool_and_collate(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(16)]), (2, [1.0] * 16)], "k int, a array<double>")
    got = tensors.max_pool_2x2(df, ["k"], "a", 4).where("k = 1").orderBy("y", "x")
    assert values(got, "value") == [5, 7, 13, 15]
    assert tensors.collate(df.withColumn("b", F.lit(0)), "b", "k", "a").first().a[15:17] == [15.0, 1.0]
    nested = df.select(F.lit(0).alias("b"), "k", F.struct("a", F.struct(F.array("k").alias("c")).alias("inner")).alias("s"))
    got = tensors.collate(nested, "b", "k", "s").first()
    assert got.samples == 2 and len(got.s.a) == 32 and got.s.inner.c == [1, 2]
    with pytest.raises(TypeError):
        tensors.collate(nested.withColumn("s", F.struct("s.a", "k")), "b", "k", "s")


def test_storage(spark, tmp_path):
    rows = spark.range(20).select(F.lit("train").alias("split"), F.floor(F.col("id") / 8).alias("batch_id"), (F.col("id") % 8).alias("pos"), F.col("id").alias("v"))
    samples.save_batches(rows, f"{tmp_path}/s")
    assert sorted(values(samples.load_batch(spark, f"{tmp_path}/s", "train", 1, 2, 5, ["v"]), "v")) == [10, 11, 12]
    first = samples.read_through(spark, str(tmp_path), "d1", lambda: spark.range(3))
    again = samples.read_through(spark, str(tmp_path), "d1", lambda: spark.range(99))
    assert first.count() == again.count() == 3
    assert samples.read_through(spark, str(tmp_path), "d1", lambda: None, skip_load=True).count() == 0
    with pytest.raises(FileNotFoundError):
        samples.read_through(spark, str(tmp_path), "d2", lambda: None, only_saved=True)
    with pytest.raises(Exception, match="one row"):
        samples.with_fixed(spark.range(2), spark.range(2).withColumnRenamed("id", "f")).collect()
    (tmp_path / "z").mkdir()
    np.savez(tmp_path / "z" / "x.npz", a=np.arange(6).reshape(2, 3))
    got = samples.archive_arrays(spark, f"{tmp_path}/z", "a").first()
    assert list(got["shape"]) == [2, 3] and list(got["values"]) == [0, 1, 2, 3, 4, 5]
    assert samples.file_listing(spark, f"{tmp_path}/z", "*.npz").count() == 1
    for mode, idx, want in ((0, 10, [10]), (1, 10, [10]), (2, 5, [10, 11]), (4, 3, [12, 13, 14, 15])):
        assert sorted(values(samples.load_item(spark, f"{tmp_path}/s", "train", idx, 8, mode, ["v"]), "v")) == want
    assert samples.scan_batch(spark, f"{tmp_path}/s", "train", 2).count() == 4
    assert samples.first_samples(spark.range(9), "id", None).count() == 9 and values(samples.first_samples(spark.range(9), "id", 2), "id") == [0, 1]
    samples.save_weights(spark, f"{tmp_path}/w", "e1_0", {"a": {"in": np.ones((2, 3)), "out": np.arange(4.0)}, "b": {"in": np.zeros(1)}})
    got = {(r.network, r["name"]): (list(r["shape"]), list(r["values"])) for r in samples.load_weights(spark, f"{tmp_path}/w/e1_0").collect()}
    assert got["a", "out"] == ([4], [0, 1, 2, 3]) and got["a", "in"][0] == [2, 3] and samples.load_weights(spark, f"{tmp_path}/w/e1_0", "b").count() == 1
    for name in ("l.log", "m.log", "n.txt"):
        (tmp_path / name).write_text("a\nb")
    (tmp_path / "man.json").write_text('{"log_file": "' + f"{tmp_path}/n.txt" + '"}')
    names = lambda source: sorted(r["file"].rsplit("/", 1)[1] for r in samples.log_files(spark, source).collect())
    assert names(str(tmp_path)) == ["l.log", "m.log"] and names([f"{tmp_path}/m.log"]) == ["m.log"] and names(f"{tmp_path}/man.json") == ["n.txt"]
    assert files.lines(samples.text_files(spark, f"{tmp_path}/l.log"), "file", "text").count() == 2


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("path: /x\nkeys: [p, q]\nsplit: test\n")
    got = config.load(config.DatasetConfig, tmp_path / "a.yaml", {"split": None, "path": "/y"})
    assert str(got.path) == "/y" and got.keys == ("p", "q") and got.split == "test"
    inf = config.build(config.InferenceConfig, {"path_models": "m", "path_output": "o", "networks": {"n": {"type": "UNet", "depth": 2}, "o": {"depth": 1}}})
    assert inf.networks["n"].depth == 2 and inf.networks["o"].depth == 1
    flow = config.build(config.WorkflowConfig, {"dataset": {"path": "/x"}, "steps": {"net": {"type": "UNet", "hidden": 4}, "plain": {"a": {"type": "UNet"}, "b": 1}}})
    assert flow.steps["net"].hidden == 4 and flow.steps["plain"]["a"] == config.UNetConfig() and flow.steps["plain"]["b"] == 1
    for wrong in ({"networks": {"n": {"type": "Net"}}}, {"networks": {"n": {"type": "downscaling", "dataset": {"path": "/x"}}}}):
        with pytest.raises(ValueError):
            config.build(config.InferenceConfig, {"path_models": "m", "path_output": "o"} | wrong)
    with pytest.raises(ValueError):
        config.build(config.WorkflowConfig, {"dataset": {"path": "/x"}, "steps": {"net": {"type": "unknown"}}})
    with pytest.raises(ValueError):
        catalog.configs.register("UNet")(config.UNetConfig)
    with pytest.raises(ValueError):
        config.build(config.LoopConfig, {"nope": 1})
    t = config.Templates({"log": "run_${pid}_${name}"})
    with pytest.raises(KeyError):
        t["log"]
    t.add_values(name="x")
    assert t["log"].endswith("_x") and "log" in t
    assert config.TrainingPlotConfig(("a", "b")).figure_size() == (16, 24)
    for bad in (("rel", "*.pth"), ("/abs", "*")):
        with pytest.raises(ValueError):
            config.check_safe(*bad)
    with pytest.raises(ValueError):
        catalog.columns.register("x")(lambda: 1)
        catalog.columns.register("x")(lambda: 2)


def test_streams_equal_batches(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 5")
    counted = series.counter_time(df, "user_id", ["ts", "event_id"], "t").select("user_id", "event_id", "t", "value", (F.col("t") * 10.0).alias("s")).cache()
    counted.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(counted.schema).parquet(f"{tmp_path}/in")
    twins.run_available(twins.bounded_series(stream, "user_id", "t", "value", 15), "update", f"{tmp_path}/c1", f"{tmp_path}/o1")
    key = lambda rows: sorted((str(r[0]), r.bucket, r.time, r.cnt, round(r.value, 6)) for r in rows)
    assert key(spark.read.parquet(f"{tmp_path}/o1").collect()) == key(series.compact(counted, "user_id", ["t"], "t", "value", 15).select("user_id", "bucket", "time", "cnt", "value").collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        timed = stream.withColumn("at", F.timestamp_micros(((F.col("s") + 1e9) * 1e6).cast("long")))  # after the first watermark, 1970
        twins.run_available(twins.rate_limited_stream(timed, "user_id", "event_id", "at", 25.0, 2, 1e6), "append", f"{tmp_path}/c2", f"{tmp_path}/o2")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["order"]: r.emitted for r in spark.read.parquet(f"{tmp_path}/o2").collect()}
    assert got == {r.event_id: r.emitted for r in metrics.rate_limited(counted, "user_id", "event_id", "s", 25.0, 2).collect()}
    twins.run_available(twins.running_minimum_stream(stream, "user_id", "value"), "update", f"{tmp_path}/c3", f"{tmp_path}/o3")
    least = {r.user_id: r.v for r in counted.groupBy("user_id").agg(F.min("value").alias("v")).collect()}
    assert {r.user_id: r.min_value for r in spark.read.parquet(f"{tmp_path}/o3").collect()} == least


def test_tail_of_a_series_in_several_tasks(spark):
    rows = [("hot", i, i % 7) for i in range(4000)] + [("small", i, 0) for i in range(0, 4000, 400)] + [(None, 5, 1), (None, None, 2), ("one", 3, 3)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    by_series = {}
    for r in rows:
        by_series.setdefault(r[0], []).append(r)
    for fraction, number in ((0.3, None), (None, 3)):
        wanted = [r for s in by_series.values() for r in sorted(s, key=lambda r: (r[1] is None, -(r[1] or 0)))[: number or math.ceil(len(s) * fraction)]]
        assert sorted(map(tuple, metrics.tail_part(df, "g", ["i"], fraction, number).collect()), key=repr) == sorted(wanted, key=repr)
    # as with tables that are too large to be sent to all tasks
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = metrics.tail_part(df.where("g = 'hot'"), "g", ["i"], 1.0).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks > 1


def test_ranks_of_any_keys(spark):
    """One long common prefix, hashes, ties, nulls: ranks are exact and no range is over twice the mean."""
    n = 20_000
    cases = {
        "paths": spark.range(n).select(F.concat(F.lit("/data/archive/2024/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k")),
        "hex": spark.range(n).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("k")),
        "ties": spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id"),
        "nulls": spark.range(n).select(F.when(F.col("id") % 2 > 0, F.col("id") / 3).alias("k"), "id"),
    }
    for name, df in cases.items():
        dealt = splits.dealt_by_key(df, ["k"], 16).groupBy("_slot").count().collect()
        assert len(dealt) > 10 and max(r["count"] for r in dealt) < 2 * n / 16, name
        got = splits.global_rank(df, ["k"]).orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(n))
        keys = [r.k for r in got]
        assert keys == sorted(keys, key=lambda k: (k is not None, k if k is not None else 0)), name
    assert splits.global_rank(cases["hex"].limit(0), ["k"]).count() == 0
    ranked = splits.rank_within(cases["ties"], ["k"], ["id"]).where("k = 7").orderBy("i").collect()
    assert [r.i for r in ranked] == list(range(len(ranked))) and ranked[0].n == len(ranked) and [r.id for r in ranked] == sorted(r.id for r in ranked)


def test_shuffle_stays_within_splits(spark):
    ranked = splits.split_by_rank(spark.range(50), ["id"])
    got = splits.shuffle_within(ranked, "split", "id", 3).collect()
    for name, size in (("train", 40), ("validation", 5), ("test", 5)):
        own = sorted((r.position, r.id) for r in got if r.split == name)
        assert [p for p, _ in own] == list(range(size)) and (size < 40 or [i for _, i in own] != sorted(i for _, i in own))
    assert {r.id for r in got if r.split == "train"} == set(range(40))


def test_as_of_pairs(spark):
    import bisect

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    coarse = [(at(h), k) for k, h in enumerate([0, 6, 6, 12, 40, 100])]
    fine = [(i, at(h)) for i, h in enumerate([-1, 0, 5.5, 6, 11, 17, 19, 39, 40, 46, 47, 99.5, 200])] + [(99, None)]
    got = {r.i: r.k for r in periods.pair_as_of(spark.createDataFrame(fine, "i int, t timestamp_ntz"), spark.createDataFrame(coarse, "c timestamp_ntz, k int"), "t", "c", "k", 6 * 3600).collect()}
    times = sorted({c for c, _ in coarse})
    for i, t in fine:
        j = bisect.bisect_right(times, t) - 1 if t else -1
        want = max(k for c, k in coarse if c == times[j]) if j >= 0 and t - times[j] <= timedelta(hours=6) else None
        assert got[i] == want
    assert len(got) == len(fine)


def test_messages(spark):
    rows = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, 12.0), ("b", 1, 0.0), ("b", 2, 1.0), ("b", 3, 1.5), (None, 1, 0.0)]
    got = metrics.rate_limited(spark.createDataFrame(rows, "k string, o long, s double"), "k", "o", "s", 10.0, 2)
    assert {(r.k, r.o) for r in got.where("not emitted").collect()} == {("a", 3), ("b", 3)} and got.count() == len(rows)
    first = metrics.first_held_back(got, "k", "o").collect()
    assert [(r.k, r.o) for r in first] == [("a", 3)]
    df = spark.createDataFrame([(None,), (61.0,), (0.0,)], "e double").coalesce(1)
    assert values(df, metrics.eta_suffix(F.col("e"))) == [" (ETA: unknown)", " (ETA: 1 min 1 s)", " (ETA: done)"]
    before = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "m string, v double")
    improved = lambda rows, listed=None: metrics.improved(before, spark.createDataFrame(rows, "m string, v double"), "m", "v", listed).first()[0]
    assert improved([("a", 0.5), ("b", 2.0)]) and not improved([("a", 1.0), ("b", 2.0)]) and improved([("c", 9.0)]) and not improved([])
    assert not improved([("a", 0.5), ("b", 2.0)], spark.createDataFrame([("b",)], "m string"))


def test_saves(spark):
    listed = spark.createDataFrame([("/m/e1_a_2.pth", 5), ("/m/e1_b_2.pth", 4), ("/m/e1_a_1.pth", 1), ("/m/e2_z.pth", 9)], "path string, mtime long")
    saves = spark.createDataFrame([(1, "a", "/old/e1_a_1.pth"), (2, "a", "/old/e1_a_2.pth"), (2, "b", "/old/e1_b_2.pth"), (3, "c", None)], "save_id long, network string, path string")
    got = lambda experiment: {r.network: r.path for r in files.latest_save(listed, saves, experiment, "/new/").collect()}
    assert got("e1") == {"a": "/new/e1_a_2.pth", "b": "/new/e1_b_2.pth"} and got(None) == {"": "/new/e2_z.pth"} and got("none") == {}
    assert {r.network: (r.last_path, r.saves) for r in files.last_saved(saves).collect()} == {"a": ("/old/e1_a_2.pth", 2), "b": ("/old/e1_b_2.pth", 1)}


def test_datasets(spark, tmp_path):
    from skyloom.sources import datasets

    catalog.columns.register("twice", overwrite=True)(lambda: F.col("v") * 2)
    catalog.side_inputs.register("grid", overwrite=True)(lambda spark: spark.range(1).select(F.lit(9).alias("grid")))
    catalog.digests.register("demo", overwrite=True)(lambda config: ["input1", "output1"])
    catalog.datasets.register("demo", overwrite=True)(lambda config: datasets.Dataset("demo", config, lambda spark: spark.range(10).select("id", (F.col("id") + 100).alias("v")), "id", "grid"))
    own = datasets.dataset("demo", config.DatasetConfig(tmp_path, keys=("twice",)))
    assert own.digest(spark) == "b5e241cc" and own.active("validation").digest(spark) == "594e9fc9"
    rows = own.samples(spark).orderBy("id").collect()
    assert [(r.id, r.twice, r.grid) for r in rows] == [(i, 2 * i + 200, 9) for i in range(8)]
    assert spark.table(own.active("test").view(spark)).count() == 1
    assert (tmp_path / "b5e241cc").exists()
    with pytest.raises(KeyError):
        datasets.dataset("absent", config.DatasetConfig(tmp_path))


def test_catalogue_documents(spark, tmp_path):
    from skyloom.sources import catalogue

    df = spark.createDataFrame([("a", 1, 2, datetime(2024, 1, 1)), ("a", 5, -1, datetime(2024, 2, 1)), ("b", 9, 9, datetime(2023, 1, 1))], "g string, x int, y int, t timestamp_ntz")
    boxes = catalogue.extent(df, ["g"], "x", "y", "t")
    items = boxes.withColumn("item", catalogue.item(F.col("g"), F.col("bbox"), F.col("first"), F.col("last"), {"n": F.lit(1)}, F.struct(F.struct(F.lit("h").alias("href")).alias("d")), "c"))
    got = {r.g: json.loads(r["item"]) for r in items.collect()}
    assert got["a"]["bbox"] == [1, -1, 5, 2] and got["a"]["geometry"]["coordinates"][0][2] == [5, 2] and got["a"]["properties"]["datetime"] is None and got["a"]["collection"] == "c"
    whole = json.loads(catalogue.collection(items, "c", "all").first()[0])
    assert whole["extent"]["spatial"]["bbox"] == [[1, -1, 9, 9]] and whole["extent"]["temporal"]["interval"] == [["2023-01-01T00:00:00Z", "2024-02-01T00:00:00Z"]]
    catalogue.write_items(items, f"{tmp_path}/items")
    assert spark.read.text(f"{tmp_path}/items").count() == 2


def test_managers(spark, tmp_path):
    manager = config.build(config.ManagerConfig, {"path": str(tmp_path), "experiment": "e1", "networks": {"a": {"type": "UNet"}, "b": {"hidden": 36, "in_channels": 5}}})
    nets = network.networks_of(manager)
    assert {r.network: r.parameters for r in network.parameter_counts(network.layout_table(spark, nets)).collect()} == {"a": 7_700_674, "b": 2_439_578, "total": 7_700_674 + 2_439_578}
    samples.save_weights(spark, str(tmp_path), "e1_7", {"a": {"w": np.ones(3)}, "b": {"w": np.zeros(2)}})
    listed = spark.createDataFrame([("/x/e1_7", 7), ("/x/e1_3", 3)], "path string, mtime long")
    saves = spark.createDataFrame([(1, "a", "/x/e1_3"), (2, "a", "/x/e1_7"), (2, "b", "/x/e1_7")], "save_id long, network string, path string")
    assert {r.network: list(r["values"]) for r in network.restored(spark, manager, listed, saves).collect()} == {"a": [1, 1, 1], "b": [0, 0]}
    with pytest.raises(FileNotFoundError):
        network.restored(spark, manager, listed.limit(0), saves)


def test_downscaling_dataset(spark, tmp_path):
    from skyloom.sources import datasets

    keys = datasets.SAMPLE_KEYS
    spark.range(10).select(F.col("id").alias("sample_id"), *[F.lit(i).alias(k) for i, k in enumerate(keys)]).createOrReplaceTempView("samples")
    own = datasets.dataset("downscaling", config.DatasetConfig(tmp_path, split="validation"))
    assert own.samples(spark).columns == ["sample_id", *keys] and own.samples(spark).count() == 1
