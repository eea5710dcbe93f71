"""Archives, caches, resumable passes, states and permutations: formats by hand, crashes and races."""

import io
import json
import os
import struct
import threading
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import permutation
from skyloom.operators import passes, series
from skyloom.sources import archives, cache, samples, states
from skyloom.sources import files_api as files


def reader_of(raw):
    """A read function that counts the bytes it gave."""
    taken = []

    def read(at, n):
        taken.append(n)
        return raw[at : at + n]

    return read, taken


def classic(version=1):
    """A classic file by hand: a fixed variable of two axes, and two record variables, one of shorts that needs padding."""
    p = lambda n: struct.pack(">i", n)
    name = lambda s: p(len(s)) + s + b"\0" * (-len(s) % 4)
    begin = (lambda n: struct.pack(">i", n)) if version == 1 else (lambda n: struct.pack(">q", n))

    def head(a, b, c):
        dims = p(10) + p(3) + name(b"time") + p(0) + name(b"x") + p(3) + name(b"site") + p(2)
        attrs = p(12) + p(2) + name(b"units") + p(2) + p(3) + b"m/s\0" + name(b"scale") + p(5) + p(1) + struct.pack(">f", 0.5)
        none = p(0) + p(0)
        one = name(b"grid") + p(2) + p(2) + p(1) + attrs + p(5) + p(24) + begin(a)
        two = name(b"t") + p(1) + p(0) + none + p(3) + p(4) + begin(b)
        three = name(b"wind") + p(2) + p(0) + p(1) + none + p(6) + p(24) + begin(c)
        return b"CDF" + bytes([version]) + p(4) + dims + none + p(11) + p(3) + one + two + three

    at = len(head(0, 0, 0))
    body = np.arange(6, dtype=">f4").tobytes()
    for i in range(4):
        body += struct.pack(">h", i - 1) + b"\0\0" + np.arange(10 * i, 10 * i + 3).astype(">f8").tobytes()
    return head(at, at + 24, at + 28) + body


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf_by_hand(version):
    raw = classic(version)
    read, _ = reader_of(raw)
    arrays = archives.netcdf_arrays(read, len(raw))
    assert arrays["grid"].attributes == {"units": "m/s", "scale": 0.5}
    assert arrays["grid"].rows(read, 0, 2).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert arrays["t"].rows(read, 1, 4).tolist() == [0, 1, 2]
    assert arrays["wind"].shape == (4, 3) and arrays["wind"].rows(read, 2, 4).tolist() == [[20, 21, 22], [30, 31, 32]]
    for end in (3, 40, len(raw) // 2):
        with pytest.raises(ValueError):
            archives.netcdf_arrays(reader_of(raw[:end])[0], end)
            archives.netcdf_arrays(read, len(raw))["x"]


def test_a_slice_reads_its_bytes():
    """One sample of a large file costs the header and the sample."""
    grid = np.arange(4000 * 64, dtype=np.float32).reshape(4000, 8, 8)
    for raw, parse in ((archives.netcdf_bytes({"grid": grid, "id": np.arange(4000)}), archives.netcdf_arrays), (archives.numpy_bytes({"grid": grid, "id": np.arange(4000)}), archives.numpy_arrays)):
        read, taken = reader_of(raw)
        arrays = parse(read, len(raw))
        planned = sum(taken)
        assert (arrays["grid"].rows(read, 1234, 1236) == grid[1234:1236]).all() and (arrays["id"].rows(read, 7, 9) == [7, 8]).all()
        assert sum(taken) - planned == 2 * 64 * 4 + 16 and planned < 90_000 < len(raw) // 10


def test_numpy_layouts():
    held = {"c": np.arange(24).reshape(4, 3, 2), "f": np.asfortranarray(np.arange(24.0).reshape(4, 6)), "one": np.arange(4, dtype=np.int8), "big": np.arange(4, dtype=">i2"), "none": np.zeros((4, 0)), "scalar": np.array(3)}
    for save in (np.savez, np.savez_compressed):
        out = io.BytesIO()
        save(out, **held)
        read, _ = reader_of(out.getvalue())
        arrays = archives.numpy_arrays(read, len(out.getvalue()))
        assert "scalar" not in arrays
        for k, a in arrays.items():
            assert (a.rows(read, 1, 3) == held[k][1:3]).all() and a.shape == held[k].shape
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.npy", b"not an array")
    with pytest.raises(ValueError):
        archives.numpy_arrays(reader_of(out.getvalue())[0], len(out.getvalue()))


def sample_rows(spark, n=50):
    return spark.range(n).select(F.format_string("train_ab_%08d.nc", F.floor(F.col("id") / 8)).alias("file"), (F.col("id") % 8).alias("pos"), "id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("id") * 10 + i).cast("float")).alias("grid"))


@pytest.mark.parametrize("target", [1 << 25, 100])
def test_archives_round_trip(spark, tmp_path, target):
    path = str(tmp_path / "a")
    archives.write_archives(sample_rows(spark), path, {"grid": [2, 3]})
    df = archives.read_archives(spark, path, target=target)
    assert sorted((r.batch_id, r.pos, r.id, tuple(r.grid)) for r in df.collect()) == [(i // 8, i % 8, i, tuple(float(10 * i + k) for k in range(6))) for i in range(50)]
    some = archives.read_archives(spark, path, ["grid"], target=target, split="train", batch_id=[2, 6], first=1, end=4)
    assert some.columns[-1] == "grid" and sorted((r.batch_id, r.pos) for r in some.collect()) == [(2, 1), (2, 2), (2, 3), (6, 1)]
    assert archives.read_archives(spark, path, split="test").count() == 0
    listed = {r.file: r.bytes for r in archives.manifest(spark, path).collect()}
    assert listed == dict(archives.listing(path)) and len(listed) == 7
    # other names have no place, and files of other runs stay
    archives.write_archives(sample_rows(spark, 3).withColumn("file", F.lit("deep/er/x.npz")), path)
    assert sorted(archives.listing(path))[0][0] == "deep/er/x.npz" and len(archives.listing(path)) == 8
    assert {r.split for r in archives.read_archives(spark, path, ["id"], file="deep/er/x.npz").collect()} == {None}


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    archives.write_archives(sample_rows(spark, 16), path)
    before = archives.listing(path)
    broken = sample_rows(spark, 400).withColumn("grid", F.when(F.col("id") == 399, F.array(F.raise_error(F.lit("broken")).cast("float"))).otherwise(F.col("grid")))
    for bad in (broken, sample_rows(spark).withColumn("file", F.lit("../out.nc")), sample_rows(spark).withColumn("grid", F.when(F.col("id") != 30, F.col("grid")))):
        with pytest.raises(Exception):
            archives.write_archives(bad, path)
    assert archives.listing(path) == before == sorted((r.file, r.bytes) for r in archives.manifest(spark, path).collect())
    assert not [n for n in os.listdir(path) if n.startswith("_staging")] and not os.path.exists(tmp_path / "out.nc")


def test_attempts_that_were_not_committed_do_not_count(tmp_path):
    """Two attempts of a task stage the same file; only the one whose message reaches the commit is moved."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("file", StringType()), StructField("pos", LongType()), StructField("v", ArrayType(LongType()))])
    writer = archives.ArchiveWriter({"path": str(tmp_path)}, schema)
    batch = lambda v: pa.RecordBatch.from_pydict({"file": ["a.nc"], "pos": [0], "v": [[v]]})
    writer.write(iter([batch(1)]))
    writer.commit([writer.write(iter([batch(2)])), None])
    read, arrays = archives.opened(*[archives.store(str(tmp_path))[0], str(tmp_path / "a.nc")])
    assert arrays["v"].rows(read, 0, 1).tolist() == [[2]] and archives.listing(str(tmp_path))[0][0] == "a.nc" and len(archives.listing(str(tmp_path))) == 1
    assert sorted(os.listdir(tmp_path)) == ["_manifests", "a.nc"]


def test_cache_after_a_crash(spark, tmp_path):
    folder = str(tmp_path)
    # a crashed write left a data folder without marker, half a file and a lease that nobody renews
    os.makedirs(tmp_path / "d1" / "data-dead")
    (tmp_path / "d1" / "data-dead" / "part-0.parquet").write_bytes(b"PAR1")
    (tmp_path / "d1" / "_lease").write_text("dead")
    os.utime(tmp_path / "d1" / "_lease", (time.time() - 500, time.time() - 500))
    got = samples.read_through(spark, folder, "d1", lambda: spark.range(5))
    assert got.count() == 5 and cache.sweep(spark, f"{folder}/d1") == 1
    assert samples.read_through(spark, folder, "d1", lambda: 1 / 0).count() == 5
    with pytest.raises(FileNotFoundError):
        samples.read_through(spark, folder, "d2", lambda: spark.range(5), only_saved=True)
    # a computation that fails frees the lease
    with pytest.raises(ZeroDivisionError):
        samples.read_through(spark, folder, "d3", lambda: 1 / 0)
    assert samples.read_through(spark, folder, "d3", lambda: spark.range(2)).count() == 2
    assert samples.read_through(spark, folder, "d3", lambda: 1 / 0, skip_load=True).columns == ["id"]


def test_cache_of_two_writers(spark, tmp_path):
    made, got = [], []

    def compute():
        made.append(1)
        time.sleep(1)
        return spark.range(7)

    threads = [threading.Thread(target=lambda: got.append(samples.read_through(spark, str(tmp_path), "d", compute).count())) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert got == [7] * 4 and len(made) == 1 and not files.exists(spark, f"{tmp_path}/d/_lease")
    # a lease that is renewed isn't taken over, however long the work takes
    slow = threading.Thread(target=lambda: cache.kept(spark, f"{tmp_path}/e", lambda: (time.sleep(3), compute())[1], lease=1.0))
    slow.start()
    time.sleep(0.5)
    assert cache.kept(spark, f"{tmp_path}/e", lambda: 1 / 0, lease=1.0).count() == 7
    slow.join(120)


def test_pass_killed_and_poisoned(spark, tmp_path):
    items = spark.range(300).withColumnRenamed("id", "k")
    whole = passes.Pass(spark, str(tmp_path / "whole"), items, "k", lambda d: d.withColumn("v", F.col("k") * 2))
    assert whole.run().complete
    want = sorted(tuple(r) for r in whole.results().collect())
    assert want == [(k, 2 * k) for k in range(300)]

    class Killed(BaseException):
        pass

    seen = []

    def dies(d):
        seen.append(1)
        if len(seen) == 4:
            # what it had written stays without a line in the ledger
            d.limit(1).withColumn("v", F.lit(-1).cast("long")).write.mode("overwrite").parquet(str(tmp_path / "cut" / "results" / "c0011"))
            raise Killed
        return d.withColumn("v", F.col("k") * 2)

    cut = passes.Pass(spark, str(tmp_path / "cut"), items, "k", dies)
    with pytest.raises(Killed):
        cut.run()
    assert cut.progress().done == 3 and not cut.progress().complete
    again = passes.Pass(spark, str(tmp_path / "cut"), items, "k", dies)
    assert again.run(2).done == 5 and again.run().complete and len(seen) == 17
    assert sorted(tuple(r) for r in again.results().collect()) == want

    def poisoned(d):
        return d.withColumn("v", F.when(F.col("k") == 77, F.raise_error(F.lit("bad item")).cast("long")).otherwise(F.col("k") * 2))

    run = passes.Pass(spark, str(tmp_path / "bad"), items, "k", poisoned, chunks=2)
    told = run.run()
    assert told.complete and told.aside == 1 and told.failures >= 2
    assert [(r.k, "bad item" in r.error) for r in run.set_aside().collect()] == [(77, True)]
    assert sorted(tuple(r) for r in run.results().collect()) == [w for w in want if w[0] != 77]
    lines = len(run.ledger())
    assert run.run() == told and len(run.ledger()) == lines
    assert passes.Pass(spark, str(tmp_path / "none"), items.limit(0), "k", poisoned, chunks=1).run().complete


@pytest.mark.parametrize("options", [(6, 0, 0), (9, 2, 3), (4, 1, 0)])
def test_states_by_any_cuts(spark, tmp_path, options):
    rows = [(s, float(t), float((t * 7) % 11)) for s, n in (("a", 57), ("b", 3), ("c", 30)) for t in range(n)]
    df = spark.createDataFrame(rows, "s string, t double, v double")
    want = sorted(tuple(r) for r in series.compact(df, "s", ["t"], "t", "v", *options).collect())
    for k, cuts in enumerate(([10, 11, 40], [1], [0, 25])):
        folder = str(tmp_path / f"{k}")
        for lo, hi in zip([-1, *cuts], [*cuts, 10**6], strict=True):
            states.append(df.where((F.col("t") > lo) & (F.col("t") <= hi)), folder, "s", ["t"], "t", "v", *options)
        got = sorted(tuple(r) for r in series.buckets(states.load(spark, folder), "s").collect())
        assert [g[:6] for g in got] == [w[:6] for w in want] and np.allclose([g[6] for g in got], [w[6] for w in want])
        assert states.last_version(spark, folder)["version"] == len(cuts) + 1
    with pytest.raises(Exception, match="out of order"):
        states.append(df.where("s = 'b' and t = 2"), folder, "s", ["t"], "t", "v", *options)
    assert states.last_version(spark, folder)["version"] == 3  # the refused run committed nothing
    with pytest.raises(ValueError, match="made with"):
        states.append(df, folder, "s", ["t"], "t", "v", 50)


def test_states_of_older_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", float(t), float(t)) for t in range(40)], "s string, t double, v double")
    folder = str(tmp_path / "old")
    states.append(df.where("t < 20"), folder, "s", ["t"], "t", "v", 6)
    mark = states.last_version(spark, folder)
    old = spark.read.parquet(f"{folder}/{mark['data']}").withColumnsRenamed({"series": "name", "first": "start", "last": "stop"}).withColumn("mean", F.col("total") / F.col("cnt")).drop("total")
    old.write.parquet(f"{folder}/data/older")
    (tmp_path / "old" / "versions" / "00000001.json").write_text(json.dumps(mark | {"format": "1.0", "data": "data/older"}))
    states.append(df.where("t >= 20"), folder, "s", ["t"], "t", "v", 6)
    got = sorted(tuple(r) for r in series.buckets(states.load(spark, folder), "s").collect())
    assert np.allclose([g[6] for g in got], [r.value for r in series.compact(df, "s", ["t"], "t", "v", 6).orderBy("bucket").collect()])
    (tmp_path / "old" / "versions" / "00000009.json").write_text(json.dumps(mark | {"format": "0.1"}))
    with pytest.raises(ValueError, match="can't be read"):
        states.load(spark, folder)


def test_permutations(spark):
    ns = [1, 2, 3, 4, 5, 7, 10, 17, 26, 37, 100, 101, 1000]
    df = spark.createDataFrame([(n,) for n in ns], "n long").withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    got = df.withColumn("p", permutation.permuted(F.col("item"), F.col("n"), 7, 1)).withColumn("i", permutation.item_at(F.col("p"), F.col("n"), 7, 1)).collect()
    assert all(r.i == r.item for r in got)
    for n in ns:
        assert sorted(r.p for r in got if r.n == n) == list(range(n))
    # epochs differ, neighbours part, and no plan sorts or shuffles
    x = spark.range(5000).select("id", permutation.permuted(F.col("id"), 5000, 7, 1).alias("a"), permutation.permuted(F.col("id"), 5000, 7, 2).alias("b"))
    a, b = (np.array(c) for c in zip(*[(r.a, r.b) for r in x.orderBy("id").collect()], strict=True))
    for u, v in ((a[1:], a[:-1]), (a, b), (a, np.arange(5000))):
        assert abs(np.corrcoef(u, v)[0, 1]) < 0.05
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


def test_ranks_read_their_input_once(spark, tmp_path):
    """Sampling and one shuffle read the input; the plan behind reads the dealt rows, and not more than twice."""
    path = str(tmp_path / "in")
    spark.range(1000).selectExpr("id % 7 as k", "id as o").write.parquet(path)
    from skyloom.operators import splits

    for df in (splits.global_rank(spark.read.parquet(path), ["o"]), splits.rank_within(spark.read.parquet(path), ["k"], ["o"]), splits.split_by_rank(spark.read.parquet(path), ["o"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert path not in plan and plan.count("FileScan") <= 2


def test_purge(spark, tmp_path):
    """Protected and changed files stay, a file that can't be deleted is told, a rerun changes nothing, a run that died is finished."""
    from skyloom.operators import files as plans
    from skyloom.operators import purge

    for i in range(12):
        (tmp_path / f"f{i:02d}.pth").write_text("x")
        os.utime(tmp_path / f"f{i:02d}.pth", (1_700_000_000 + i, 1_700_000_000 + i))
    listed = samples.file_listing(spark, str(tmp_path), "*.pth")
    plan = plans.retention_plan(listed, "path", "mtime", F.current_timestamp(), keep=4).cache()
    assert plan.count() == 8
    guarded = plan.where(F.col("path").endswith("f03.pth"))
    os.utime(tmp_path / "f05.pth", (1_800_000_000, 1_800_000_000))  # written again since it was listed
    os.remove(tmp_path / "f06.pth")
    told, folder = purge.purge(plan, protected=guarded, within=(str(tmp_path), "*.pth"))
    outcome = {r.path[-7:-4]: r.outcome for r in told.collect()}
    assert outcome == {"f00": "deleted", "f01": "deleted", "f02": "deleted", "f04": "deleted", "f05": "changed", "f06": "gone", "f07": "deleted"}
    left = sorted(n for n in os.listdir(tmp_path) if n.endswith(".pth"))
    assert left == [f"f{i:02d}.pth" for i in (3, 5, 8, 9, 10, 11)]
    assert {r.path[-7:-4]: r.outcome for r in purge.finish(spark, folder).collect()} == outcome
    assert sorted(n for n in os.listdir(tmp_path) if n.endswith(".pth")) == left
    os.makedirs(tmp_path / "d.pth")
    bad = spark.createDataFrame([(str(tmp_path / "d.pth"), None), (str(tmp_path / "none" / "x.pth"), None)], "path string, mtime timestamp")
    assert sorted(r.outcome for r in purge.purge(bad)[0].collect()) == ["gone", "no file"]
    with pytest.raises(Exception, match="not in the folder"):
        purge.purge(spark.createDataFrame([("/etc/hostname", None)], "path string, mtime timestamp"), within=(str(tmp_path), "*.pth"))
    with pytest.raises(ValueError):
        purge.purge(bad, within=("relative", "*"))
    assert os.path.exists("/etc/hostname")
