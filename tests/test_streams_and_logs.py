"""Keyed work, control, logs, routing: plain vectors, and streams against the batch fold."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesseral.functions import hashing
from tesseral.operators import control, keyed, replog, routing
from tesseral.plans import inputs
from tesseral.streaming import keyed as streams


def test_hashes(spark):
    rows = {r["t"]: r for r in spark.createDataFrame([("foobar",), ("a",), ("",), ("åß",)], "t string").select("t", hashing.fnv1a(F.col("t")).alias("f"), hashing.murmur2(F.col("t")).alias("m")).collect()}
    assert rows["foobar"]["f"] == 0xBF9CF968 and rows["a"]["f"] == 0xE40C292C and rows[""]["f"] == 2166136261
    assert rows[""]["m"] == 0 and all(rows[t]["m"] == hashing.murmur2_value(t.encode()) for t in rows)
    assert len({hashing.murmur2_value(bytes(n)) for n in range(1, 9)}) == 8
    with pytest.raises(ValueError):
        hashing.partition_of(F.lit(1), 0)


def test_partitions_keep_order(spark):
    items = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 13).cast("string").alias("key"))
    items = keyed.assign(items, "key", 4)
    out = keyed.process(items, 4, ["event_id"], lambda b: b.assign(seen=range(len(b)))[["part", "event_id", "seen"]], "part int, event_id long, seen long").collect()
    assert len(out) == 200
    for p in {r["part"] for r in out}:
        ids = [r["event_id"] for r in out if r["part"] == p]
        assert ids == sorted(ids)


def test_stop_and_timeout(spark):
    items = spark.createDataFrame([(i, 0, 2000 if i == 1 else 100, i == 2) for i in range(6)], "event_id long, part int, duration_ms long, fails boolean")
    s = keyed.schedule(items, ["event_id"], timeout_ms=500)
    assert [r["outcome"] for r in s.orderBy("event_id").collect()] == ["done", "timeout", "error", "done", "done", "done"]
    assert s.agg(F.max("end_ms")).first()[0] == 1000
    assert keyed.stop(s, 0, drain=True).where("processed").count() == 6 and keyed.stop(s, 0, drain=False).where("processed").count() == 0


def test_pid_vectors():
    assert control.PID(control.Gains(2, 0, 0)).step(10, 1) == 20
    p = control.PID(control.Gains(10, 0, 0, out_min=-50, out_max=50))
    assert (p.step(100, 1), p.step(-100, 1)) == (50, -50)
    p = control.PID(control.Gains(0, 1, 0, i_min=-10, i_max=10))
    for _ in range(20):
        p.step(100, 1)
    assert p.integral == 10
    p.reset()
    assert p.integral == p.last_error == 0


def test_duty(spark):
    rows = spark.createDataFrame([(-50.0,), (0.0,), (25.0,), (100.0,), (150.0,), (3.0,)], "p double").select("p", control.duty_phases(F.col("p"), 10.0, 0.5).alias("d")).collect()
    got = {r["p"]: [(x["state"], x["seconds"]) for x in r["d"]] for r in rows}
    assert got[-50.0] == got[0.0] == [("off", 10.0)] and got[25.0] == [("on", 2.5), ("off", 7.5)] and got[100.0] == got[150.0] == [("on", 10.0)] and got[3.0] == [("off", 9.7)]


def test_sensor_words(spark):
    hot, cold = (-4 & 0x3FFF) << 18, (-16 & 0xFFF) << 4
    row = spark.range(1).select(control.hot_junction(F.lit(hot)).cast("double"), control.cold_junction(F.lit(cold)).cast("double"), control.hot_junction(F.lit(hot), True).cast("double"), control.fault(F.lit(1 << 16 | 4)), control.fault(F.lit(1 << 16)), control.fault(F.lit(4))).first()
    assert tuple(row) == (-1.0, -1.0, 4095.0, "Short to VCC", "No Connection", None)


def test_kettle_warms_and_cools(spark):
    def slow(heating, ticks, t):
        n = 0
        for _ in range(ticks):
            n = min(n + 1, 60) if heating else max(n - 1, -6)
            if t < 100 if heating else t > 0:
                t += 0.1 * (0.06 if heating else -0.03) + 0.0005 * n
        return t

    cases = [(True, 60), (False, 60), (True, 5000), (False, 5000), (True, 1)]
    rows = spark.createDataFrame(cases, "p boolean, n int").select("p", "n", control.kettle(F.col("p"), F.col("n"), 20.0).alias("t")).collect()
    assert all(abs(r["t"] - slow(r["p"], r["n"], 20.0)) < 1e-9 for r in rows)


def test_pid_update_keeps_state():
    p = control.PID()
    p.step(10, 1)
    p.update(kp=1.0, ki=None)
    assert (p.gains.kp, p.gains.ki, p.integral) == (1.0, 0.007, 10)


def test_log_rules(spark):
    log = spark.createDataFrame([(1, '{"Operation":"set","Name":"a","Value":"1"}'), (2, "{broken"), (3, '{"Operation":"DELETE","Name":"a"}'), (4, '{"Operation":"SET","Name":"b","Value":"2"}'), (5, '{"Operation":"NOP","Name":"b"}')], "index long, command string")
    parsed = replog.parse_commands(log)
    assert [tuple(r) for r in replog.state(parsed).collect()] == [("b", "2", 4)]
    assert [tuple(r) for r in replog.state(parsed, upto=2).collect()] == [("a", "1", 1)]
    with pytest.raises(ValueError):
        replog.read_setting(parsed, " ", 5)
    one = spark.createDataFrame([("s", "s", 3)], "leader string, server string, match_index long")
    entries = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 2)], "leader string, index long, term int")
    assert replog.commit_index(entries, one, 2).first()["commit_index"] == 3
    probes = spark.createDataFrame([("f", 0, 0), ("f", 2, 1), ("f", 2, 2), ("f", 9, 1)], "server string, prev_index long, prev_term int")
    follower = spark.createDataFrame([("f", 1, 1), ("f", 2, 2)], "server string, index long, term int")
    assert {(r["prev_index"], r["prev_term"]): r["ok"] for r in replog.consistent(follower, probes).collect()} == {(0, 0): True, (2, 1): False, (2, 2): True, (9, 1): False}
    assert [r["index"] for r in replog.to_apply(log, 1, 3).orderBy("index").collect()] == [2, 3]
    two = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "term int, candidate string")
    assert [r["term"] for r in replog.two_leaders(two).collect()] == [1]
    led = spark.createDataFrame([("x", 3, 1, 1), ("y", 4, 2, 2)], "leader string, leader_term int, index long, term int")
    gaps = replog.incomplete_leaders(spark.createDataFrame([(1, 1)], "index long, term int"), led).collect()
    assert [r["leader"] for r in gaps] == ["y"]


def test_endpoint():
    assert routing.check_endpoint("UDP") == ("udp", "0.0.0.0")
    with pytest.raises(ValueError):
        routing.check_endpoint("tcp")


def _files(spark, df, path):
    """The rows as several files, each a micro-batch, in time order."""
    for k in range(3):
        df.where(F.col("event_id") % 1000 * 3 / 1000 >= k).where(F.col("event_id") % 1000 * 3 / 1000 < k + 1).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, streams.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def test_pid_stream_equals_batch(rocks, sf, tmp_path):
    spark = rocks
    base = inputs.series(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    # the files follow event time
    ordered = base.withColumn("event_id", F.row_number().over(Window.orderBy("us", "event_id")).cast("long") - 1)
    stream = _files(spark, ordered.select("user_id", "event_id", "us", "value"), str(tmp_path / "in"))
    streams.drain(streams.pid_stream(stream, 65.0, control.Gains()), "pid_out", str(tmp_path / "ck"))
    series = ordered.withColumn("dt", control.seconds_between("ts", Window.partitionBy("user_id").orderBy("us", "event_id")))
    batch = control.pid_clamped(series, "user_id", ["us", "event_id"], "error", "dt", control.Gains())
    got = {(r["user_id"], r["event_id"]): r["output"] for r in spark.table("pid_out").collect()}
    want = {(r["user_id"], r["event_id"]): r["output"] for r in batch.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_route_stream_equals_batch(rocks, sf, tmp_path):
    spark = rocks
    p = inputs.packets(spark, sf)
    p = p.withColumn("event_id", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long") - 1)
    stream = _files(spark, p.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path / "in"))
    streams.drain(streams.route_stream(stream), "route_out", str(tmp_path / "ck"))
    want = {(r["event_id"], r["client"]) for r in routing.last_client(p, ["ts", "event_id"]).collect()}
    assert {(r["event_id"], r["client"]) for r in spark.table("route_out").collect()} == want


def test_dead_letters(spark):
    items = spark.createDataFrame([(i, f"k{i % 5}", i % 4) for i in range(40)], "id long, key string, v long")
    rows = keyed.process_each(keyed.assign(items, "key", 3), 3, ["id"], lambda x: 12 // x["v"]).collect()
    assert sorted((r["id"], r["result"]) for r in rows) == [(i, None if i % 4 == 0 else str(12 // (i % 4))) for i in range(40)]
    assert all((r["error"] or "").startswith("ZeroDivisionError") == (r["v"] == 0) for r in rows)


def test_keys_of_all_kinds(spark):
    df = spark.createDataFrame([(k, k.encode(), i % 3) for i, k in enumerate(["a", "bb", "", "é"])], "t string, b binary, n int")
    for algorithm in keyed.HASHES:
        same = keyed.assign(keyed.assign(df, "t", 7, algorithm).withColumnRenamed("part", "p"), "b", 7, algorithm)
        assert all(r["p"] == r["part"] for r in same.collect())
    assert [r["part"] for r in keyed.assign(df, "n", 3).collect()] == [0, 1, 2, 0]
    with pytest.raises(Exception, match="partition must be"):
        keyed.assign(df, "n", 2).collect()


def test_clamped_series_skip_failed_readings(spark):
    rows = [(k, i, None if i % 5 == 3 else float((i * 7 + k) % 11 - 5), 0.0 if i % 4 == 0 else 0.5) for k in (1, 2) for i in range(30)]
    g = control.Gains(2.0, 0.5, 0.1, -3.0, 3.0, -4.0, 4.0)
    got = {(r["k"], r["i"]): r["output"] for r in control.pid_clamped(spark.createDataFrame(rows, "k int, i int, e double, dt double"), "k", ["i"], "e", "dt", g).collect()}
    for k in (1, 2):
        total = before = 0.0
        for kk, i, e, dt in rows:
            if kk != k:
                continue
            if e is None:
                assert got[k, i] is None
                continue
            dt = dt or control.LEAST_DT
            total = min(max(total + e * dt, -3.0), 3.0)
            assert got[k, i] == min(max(2.0 * e + 0.5 * total + 0.1 * ((e - before) / dt), -4.0), 4.0)
            before = e
