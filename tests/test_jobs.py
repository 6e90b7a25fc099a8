"""Models, incremental sync and streaming jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.operators import flows
from flowlens.operators import models as M
from flowlens.operators import features as X
from flowlens.session import folder_names, scratch_dir
from flowlens.streaming import follow, live, packets, sync


@pytest.fixture(scope="module")
def training(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("C"), F.col("id")).alias("uid"), (F.lit(1.7e9) + F.col("id")).alias("ts"),
        F.lit("10.0.0.1").alias("id_orig_h"), F.lit(5000).alias("id_orig_p"), F.lit("10.0.0.2").alias("id_resp_h"),
        F.when(F.col("id") % 2 == 0, 22).otherwise(80).alias("id_resp_p"), F.lit("tcp").alias("proto"), F.lit("-").alias("service"),
        (F.col("id") % 7).cast("double").alias("duration"), (F.col("id") % 2 * 1000).alias("orig_bytes"), F.lit(5).alias("resp_bytes"),
        F.lit(1).alias("orig_pkts"), F.lit(1).alias("resp_pkts"),
        F.when(F.col("id") % 2 == 0, "BRUTE_FORCE").otherwise("BENIGN").alias("cls"))
    return X.conn_features(rows, "serve")


def test_train_save_load_score(spark, training):
    path = scratch_dir(spark, "model")
    first, loaded = M.load_or_train(spark, path, lambda: M.train_rf(training, S.CONN_FEATURES, "cls", S.CLASS_NAMES, trees=5, depth=4))
    assert not loaded
    bundle, loaded = M.load_or_train(spark, path, lambda: pytest.fail("trained again"))
    assert loaded and bundle.features == S.CONN_FEATURES and bundle.classes == S.CLASS_NAMES
    agreement = M.score_and_compare(training, bundle, "cls").collect()
    assert all(r.n == r.agree for r in agreement)
    alerts = M.score_to_alerts(training, bundle, tags={"dataset_source": "uploaded"})
    assert alerts.count() == 400
    row = alerts.filter("attack_type = 'BRUTE_FORCE'").first()
    assert (row.severity, row.model_label, row.rule_id[:6], row.protocol) == ("Critical", "malicious", "ZEEK-C", "TCP")
    meta = alerts.select(A.meta_field("meta", "model.probabilities.BENIGN").alias("p"), A.meta_field("meta", "zeek_conn.uid").alias("u"),
                         A.meta_field("meta", "features.is_ssh").alias("f"), A.dataset_label("meta").alias("d")).first()
    assert float(meta.p) >= 0 and meta.u.startswith("C") and float(meta.f) in (0.0, 1.0) and meta.d == "uploaded"


def test_rows_without_time_are_left_out(spark, training):
    rows = training.withColumn("ts", F.when(F.col("uid") != "C7", F.col("ts")))
    bundle = M.train_dt(training, S.CONN_FEATURES, "cls", S.CLASS_NAMES, depth=3)
    assert M.score_to_alerts(rows, bundle).count() == 399
    assert M.without_timestamp(rows).count() == 1


def test_scaled_model_scores_unscaled_rows(training):
    scale = X.fit_scale(training, S.CONN_FEATURES)
    bundle = M.fit(training, M.decision_tree(depth=3), S.CONN_FEATURES, "cls", ["BENIGN", "BRUTE_FORCE"], scale)
    scored = M.predict(training, bundle)
    assert scored.filter("cls <> predicted").count() == 0
    assert scored.agg(F.max("orig_bytes")).first()[0] == 1000.0


@pytest.mark.parametrize("mode, leaky", [("none", False), ("full", True)])
def test_training_run(training, mode, leaky):
    rows = training.withColumn("Label", F.when(F.col("cls") == "BENIGN", "BENIGN").otherwise("SSH-Patator"))
    rows = rows.filter("cls = 'BENIGN' or cast(substring(uid, 2, 9) as int) % 4 = 0")
    cfg = M.TrainingConfig(smote_mode=mode, leaky=leaky, task="binary", model="DT", params={"depth": 4})
    bundle, result = M.train_and_evaluate(rows, cfg, S.CONN_FEATURES)
    row = result.first()
    assert row["Accuracy (%)"] == 100.0 and row["AUC (%)"] == 100.0 and row["SMOTE_MODE"] == mode
    names = {"BENIGN": "BENIGN", "BRUTE_FORCE": "ATTACK"}
    wrong = [r for r in M.predict(training, bundle).select("cls", "predicted").collect() if names[r.cls] != r.predicted]
    assert wrong == []


@pytest.mark.parametrize("dataset, labels, task, expected", [
    ("KDD", ["normal.", "smurf.", "unknown."], "multiclass", ["Normal", "DoS"]),
    ("KDD", ["normal.", "smurf.", "unknown."], "binary", ["normal", "attack", "attack"]),
    ("MalMem2022", ["Benign", " malware "], "binary", ["Benign", "Malware"]),
    ("CICIDS2017", ["BENIGN", "DoS Hulk", "weird"], "binary", ["BENIGN", "ATTACK"]),
])
def test_targets(text, dataset, labels, task, expected):
    df, _ = M.target_column(text(labels, "Label"), M.TrainingConfig(dataset=dataset, task=task))
    assert [r.target for r in df.collect()] == expected


def test_importance_ranking(spark, training):
    bundle = M.rank_by_boosting(training, S.CONN_FEATURES, "cls", trees=3, depth=2)
    table = M.importance_table(spark, bundle).orderBy("rank").collect()
    assert len(table) == 14 and [r.rank for r in table] == list(range(1, 15))
    assert X.select_ranked(M.importance_table(spark, bundle), 1)[0] in ("is_ssh", "is_http", "orig_bytes", "bytes_total", "bytes_ratio")


# --- incremental sync ------------------------------------------------------------------


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "ts string, uid string")


def test_delta_rules(spark):
    df = rows_of(spark, [("1", "a"), ("2", "b"), ("2", "c"), ("x", "d"), ("3", "e"), ("nan", "f")])
    state = spark.createDataFrame([(2.0, "b")], sync.STATE_SCHEMA)
    delta, after = sync.incremental_delta(df, state)
    assert sorted(r.uid for r in delta.collect()) == ["c", "e"]
    assert [tuple(r) for r in after.collect()] == [(3.0, "e")]
    first, _ = sync.incremental_delta(df, sync.empty_state(spark))
    assert sorted(r.uid for r in first.collect()) == ["a", "b", "c", "e"]


def test_old_uids_stay_when_the_newest_time_is_the_same(spark):
    state = spark.createDataFrame([(2.0, "b")], sync.STATE_SCHEMA)
    _, after = sync.incremental_delta(rows_of(spark, [("2", "b"), ("2", "c")]), state)
    assert sorted(r.uid for r in after.collect()) == ["b", "c"]


def test_delta_of_a_delta_is_empty(spark):
    df = rows_of(spark, [("1", "a"), ("2", "b"), ("2", "c")])
    _, after = sync.incremental_delta(df, sync.empty_state(spark))
    again, unchanged = sync.incremental_delta(df, after)
    assert again.count() == 0 and unchanged.exceptAll(after).count() == 0


def test_sync_repeats_a_failed_run(spark):
    state, out = scratch_dir(spark, "state"), scratch_dir(spark, "out")
    assert sync.sync_once(rows_of(spark, [("1", "a"), ("2", "b")]), state, out) == 2
    newer = rows_of(spark, [("1", "a"), ("2", "b"), ("3", "c")])
    sync.new_rows(newer, sync.read_state(spark, state)[0]).write.parquet(f"{out}/batch=2")  # output written, checkpoint not
    assert sync.sync_once(newer, state, out) == 1
    assert sync.sync_once(newer, state, out) == 0
    assert sorted(r.uid for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


# --- streams ---------------------------------------------------------------------------


def test_stream_shows_a_new_alert(spark):
    feed, out, checkpoint = (scratch_dir(spark, n) for n in ("feed", "out", "checkpoint"))
    schema = "id string, timestamp timestamp, severity string"

    def add(i):
        spark.createDataFrame([(f"a{i}", dt.datetime(2024, 1, 1, i), "High")], schema).write.mode("append").parquet(feed)

    def run():
        stream = live.stream_alerts(spark, feed, spark.createDataFrame([], schema).schema)
        live.start(stream, live.batch_writer(out), checkpoint).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    add(1)
    assert run() == ["a1"]
    add(2)
    assert run() == ["a1", "a2"]


def test_flow_sink_closes_idle_flows(spark):
    t = dt.datetime(2024, 1, 1)
    feed, out = scratch_dir(spark, "packets"), scratch_dir(spark, "flows")
    steps = [[("a", 0, True, "S", 0), ("b", 1, True, "S", 5)], [("a", 20, False, "PA", 10)], [("c", 1000, True, "S", 1)]]
    seen = []
    for i, step in enumerate(steps):
        rows = [(u, t + dt.timedelta(seconds=s), o, f, n) for u, s, o, f, n in step]
        df = spark.createDataFrame(rows, packets.PACKET_SCHEMA)
        seen.append(df)
        packets.FlowSink(out, idle_seconds=60)(df, i)
    closed = spark.read.parquet(f"{out}/closed")
    assert sorted((r.uid, r.batch, r.duration) for r in closed.collect()) == [("a", 2, 20.0), ("b", 2, 1e-6)]
    every = seen[0].unionByName(seen[1]).unionByName(seen[2])
    got = packets.FlowSink(out, 60).flows(spark, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flows.packets_to_flows(every).collect()))
    assert feed != out


def test_repeated_batch_gives_the_same_page(spark):
    out = scratch_dir(spark, "page")
    rows = [(f"a{i}", dt.datetime(2024, 1, 1, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp")
    sink = live.latest_n(out, 3)
    sink(df.limit(3), 0)
    for _ in range(2):
        sink(df, 1)
    assert live.last_page(spark, out).count() == 3


def test_a_wrong_date_closes_no_flow(spark):
    out = scratch_dir(spark, "early")
    sink = packets.FlowSink(out, idle_seconds=60)
    day = dt.datetime(2024, 5, 1, 10)

    def batch(*rows):
        return spark.createDataFrame([(u, t, True, "A", 10) for u, t in rows], packets.PACKET_SCHEMA)

    sink(batch(("a", day), ("b", day + dt.timedelta(seconds=5))), 0)
    sink(batch(("x", day + dt.timedelta(days=400)), ("a", day + dt.timedelta(seconds=20))), 1)
    # A late packet joins its flow while that is open.
    sink(batch(("a", day + dt.timedelta(seconds=10)), ("b", day + dt.timedelta(seconds=30))), 2)
    sink(batch(("c", day + dt.timedelta(seconds=85)),), 3)
    sink(batch(("c", day + dt.timedelta(seconds=140)),), 4)
    got = {(r.uid, r.total_fwd_pkts) for r in sink.flows(spark, 4).collect()}
    assert got == {("a", 3), ("b", 2), ("x", 1), ("c", 2)}
    closed = spark.read.parquet(f"{out}/closed").select("uid").collect()
    assert {r.uid for r in closed} == {"a", "b"}


def test_a_wrong_dated_flow_is_closed_and_old_state_deleted(spark):
    out = scratch_dir(spark, "wrong")
    sink = packets.FlowSink(out, idle_seconds=60)
    day = dt.datetime(2024, 5, 1, 10)
    for i in range(6):
        rows = [("live", day + dt.timedelta(seconds=40 * i), True, "A", 10)]
        rows += [("x", dt.datetime(2200, 1, 1), True, "A", 1), ("x", day, True, "A", 1)] if i == 1 else []
        sink(spark.createDataFrame(rows, packets.PACKET_SCHEMA), i)
    assert [(r.uid, r.batch) for r in spark.read.parquet(f"{out}/closed").select("uid", "batch").collect()] == [("x", 5)]
    assert sorted(folder_names(spark, f"{out}/open")) == ["batch=4", "batch=5"]
    assert {r.uid for r in sink.flows(spark, 5).collect()} == {"x", "live"}


def test_reused_sums_read_only_new_batches(spark):
    out, reuse = scratch_dir(spark, "live"), scratch_dir(spark, "reuse")
    rows = [(f"a{i}", dt.datetime(2024, 1, 1, i % 5), ["Low", "High"][i % 2], "DOS", "malicious" if i % 3 else "benign", i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, severity string, attack_type string, model_label string, model_score double")
    for f in S.ALERT_SCHEMA:
        df = df if f.name in df.columns else df.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = df.select([F.col(f.name).cast(f.dataType) for f in S.ALERT_SCHEMA])
    write = live.batch_writer(out)

    def counts(every=50):
        return {(r.hour.hour, r.severity): r.n for r in live.refreshed_facts(spark, out, reuse, every).collect()}

    assert counts() == {}
    write(df.limit(6), 0)
    write(df.limit(0), 1)
    first = counts()
    assert sum(first.values()) == 6
    # What was summed is not read again: its files are spoilt, yet the sums come back.
    for name in folder_names(spark, f"{out}/batch=0"):
        if name.endswith(".parquet"):
            open(f"{out}/batch=0/{name}", "wb").write(b"spoilt")
    assert counts() == first
    write(df.filter("id >= 'a6'"), 2)
    assert sum(counts().values()) == 10 and sum(counts(every=1).values()) == 10
    assert len(folder_names(spark, reuse)) == 1 and sum(counts().values()) == 10


def _packets(rows, spark):
    return spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=m), o, f, n) for u, m, o, f, n in rows],
                                 packets.PACKET_SCHEMA)


def test_flow_states_touch_only_their_flows_and_close_by_arrival(spark):
    feed, out, checkpoint = (scratch_dir(spark, n) for n in ("packets", "states", "checkpoint"))
    steps = [[("a", 500, True, "PA", 3), ("b", 0, False, None, None), ("a", 0, True, "S", 0)],
             [("a", 200, False, "A", 9), (None, 1, True, "A", 1)], [("c", 1, True, "A", 1), ("a", 480, True, "A", 4)]]

    def run(idle):
        stream = packets.flow_states(spark.readStream.schema(packets.PACKET_SCHEMA).parquet(feed), idle)
        live.start(stream, live.batch_writer(out), checkpoint, "update", only_data=True).awaitTermination()

    for step in steps:
        _packets(step, spark).write.mode("append").parquet(feed)
        run(3600)
    written = {(r.batch, r.uid) for r in spark.read.parquet(out).collect()}
    assert written == {(0, "a"), (0, "b"), (1, "a"), (2, "a"), (2, "c")}
    whole = _packets([r for s in steps for r in s if r[0]], spark)
    got = packets.last_records(spark, out).drop("opened", "closed")
    assert sorted(map(str, got.collect())) == sorted(map(str, flows.packets_to_flows(whole).collect()))
    assert {r.uid: r.idle_min for r in got.collect()} == {"a": 0.02, "b": 0.0, "c": 0.0}


def test_idle_flows_are_closed_once(spark):
    feed, out, checkpoint = (scratch_dir(spark, n) for n in ("packets", "states", "checkpoint"))
    for i, step in enumerate([[("a", 0, True, "S", 1)], [("b", 5, True, "S", 1)], [("a", 9, True, "S", 1)]]):
        _packets(step, spark).write.mode("append").parquet(feed)
        stream = packets.flow_states(spark.readStream.schema(packets.PACKET_SCHEMA).parquet(feed), 0.001, late_seconds=1.0)
        live.start(stream, live.batch_writer(out), checkpoint, "update", only_data=True).awaitTermination()
        __import__("time").sleep(0.2)
    rows = [(r.uid, r.closed, r.total_fwd_pkts) for r in packets.last_records(spark, out).collect()]
    assert sorted(rows) == [("a", False, 1), ("a", True, 1), ("b", True, 1)]


class _Handle:
    """A state handle that notes what is asked of it."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls.append(at)


def test_a_packet_costs_one_read_and_one_write_of_state_and_timers_follow_the_last_arrival():
    handle, now = _Handle(), [1000]
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: now[0]})()
    job = packets.FlowProcessor(500, None)
    job.init(handle)
    part = {"fn": 1, "bn": 0, "data": 1, "psh": 0, "fsum": 2.0, "bsum": 0.0, "bsq": 0.0, "fmin": 2.0, "bmin": None, "bmax": None}
    first = list(job.handleInputRows(("a",), iter([Row(**part, instants=[7])]), clock))
    now[0] = 1400
    second = list(job.handleInputRows(("a",), iter([Row(**part, instants=[5]), Row(**part, instants=[])]), clock))
    assert handle.calls == ["get", "update", 1500, "get", "update"]
    assert [(r.uid, r.fn, r.fsum, r.bmin, r.first, r.gap, r.opened, r.closed) for r in first + second] == [
        ("a", 1, 2.0, None, 7, None, 1000, False), ("a", 3, 6.0, None, 5, 2e-6, 1000, False)]
    now[0] = 1501
    assert list(job.handleExpiredTimer(("a",), clock, None)) == [] and handle.calls[-1] == 1900
    now[0] = 1900
    assert [(r.fn, r.closed) for r in job.handleExpiredTimer(("a",), clock, None)] == [(3, True)] and handle.value is None


def test_flows_of_a_group_share_reads_and_writes_of_state_and_close_each_in_its_time():
    handle, now = _Handle(), [1000]
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: now[0]})()
    job = packets.FlowGroupProcessor(500, None)
    job.init(handle)

    def hear(*flows):
        sums = "1, 0, 1, 0, 2.0, 0.0, 0.0, 2.0, NaN, NaN"
        rows = [Row(group=3, uid=uid, part=f"[{sums}, [{at}]]") for uid, at in flows]
        return shown(job.handleInputRows((3,), iter(rows), clock))

    def shown(found):
        rows = [r for text in found for r in json.loads(text["records"])]
        return [(r["uid"], r["fn"], r["fsum"], r["bmin"], r["first"], r["gap"], r["opened"], r["closed"]) for r in rows]

    assert hear(("a", 7), ("b", 4), ("a", 5)) == [("a", 2, 4.0, None, 5, 2e-6, 1000, False), ("b", 1, 2.0, None, 4, None, 1000, False)]
    now[0] = 1400
    assert hear(("b", 9), ("c\u00e9\"", 1)) == [("b", 2, 4.0, None, 4, 5e-6, 1000, False), ("c\u00e9\"", 1, 2.0, None, 1, None, 1400, False)]
    assert handle.calls == ["get", "update", 1500, "get", "update"]
    now[0] = 1500
    assert [(r[0], r[-1]) for r in shown(job.handleExpiredTimer((3,), clock, None))] == [("a", True)]
    assert handle.calls[5:] == ["get", 1900, "update"]
    now[0] = 1600
    assert [r[:2] for r in hear(("a", 8))] == [("a", 1)]
    now[0] = 1900
    assert [(r[0], r[-1]) for r in shown(job.handleExpiredTimer((3,), clock, None))] == [("b", True), ("c\u00e9\"", True)]
    now[0] = 2100
    assert [(r[0], r[-1]) for r in shown(job.handleExpiredTimer((3,), clock, None))] == [("a", True)]
    assert handle.value is None and list(job.handleExpiredTimer((3,), clock, None)) == []


def test_training_rows_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    rows = spark.range(60_000, numPartitions=1).select((F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cls"))
    parts, whole = [], M.Pipeline.fit

    def fit(self, data):
        parts.append(data.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
        return whole(self, data)

    monkeypatch.setattr(M.Pipeline, "fit", fit)
    bundle = M.fit(rows, M.decision_tree(depth=2), ["x"], "cls")
    assert sorted(r["count"] for r in parts[0]) == [20_000] * 3
    assert M.predict(rows, bundle).filter("predicted <> cls").count() == 0


def test_a_run_with_other_settings_is_an_error(spark, training):
    path = scratch_dir(spark, "runs")
    bundle = M.train_dt(training, S.CONN_FEATURES, "cls", S.CLASS_NAMES, depth=2)
    bundle.meta["run"] = {"model": "RF"}
    M.save_model(spark, bundle, f"{path}/models/r")
    with pytest.raises(ValueError, match="other settings.*model"):
        M.run_training(training, M.TrainingConfig(model="DT"), path, "r")


# --- growing logs --------------------------------------------------------------------


def _follow(spark, path, checkpoint, out, **how):
    live.start(follow.follow_log(spark, str(path), **how), live.batch_writer(out), checkpoint).awaitTermination()
    return sorted((r.file.rsplit("/", 1)[-1], r.position, r.header, r.value) for r in spark.read.schema(f"{follow.SCHEMA}, batch int").parquet(out).collect())


def test_appended_lines_are_read_once_across_restarts(spark, tmp_path):
    folder, (checkpoint, out) = tmp_path / "logs", (scratch_dir(spark, n) for n in ("checkpoint", "out"))
    folder.mkdir()
    log = folder / "conn.log"
    log.write_bytes(b"#separator x\n#fields\tts\tuid\n1\ta\n2\tb\n3\thal")
    first = _follow(spark, folder, checkpoint, out)
    assert [(r[2], r[3]) for r in first] == [("#fields\tts\tuid", "1\ta"), ("#fields\tts\tuid", "2\tb")]
    with log.open("ab") as f:
        f.write(b"f\n#close\n#fields\tuid\r\n4\r\n")
    (folder / "other.log").write_bytes(b"0\n#fields\tx\n\xff\n")
    rows = _follow(spark, folder, checkpoint, out)
    assert [(r[0], r[2], r[3]) for r in rows] == [("conn.log", "#fields\tts\tuid", "1\ta"), ("conn.log", "#fields\tts\tuid", "2\tb"),
                                                 ("conn.log", "#fields\tts\tuid", "3\thalf"), ("conn.log", "#fields\tuid", "4"),
                                                 ("other.log", "", "0"), ("other.log", "#fields\tx", "\ufffd")]
    assert _follow(spark, folder, checkpoint, out) == rows  # nothing new, nothing twice
    log.write_bytes(b"#fields\tz\nnew\n")  # shorter: begun anew
    assert set(_follow(spark, folder, checkpoint, out)) - set(rows) == {("conn.log", 10, "#fields\tz", "new")}
    parsed = follow.followed_columns(spark.read.parquet(out), ["ts", "uid"])
    assert sorted(map(str, parsed.select("ts", "uid").collect())) == sorted(map(str, spark.createDataFrame(
        [("1", "a"), ("2", "b"), ("3", "half"), (None, "4"), (None, None), (None, None)], "ts string, uid string").collect()))


def test_pieces_of_a_large_addition_and_skipping(spark, tmp_path):
    log, (checkpoint, out) = tmp_path / "big.log", (scratch_dir(spark, n) for n in ("checkpoint", "out"))
    lines = [f"{i}\t{'x' * (i % 37)}" for i in range(400)]
    log.write_text("old\n" * 5)
    assert _follow(spark, log, checkpoint, out, skip_existing=True) == []
    with log.open("a") as f:
        f.write("".join(("#fields\ta\tb\n" if i == 100 else "#fields\tc\td\n" if i == 300 else "") + x + "\n" for i, x in enumerate(lines)))
    got = _follow(spark, log, checkpoint, out, skip_existing=True, piece_bytes=64)
    assert [r[3] for r in got] == lines
    assert [r[2] for r in got] == [""] * 100 + ["#fields\ta\tb"] * 200 + ["#fields\tc\td"] * 100


def test_only_files_after_an_instant_are_scored(spark, training, tmp_path):
    bundle = M.train_dt(training, S.CONN_FEATURES, "cls", S.CLASS_NAMES, depth=3)
    columns = ["ts", "uid", "duration", "resp_bytes"]
    for name, age in (("old", 3600), ("new", 0)):
        file = tmp_path / f"{name}.log"
        file.write_text(f"1.5\t{name}\t2.5\t-\n")
        stamp = dt.datetime.now().timestamp() - age
        __import__("os").utime(file, (stamp, stamp))
    since = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(minutes=5)
    out = scratch_dir(spark, "since")
    stream = live.score_stream(spark, str(tmp_path), columns, bundle, since=since)
    live.start(stream, live.batch_writer(out), scratch_dir(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [r.rule_id for r in rows] == ["ZEEK-new"]
    # The raw row is kept as it was read.
    raw = spark.read.parquet(out).select(A.meta_field("meta", "zeek_conn.resp_bytes").alias("b"), A.meta_field("meta", "zeek_conn.duration").alias("d")).first()
    assert (raw.b, raw.d) == ("-", "2.5")


def test_class_weights_reach_the_fit(spark):
    from flowlens.operators.sampling import class_weights

    # One of twenty rows is an attack, and nothing tells the classes apart but a shared value.
    rows = spark.range(400).select((F.col("id") % 20 < 10).cast("double").alias("x"), F.when(F.col("id") % 20 == 0, "BOT").otherwise("BENIGN").alias("cls"))
    weighted = rows.join(class_weights(rows, "cls").drop("n"), "cls")
    plain = M.train_rf(rows, ["x"], "cls", trees=3, depth=2)
    heavy = M.train_rf(weighted, ["x"], "cls", trees=3, depth=2, weight="weight")
    one = spark.createDataFrame([(1.0,)], "x double")
    assert M.predict(one, plain).first().predicted == "BENIGN" and M.predict(one, heavy).first().predicted == "BOT"
