import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators import alerts as Q
from flowlens.operators import evaluation as E
from flowlens.operators import features as X
from flowlens.operators import flows, labeling, neighbors, sampling, skew, smote
from flowlens.session import scratch_dir

NOW = dt.datetime(2024, 3, 1, 12, 30)


def alert(i, minutes, severity="High", attack="DOS", score=0.5, label="malicious", ip="10.0.0.1"):
    t = NOW - dt.timedelta(minutes=minutes)
    return (f"a{i:04d}", t, t + dt.timedelta(milliseconds=20), severity, attack, ip, 1, "2.2.2.2", 80, "TCP", f"R-{i}", f"Zeek {attack}",
            score, label, '{"dataset_source":"default"}')


@pytest.fixture(scope="module")
def alerts(spark):
    from flowlens.schemas import ALERT_SCHEMA

    rows = [alert(0, 0, "Critical", "DDOS", 0.9), alert(1, 30, "Low", "BENIGN", 0.1, "benign", "10.0.0.2"), alert(2, 90), alert(3, 119),
            alert(4, 23 * 60 + 40), alert(5, 24 * 60 - 1), alert(6, 24 * 60 + 1), alert(7, 60 * 24 * 10, "Medium", "PORTSCAN")]
    return spark.createDataFrame(rows, ALERT_SCHEMA)


def test_series_has_24_buckets_and_drops_the_partial_hour(alerts):
    series = {r.bucket: r["count"] for r in Q.hourly_series(alerts, NOW).collect()}
    assert len(series) == 24
    # Alerts 4 and 5 are within 24 hours, but before the first whole bucket.
    assert sum(series.values()) == 4
    overview = {(r.section, r.key): r.value for r in Q.metrics_overview(alerts, NOW).collect()}
    assert sum(v for (s, _), v in overview.items() if s == "severity_24h") == 6
    assert sum(v for (s, _), v in overview.items() if s == "series") == 4
    assert overview[("severity_24h", "Medium")] == 0 and overview[("severity_total", "Medium")] == 1


def test_empty_table_gives_zeros(alerts):
    none = alerts.filter("false")
    assert Q.avg_score(none).first()[0] == 0.0
    assert tuple(Q.malicious_ratio(none).first()) == (0, 0, 0.0)
    assert tuple(Q.severity_counts(none).first()) == (0, 0, 0, 0)
    assert {r.value for r in Q.metrics_overview(none, NOW).collect()} == {0}
    report = {(r.section, r.key): r.value for r in Q.reports_summary(none).collect()}
    assert report[("total", "alerts")] == 0.0 and report[("total", "malicious_ratio")] == 0.0
    total = [r for r in Q.model_performance(none, NOW).collect() if r.section == "total"]
    assert len(total) == 1 and total[0]["count"] == 0


def test_filters_and_paging(alerts):
    f = Q.AlertFilters(severity=["High"], page_size=2, page=2)
    items, total = Q.page_alerts(alerts, f)
    assert [r.id for r in items.collect()] == ["a0004", "a0005"] and total.first().total == 5
    assert Q.search(alerts, "ddos").count() == 1
    assert Q.search(alerts, "10.0.0._").count() == 0 and Q.search(alerts, "10.0.0._", like=True).count() == 8
    assert Q.sort_alerts(alerts, "nonsense").first().id == "a0000"
    assert Q.sort_alerts(alerts, "severity").first().severity == "Low"
    assert [r.id for r in Q.status_causes(alerts, NOW).collect()] == ["a0000", "a0002", "a0003"]
    with pytest.raises(ValueError):
        Q.AlertFilters(page_size=501)
    with pytest.raises(ValueError):
        Q.AlertFilters(severity=["Severe"])


def test_window_hours_are_held_in_range(alerts):
    def total(hours):
        return next(r["count"] for r in Q.model_performance(alerts, NOW, hours).collect() if r.section == "total")

    assert (total(0), total(10_000)) == (2, 7)


def test_health(alerts):
    assert Q.health_state(Q.severity_counts(alerts)).first().state == "critical"
    assert Q.health_state(Q.severity_counts(alerts.filter("severity = 'Low'"))).first().state == "safe"


def test_acceptance_thousand_alerts(spark, alerts):
    many = spark.range(1000).select(F.lit(1).alias("one")).join(F.broadcast(alerts.limit(1).withColumn("one", F.lit(1))), "one").drop("one")
    assert Q.page_alerts(many, Q.AlertFilters())[1].first().total == 1000


# --- hot groups --------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds nearly all rows; one is NULL."""
    group = F.when(F.col("id") % 50 == 0, F.lit("small")).when(F.col("id") % 51 == 0, F.lit(None)).otherwise(F.lit("hot"))
    return spark.range(5000).select(F.col("id").alias("uid"), group.alias("g"))


def test_exact_rank_equals_window(skewed):
    order = skew.sample_key(7, "uid")
    got = skew.exact_rank(skewed, ["g"], order, ["uid"], digits=1)
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(order, "uid")).cast("bigint"))
    assert got.select("uid", "g", "rank").exceptAll(want).count() == 0 and got.count() == 5000


@pytest.mark.parametrize("n", [0, 1, 37, 99, 100, 4999, 10_000])
def test_take_first_equals_window(skewed, n):
    order = skew.sample_key(7, "uid")
    got = skew.take_first(skewed, ["g"], F.lit(n), order, ["uid"], digits=1)
    want = skewed.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(order, "uid"))).filter(F.col("r") <= n).drop("r")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_equal_window(spark, descending):
    rows = [(g, float(x), random.Random(x).randint(0, 9)) for g in "ab" for x in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, v bigint")
    got = skew.prefix_sums(df, ["g"], "x", {"v": "before"}, descending, slices=7)
    order = F.col("x").desc() if descending else F.col("x").asc()
    w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.select("g", "x", "before").exceptAll(want.select("g", "x", "before")).count() == 0


def test_spread_join_equals_join(spark, skewed):
    labels = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("small", "z")], "g string, l string")
    got = skew.spread_join(skewed, labels, ["g"], ["uid"], hot_rows=100, salts=8)
    want = skewed.join(labels, "g")
    assert got.select("uid", "g", "l").exceptAll(want.select("uid", "g", "l")).count() == 0 and got.count() == want.count()


def test_fan_out_as_weight_or_rows(spark):
    conn = spark.createDataFrame([("C1", "f1"), ("C2", "f1"), ("C3", "f2"), ("C4", "f9")], "uid string, flow_id string")
    cic = spark.createDataFrame([(" f1", "A"), ("f1", "A"), ("f1", "B"), ("f2", "A"), ("f3", "A")], "flow_id string, Label string")
    weighted = labeling.label_by_flow(conn, cic, hot_rows=2)
    assert sorted((r.uid, r.Label, r.n_matches) for r in weighted.collect()) == [
        ("C1", "A", 2), ("C1", "B", 1), ("C2", "A", 2), ("C2", "B", 1), ("C3", "A", 1)]
    assert labeling.label_by_flow(conn, cic, expand=True).count() == 7


def test_split_sizes_per_class(skewed):
    train, test = sampling.stratified_split(skewed, "g", 0.3)
    total = {r.g: r["count"] for r in skewed.groupBy("g").count().collect()}
    parts = {r.g: r["count"] for r in test.groupBy("g").count().collect()}
    assert parts == {g: int(n * 0.3 + 0.5) for g, n in total.items()}
    assert train.count() + test.count() == 5000 and train.join(test, "uid").count() == 0
    assert sampling.stratified_split(skewed, None, 0.2)[1].count() == 1000


# --- balancing ---------------------------------------------------------------------


@pytest.mark.parametrize("mode, expected", [
    ("full", {"a": 20000, "b": 20000, "c": 20000, "d": 20000}),
    ("dynamic", {"a": 20000, "b": 5000, "c": 5000, "d": 5000}),
    ("threshold", {"a": 20000, "b": 15000, "c": 200, "d": 15000}),
    ("none", {"a": 20000, "b": 1000, "c": 200, "d": 400}),
])
def test_smote_plan(spark, mode, expected):
    counts = spark.createDataFrame([("a", 20000), ("b", 1000), ("c", 200), ("d", 400)], "cls string, n bigint")
    assert {r.cls: r.target for r in sampling.smote_plan(counts, mode).collect()} == expected


def test_dynamic_plan_needs_two_classes_of_two_rows(spark):
    for rows in ([("a", 10)], [("a", 100), ("b", 1)]):
        plan = sampling.smote_plan(spark.createDataFrame(rows, "cls string, n bigint"), "dynamic")
        assert all(r.n == r.target for r in plan.collect())


def test_nearest_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n in (("a", 300), ("b", 40), ("c", 3)):
        points = np.round(rng.normal(size=(n, 4)), 1)
        points[: n // 5] = points[0]  # many copies
        rows += [(name, [float(x) for x in p]) for p in points]
    df = spark.createDataFrame(rows, "cls string, vec array<double>")
    got = {(r.cls, tuple(r.vec)): r.neighbours for r in neighbors.nearest_in_class(df, 5, max_cell=40).collect()}
    for name in "abc":
        points = np.array([v for c, v in rows if c == name])
        for v in {tuple(p) for p in points}:
            want = np.sort(((points - np.array(v)) ** 2).sum(axis=1))[1:6]
            near = ((np.array(got[(name, v)]) - np.array(v)) ** 2).sum(axis=1)
            assert np.allclose(near, want)


@pytest.mark.parametrize("width", [20, 78])
def test_wide_neighbours_over_many_cells_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    points = rng.normal(size=(260, 3)) @ rng.normal(size=(3, width)) + 0.01 * rng.normal(size=(260, width))
    rows = [("a/1", p.tolist()) for p in points] + [("a", p.tolist()) for p in points[:5]]
    df = spark.createDataFrame(rows, "cls string, vec array<double>")
    located, levels = neighbors.build_cells(
        df.withColumn("key", F.md5(F.concat_ws("|", "cls", F.to_json("vec")))).withColumn("m", F.lit(1)), max_cell=3)
    assert len(levels) > 2 and max(r["count"] for r in located.groupBy("cell").count().collect()) <= 3
    got = {tuple(r.vec): r.neighbours for r in neighbors.nearest_in_class(df.filter("cls = 'a/1'"), 5, max_cell=3).collect()}
    assert len(got) == 260
    for p in points[::7]:
        dist = ((points - p) ** 2).sum(axis=1)
        assert np.allclose(got[tuple(p)], points[np.argsort(dist)[1:6]])


def test_smote_sizes_and_positions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{i}", "big" if i < 60 else "tiny", float(rng.normal()), float(rng.normal())) for i in range(70)]
    df = spark.createDataFrame(rows, "uid string, cls string, x double, y double")
    out, plan = smote.smote(df, "cls", ["x", "y"], "full")
    got = out.collect()
    assert {r.cls: r.target for r in plan.collect()} == {"big": 60, "tiny": 60}
    new = [r for r in got if r.synthetic]
    assert len(new) == 50 and {r.cls for r in new} == {"tiny"}
    real = np.array([[r.x, r.y] for r in got if not r.synthetic and r.cls == "tiny"])
    for r in new:
        p = np.array([r.x, r.y])
        best = min(np.linalg.norm(a - p) + np.linalg.norm(b - p) - np.linalg.norm(a - b) for a in real for b in real)
        assert best < 1e-9  # on the line between two real rows of the class
    again, _ = smote.smote(df, "cls", ["x", "y"], "full")
    assert sorted((r.x, r.y) for r in again.filter("synthetic").collect()) == sorted((r.x, r.y) for r in new)


def test_cells_in_which_nothing_is_asked(spark):
    rng = np.random.default_rng(7)
    points = [("a", [float(x), float(y)]) for x, y in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(points, "cls string, vec array<double>")
    asked = spark.createDataFrame(points[:2], df.schema)
    got = {tuple(r.vec): r.neighbours for r in neighbors.nearest_in_class(df, 3, asked, max_cell=10).collect()}
    vectors = np.array([v for _, v in points])
    assert set(got) == {tuple(v) for _, v in points[:2]}
    for i in range(2):
        order = np.argsort(((vectors - vectors[i]) ** 2).sum(axis=1))
        assert got[tuple(points[i][1])] == [points[j][1] for j in order[1:4]]


def test_smote_draws_from_complete_rows_of_every_class(spark):
    nan, rng = float("nan"), np.random.default_rng(2)
    rows = [(f"b{i}", "big", float(rng.normal()), float(rng.normal())) for i in range(40)]
    for cls in (None, "tiny"):
        rows += [(f"{cls}{i}", cls, [None, nan, float("inf"), -0.0, 1.0, 2.0, 3.0, 4.0][i], float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "uid string, cls string, x double, y double")
    out, _ = smote.smote(df, "cls", ["x", "y"], "full", max_cell=3)
    new = [r for r in out.collect() if r.synthetic]
    assert sorted((r.cls or "") for r in new) == [""] * 32 + ["tiny"] * 32
    assert all(0 <= r.x <= 4 and 3 <= r.y <= 7 for r in new)
    with pytest.raises(ValueError, match="complete"):
        smote.smote(df.filter("cls = 'big' or x is null or x <= 0"), "cls", ["x", "y"], "full")


# --- evaluation --------------------------------------------------------------------


def test_metrics_of_a_class_never_predicted(spark):
    pairs = E.confusion_pairs(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int"), "t", "p")
    rows = {r["class"]: r for r in E.per_class(pairs).collect()}
    assert rows[2].precision == 0.0 and rows[2].recall == 0.0 and rows[2].f1 == 0.0
    assert rows[1].precision == pytest.approx(1 / 3)
    assert sum(sum(r[1:]) for r in E.confusion(pairs, [0, 1, 2]).collect()) == 4


def test_auc_is_undefined_without_positives(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.2, 0.8])], "t int, p array<double>")
    assert E.macro_auc(df, "t", "p").first().auc is None


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.1, 0.9]), (0, [0.4, 0.6])], "t int, p array<double>")
    assert E.binary_auc(df, "t", "p").first().auc == pytest.approx(0.625)
    assert E.roc_points(df, "t", None) is None
    points = sorted((r.fpr, r.tpr) for r in E.roc_points(df, "t", "p", binary=True).collect())
    assert points == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (1.0, 1.0)]


# --- features and flows --------------------------------------------------------------


def test_serving_features_clamp_and_fall_back(spark):
    df = spark.createDataFrame([("-1", "-", "50", "10", None, "2", "0", " TCP ", "HTTP-ALT", "22")],
                               "duration string, orig_bytes string, orig_ip_bytes string, resp_bytes string, resp_ip_bytes string,"
                               " orig_pkts string, resp_pkts string, proto string, service string, id_resp_p string")
    r = X.conn_features(df, "serve").first()
    assert (r.duration, r.orig_bytes, r.resp_bytes, r.bytes_ratio, r.pkts_ratio) == (0.0, 50.0, 10.0, 5.0, 2e6)
    assert (r.proto_tcp, r.is_http, r.is_ssh) == (1.0, 1.0, 1.0)
    t = X.conn_features(df, "train").first()
    assert (t.duration, t.orig_bytes, t.bytes_ratio, t.proto_tcp, t.is_http) == (-1.0, 0.0, pytest.approx(1 / 11), 0.0, 0.0)


def test_class_order_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "c string")
    order = X.class_order(df, "c")
    assert order == ["a", "b", "c"]
    assert [r[0] for r in df.select(X.class_code(F.col("c"), order)).collect()] == [1, 0, 2, None]


def test_scale_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert X.fit_scale(df, ["x", "y"]) == {"x": 1.0, "y": 1.0}


def test_packets_to_flows(spark):
    t = dt.datetime(2024, 1, 1)

    def packet(uid, seconds, is_orig, flags, size):
        return (uid, t + dt.timedelta(seconds=seconds), is_orig, flags, size)

    rows = [packet("a", 0, True, "S", 0), packet("a", 10, False, "PA", 100), packet("a", 10, False, "A", 300),
            packet("a", 700, True, "PA", 50), packet("a", 703, False, "A", 200), packet("b", 5, True, "A", 9)]
    df = spark.createDataFrame(rows, "uid string, ts timestamp, is_orig boolean, flags string, len bigint")
    got = {r.uid: r for r in flows.packets_to_flows(df, slice_seconds=300).collect()}
    a, b = got["a"], got["b"]
    assert (a.duration, a.total_fwd_pkts, a.total_bwd_pkts, a.idle_min) == (703.0, 2, 3, 3.0)
    assert (a.bwd_pkt_len_min, a.bwd_pkt_len_max, a.bwd_pkt_len_mean) == (100.0, 300.0, 200.0)
    assert a.bwd_pkt_len_std == pytest.approx(np.std([100, 300, 200])) and a.psh_flag_count == 2 and a.act_data_pkt_fwd == 1
    assert (b.duration, b.idle_min, b.bwd_pkt_len_std, b.min_pkt_len) == (1e-6, 0.0, 0.0, 9.0)
    fine = flows.packets_to_flows(df, slice_seconds=1)
    assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, got.values()))
    conn = spark.createDataFrame([("a", t - dt.timedelta(seconds=1), 800.0, "h", 1, "g", 443)],
                                 "uid string, start_ts timestamp, duration double, id_orig_h string, id_orig_p int, id_resp_h string, id_resp_p int")
    joined = flows.packets_to_flows(df, conn).collect()
    assert len(joined) == 1 and (joined[0].duration, joined[0].idle_min, joined[0].dst_port) == (800.0, 1.0, 443)


def _walk(df, filters):
    """All pages of a table, each read after the one before."""
    after, ids = None, []
    for _ in range(100):
        page = Q.page_after(df, filters, after)
        rows = page.collect()
        if not rows:
            return ids
        ids += [r.n for r in rows]
        after = Q.next_page_key(page, filters, after)
    raise AssertionError("the walk does not end")


def test_page_walk_loses_no_row(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 9 == 0 else day + dt.timedelta(days=i % 3), None if i % 11 == 0 else f"id{i % 4}", ["Low", "High", "Critical"][i % 3],
             None if i % 5 == 0 else (i % 4) / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, timestamp timestamp, id string, severity string, model_score double")
    sizes = {"timestamp": 23, "-timestamp": 9, "severity": 19, "-severity": 17, "model_score": 31, "-model_score": 13}
    for key, size in sizes.items():
        walked = _walk(df, Q.AlertFilters(page_size=size, sort=key))
        assert sorted(walked) == list(range(60)), (key, size)


def test_pages_of_a_directory_equal_numbered_pages(spark, alerts):
    for key, size in (("-timestamp", 7), ("severity", 5), ("model_score", 500)):
        filters = Q.AlertFilters(page_size=size, sort=key, attack_type=["DDOS", "BENIGN"])
        path = scratch_dir(spark, "pages")
        want = [r.id for r in Q.sort_alerts(Q.filter_alerts(alerts, filters), key).collect()]
        assert Q.write_pages(alerts, filters, path, per_folder=3) == len(want)
        for page in (1, 2, 4, -(-len(want) // size)):
            assert [r.id for r in Q.read_page(spark, path, page).collect()] == want[(page - 1) * size:page * size]
        assert Q.read_page(spark, path, len(want)).count() == Q.read_page(spark, path, 0).count() == 0
        assert Q.read_page(spark, path, 1).columns == alerts.columns
    plan = Q.read_page(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Offset" not in plan and "PushedFilters: [IsNotNull(page), EqualTo(page,1)]" in plan
    assert all("folder=0" in f for f in Q.read_page(spark, path, 1).inputFiles())
    empty = scratch_dir(spark, "pages")
    assert Q.write_pages(alerts.limit(0), Q.AlertFilters(), empty) == 0 and Q.read_page(spark, empty, 1).count() == 0


def test_means_leave_missing_scores_out(spark, alerts):
    half = alerts.limit(4).withColumn("model_score", F.when(F.monotonically_increasing_id() % 2 == 0, 1.0))
    as_of = half.agg(F.max("timestamp")).first()[0]
    total = Q.model_performance(half, as_of, 168).filter("section = 'total'").first()
    assert total["avg_model_score"] == 1.0
    report = {(r.section, r.key): r.value for r in Q.reports_summary(half).collect()}
    assert report["total", "average_score"] == 1.0 and report["total", "alerts"] == 4.0


def test_reports_of_an_empty_table_are_zeros(spark, alerts):
    from flowlens.functions.times import latest

    none = alerts.limit(0)
    as_of = latest(none)
    assert all(r.value == 0 for r in Q.metrics_overview(none, as_of).collect())
    assert Q.model_performance(none, as_of).first()["count"] == 0
    assert {r["count"] for r in Q.hourly_series(none, as_of).collect()} == {0}
    assert all(not r.value for r in Q.dashboard_metrics(none, as_of).collect())


def test_auc_is_null_for_scores_that_are_no_numbers(spark):
    rows = [(0, [0.9, 0.1]), (1, [0.2, float("nan")]), (1, [0.3, 0.8]), (0, [0.8, 0.3])]
    df = spark.createDataFrame(rows, "t int, p array<double>")
    aucs = {r["class"]: r.auc for r in E.class_auc(df, "t", "p").collect()}
    assert aucs == {0: 1.0, 1: None}
    assert E.macro_auc(df, "t", "p").first().auc is None


def test_pairs_are_read_once(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0)], "t int, p int")
    pairs = E.confusion_pairs(rows, "t", "p")
    for df in (E.global_rows(E.per_class(pairs)), E.class_report(pairs), E.global_metrics(pairs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("LogicalQueryStage") == 1 and "Join" not in plan


def test_copies_of_rows_get_numbers(spark):
    from flowlens.operators.skew import number_copies

    df = spark.createDataFrame([("a", 1)] * 25 + [("a", None), ("a", None), ("b", 2)], "x string, y int")
    got = sorted((r.x, r.y or 0, r["_copy"]) for r in number_copies(df, per_task=4).collect())
    assert got == sorted([("a", 1, i) for i in range(25)] + [("a", 0, 0), ("a", 0, 1), ("b", 2, 0)])
    assert number_copies(df.filter("y = 2")).collect()[0]["_copy"] == 0
    mapped = df.withColumn("m", F.create_map("x", "y"))
    again = number_copies(mapped, per_task=4)
    assert again.schema["m"].dataType == mapped.schema["m"].dataType and again.filter("m[x] <=> y").count() == df.count()
    # One scan of the input and one shuffle.
    path = scratch_dir(spark, "copies")
    df.write.parquet(path)
    plan = number_copies(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_scratch_scope_deletes_its_tables(spark):
    from flowlens.session import materialize, path_exists, scratch_scope

    with scratch_scope(spark):
        table = materialize(spark.range(3), "gone")
        place = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 3 and path_exists(spark, place)
    assert not path_exists(spark, place)


def test_repeated_rows_come_in_chunks(spark):
    from flowlens.operators.skew import repeated

    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 0), ("d", None)], "x string, n long")
    got = {r.x: r["count"] for r in repeated(df, F.col("n"), per_task=4).groupBy("x").count().collect()}
    assert got == {"a": 25, "b": 1}
