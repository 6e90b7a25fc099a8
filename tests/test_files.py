import os

import pytest
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.sources import checks, files, logs, sinks


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_zeek_log_drops_comments_and_bad_rows(spark, tmp_path):
    a = write(tmp_path / "a.log", "#separator x\n#fields\tts\tuid\tid.orig_h\torig_bytes\n1.5\tC1\t10.0.0.1\t5\n#close\n2.5\tC2\t10.0.0.2\n"
                                  "3.5\tC3\t10.0.0.3\t-\n")
    b = write(tmp_path / "b.log", "#fields\tuid\tts\n" "C9\t9.5\n")
    df = logs.read_zeek_log(spark, [a, b, a])
    rows = {r.uid: r for r in df.collect()}
    assert sorted(rows) == ["C1", "C3", "C9"]
    assert rows["C1"].orig_bytes == 5.0 and rows["C3"].orig_bytes is None and rows["C9"].id_orig_h is None
    assert df.count() == 3  # the file listed twice is read once


def test_zeek_log_without_header_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        logs.read_zeek_log(spark, write(tmp_path / "x.log", "1\t2\n"))


def test_conn_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1.0", "C1", 'a,"b"'), ("2.0", "C2", " x ")], "ts string, uid string, service string")
    out = str(tmp_path / "conn")
    sinks.write_conn_csv(rows, out)
    lines = [line for f in sorted(os.listdir(out)) if f.startswith("part") for line in open(f"{out}/{f}").read().splitlines()]
    assert lines.count("#fields,ts,uid,service") >= 1 and '1.0,C1,"a,""b"""' in lines
    back = logs.read_conn_csv(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_plain_header_and_short_rows(spark, tmp_path):
    path = write(tmp_path / "c.csv", "ts,uid,id.orig_h\n1,C1,h\n\n2,C2\n3,C3,h,extra\n")
    assert sorted(r.uid for r in logs.read_conn_csv(spark, path).collect()) == ["C1", "C3"]


@pytest.mark.parametrize("policy, expected", [("skip", ["a"]), ("pad", ["a", "b"])])
def test_ragged_policies(spark, tmp_path, policy, expected):
    path = write(tmp_path / "r.csv", "﻿k;  some   name \na;1;9\nb\n")
    df = files.read_ragged(spark, path, short=policy)
    assert df.columns == ["k", "some name"]
    assert sorted(r.k for r in df.collect()) == expected


def test_sniffing(spark, tmp_path):
    assert files.sniff_csv(spark, write(tmp_path / "1.csv", "a;b;c\n1;2;3\n")) == (";", "UTF-8")
    assert files.sniff_csv(spark, write(tmp_path / "2.csv", "a,b\nse\xf1al,1\n", "latin-1")) == (",", "ISO-8859-1")
    assert files.sniff_csv(spark, write(tmp_path / "3.csv", "a\tb;c\n")) == ("\t", "UTF-8")
    assert files.delimiter_of("a;b,c,d") == ","


def test_header_names():
    assert files.header_columns("﻿#fields,ts, uid", ",") == ["ts", "uid"]
    assert files.header_columns(" Flow  ID ,Label, Label", ",") == ["Flow ID", "Label", "Label.1"]


def test_read_cic_unions_days_with_different_headers(spark, tmp_path):
    write(tmp_path / "Monday-WorkingHours.pcap_ISCX.csv", "Flow ID, Label\nf1,BENIGN\n", "latin-1")
    write(tmp_path / "Tuesday-WorkingHours.pcap_ISCX.csv", " Label,Flow ID\nWeb Attack \x96 XSS,f2\n", "latin-1")
    write(tmp_path / "other.csv", "x\n1\n")
    df = files.with_provenance(logs.read_cic(spark, str(tmp_path)))
    rows = {r["Flow ID"]: r for r in df.collect()}
    assert set(rows) == {"f1", "f2"} and rows["f2"].Label.startswith("Web Attack") and rows["f2"].day == "tuesday"
    with pytest.raises(Exception):
        logs.read_cic(spark, str(tmp_path / "nothing"))


def test_kdd_with_fewer_columns(spark, tmp_path):
    df = logs.read_kdd(spark, write(tmp_path / "k.csv", "1,tcp,normal.\n"))
    assert df.columns == ["duration", "protocol_type", "label"]


def test_label_column_detection():
    assert logs.detect_label_col(["a", "Class"], "Label") == "Class"
    with pytest.raises(KeyError):
        logs.detect_label_col(["a"], "Label")


def test_newest_input(spark, tmp_path):
    old, new = write(tmp_path / "a.csv", "1\n"), write(tmp_path / "b.csv", "2\n")
    os.utime(old, (1, 1))
    assert files.resolve_inputs(spark, str(tmp_path), newest=True)[0].endswith("b.csv")
    assert [p.rsplit("/", 1)[1] for p in files.resolve_inputs(spark, [old, new])] == ["a.csv", "b.csv"]


def test_dataset_types():
    assert checks.detect_dataset_type(S.CONN_COLUMNS) == "conn"
    assert checks.detect_dataset_type([c.replace(".", "_") for c in S.CONN_REQUIRED]) == "conn"
    features = [*S.CONN_FEATURES, *S.FEATURE_FILE_META, "Attack"]
    assert checks.detect_dataset_type([c.upper() for c in features]) == "features"
    assert checks.detect_dataset_type(["Timestamp", " Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol"]) == "flow"
    with pytest.raises(ValueError, match="conn_state"):
        checks.detect_dataset_type(["ts", "uid"])
    checks.require_columns(features, "features")
    with pytest.raises(ValueError, match="label"):
        checks.require_columns(features[:-1], "features")


def test_conversion_and_rejects(spark):
    rows = spark.createDataFrame([
        ("3/7/2017 8:55", "1.1.1.1", "5000", "2.2.2.2", "443", "6", "1500000", "0", "0", "Web Attack – XSS", "f"),
        ("bad", "1.1.1.1", "1", "2.2.2.2", "2", "6", "1", "1", "1", "x", "g"),
        ("2017-07-03 08:55", "", "1", "2.2.2.2", "2", "6", "1", "1", "1", "x", "h"),
        ("2017-07-03 08:55", "1.1.1.1", "n/a", "2.2.2.2", "2", "6", "1", "1", "1", "x", "i"),
    ], "Timestamp string, `Source IP` string, `Source Port` string, `Destination IP` string, `Destination Port` string, Protocol string,"
       " `Flow Duration` string, `Total Backward Packets` string, `Total Length of Bwd Packets` string, Label string, `Flow ID` string")
    good, rejected = checks.convert_cic_to_conn(rows, "d" * 80)
    row = good.first()
    assert good.columns == [c.replace(".", "_") for c in S.CONN_COLUMNS]
    assert (row.ts, row.duration, row.service, row.conn_state, row.history) == ("1488876900.000000", "1.500000", "https", "S0", "S")
    assert (row.cicids_label, row.cicids_attack, len(row.uid), len(row.dataset_name)) == ("Web Attack - XSS", "Web Attack", 20, 80)
    assert sorted(r.reject_reason for r in rejected.collect()) == ["endpoint", "port", "timestamp"]
    with pytest.raises(ValueError, match="dst_ip"):
        checks.convert_cic_to_conn(rows.drop("Destination IP"), "d")


def test_alert_ready_needs_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        sinks.alert_ready(spark.range(1))


def test_replay_file_is_in_time_order(spark):
    """The replay rows keep their order of time."""
    rows = spark.range(300).select(
        F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit("10.0.0.1").alias("Source IP"), F.lit("1").alias("Source Port"), F.lit("10.0.0.2").alias("Destination IP"),
        F.lit("").alias("Destination Port"), F.lit("TCP").alias("Protocol"), F.lit("DoS Hulk").alias("Label"))
    times = [r.timestamp for r in logs.replay_to_alerts(rows, "r.csv").orderBy("timestamp").collect()]
    assert len(times) == 300 and times == sorted(times) and len(set(times)) == 300


def test_rows_follow_the_last_header_above_them(spark, tmp_path):
    a = write(tmp_path / "a.log", "#fields\tts\tuid\n1\tA1\n2\tA2\n#fields\tuid\tts\tproto\nA3\t3\ttcp\nA4\t4\tudp\n")
    b = write(tmp_path / "b.log", "#fields\tuid\tproto\nB1\ticmp\n")
    rows = {r.uid: (r.ts, r.proto) for r in logs.read_zeek_log(spark, [a, b], typed=False).collect()}
    assert rows == {"A1": ("1", None), "A2": ("2", None), "A3": ("3", "tcp"), "A4": ("4", "udp"), "B1": (None, "icmp")}
    # The blocks of one file may land in different tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        assert {r.uid: (r.ts, r.proto) for r in logs.read_zeek_log(spark, [a, b], typed=False).collect()} == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_zeek_file_without_header_among_others_is_named(spark, tmp_path):
    a = write(tmp_path / "a.log", "#fields\tts\n1\n")
    b = write(tmp_path / "bare.log", "1\n2\n")
    with pytest.raises(ValueError, match="bare.log"):
        logs.read_zeek_log(spark, [a, b])


def test_many_files_with_unlike_headers(spark, tmp_path):
    for i in range(230):
        write(tmp_path / f"f{i:03d}.csv", ("a,b\n" if i % 2 else "b,c\n") + f"{i},x\n")
    df = files.read_ragged(spark, str(tmp_path))
    assert df.count() == 230 and set(df.columns) == {"a", "b", "c"}
    assert df.filter("a is not null").count() == 115


def test_one_line_of_many_quotes(spark, tmp_path):
    cells = [f'"c,{i}"' for i in range(20_000)]
    path = write(tmp_path / "q.csv", "x,y\n" + ",".join(cells) + "\n" + 'plain,"a ""b"" c"\nlone"quote,z\n')
    rows = files.read_ragged(spark, path).collect()
    assert [tuple(r) for r in rows] == [("c,0", "c,1"), ("plain", 'a "b" c'), ('lone"quote', "z")]


def test_header_with_blanks_is_no_row(spark, tmp_path):
    path = write(tmp_path / "h.csv", 'uid, proto\n1,tcp\n"uid","proto"\nuid,other\n')
    rows = files.read_ragged(spark, path, columns=["uid", "proto"]).collect()
    assert [tuple(r) for r in rows] == [("1", "tcp"), ("uid", "other")]


def test_empty_files_have_no_rows(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "x\n1\n"), write(tmp_path / "b.csv", "")
    assert [r.x for r in files.read_ragged(spark, [a, b]).collect()] == ["1"]
    with pytest.raises(FileNotFoundError):
        files.read_ragged(spark, b)


def test_conversion_without_rows_can_be_read(spark, tmp_path):
    from flowlens.schemas import FLOW_COLUMNS

    columns = [names[0] for names in FLOW_COLUMNS.values()]
    rows = spark.createDataFrame([tuple("?" for _ in columns)], columns)
    counts = sinks.convert_and_write(rows, str(tmp_path / "out"), "a name of more than fifty characters that is kept as it is")
    assert counts["written"] == 0 and counts["input"] == 1
    assert logs.read_conn_csv(spark, str(tmp_path / "out")).count() == 0


def test_conversion_is_dealt_by_rows(spark, tmp_path):
    """A part of the conversion is bounded by its rows, however few parts the shuffle before it has."""
    rows = spark.range(45_000).select(
        F.lit("1.2.3.4").alias("Source IP"), F.col("id").cast("string").alias("Source Port"), F.lit("5.6.7.8").alias("Destination IP"),
        F.lit("80").alias("Destination Port"), F.lit("6").alias("Protocol"), F.lit("2017-07-05 09:30:00").alias("Timestamp"),
        F.lit("a").alias("Flow ID"), F.lit("1").alias("Flow Duration"), F.lit("BENIGN").alias("Label"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sinks.convert_and_write(rows, str(tmp_path / "out"), "lab") == {"written": 45_000, "skipped": 0, "input": 45_000}
        good, _ = checks.convert_cic_to_conn(rows, "lab")
        assert good.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = [sum(1 for _ in open(p)) - 1 for p in (tmp_path / "out").glob("part-*")]
    assert sum(lines) == 45_000 and max(lines) <= 15_001
