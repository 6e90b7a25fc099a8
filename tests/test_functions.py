import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import alerts as A
from flowlens.functions import labels as L
from flowlens.functions import numbers as N
from flowlens.functions import times as TM


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_safe_double_rules(text):
    df = text(["1.5", " 2 ", "-", "", "1,234", "nan", "-inf", "1_000", "1.0d", "abc", "1e3", None, ".5", "5.", "Infinity"])
    plain = column(df, N.safe_double("c", -1.0, "plain"))
    comma = column(df, N.safe_double("c", -1.0, "comma"))
    clean = column(df, N.safe_double("c", -1.0, "clean"))
    assert plain[:5] == [1.5, 2.0, -1.0, -1.0, -1.0]
    assert math.isnan(plain[5]) and plain[6] == -math.inf
    assert plain[7:14] == [1000.0, -1.0, -1.0, 1000.0, -1.0, 0.5, 5.0]
    assert comma[4] == 1234.0 and math.isnan(comma[5])
    assert clean[4:7] == [1234.0, -1.0, -1.0]
    assert clean[14] == math.inf


def test_safe_int_truncates(text):
    assert column(text(["1.9", "-1.9", "x", "inf"]), N.safe_int("c", 7)) == [1, -1, 7, 7]


def test_unknown_rule_is_an_error():
    with pytest.raises(ValueError):
        N.safe_double("c", 0.0, "other")


def test_parse_ts_in_order(text):
    df = text([
        "2017-07-03 08:55:58", "2017-7-3T8:5:8.123", "3/7/2017 8:55", "03/07/2017 08:55:58 PM", "25/12/2017 1:02",
        "1499075758.25", "2017-07-03", "2017/07/03 10:11", "garbage", "", None, "nan", "2017-07-03 08:55:58+02:00",
    ])
    got = [None if v is None else v.isoformat(" ") for v in column(df, TM.parse_ts("c"))]
    assert got == [
        "2017-07-03 08:55:58", "2017-07-03 08:05:08.123000", "2017-03-07 08:55:00", "2017-03-07 20:55:58",
        "2017-12-25 01:02:00", "2017-07-03 09:55:58.250000", "2017-07-03 00:00:00", "2017-07-03 10:11:00",
        None, None, None, None, "2017-07-03 06:55:58",
    ]
    day_first = column(df, TM.parse_ts("c", day_first=True))
    assert day_first[2].isoformat() == "2017-07-03T08:55:00"
    strict = column(df, TM.parse_ts("c", iso_fallback=False))
    assert strict[6] is None and strict[7] is None


def test_protocols(text):
    df = text(["6", "06", "17", "TCP", " udp ", "http", "DNS", "", "  ", None, "99", "gre"])
    pairs = [tuple(v) for v in column(df, L.norm_protocol("c"))]
    assert pairs == [("tcp", "6"), ("tcp", "6"), ("udp", "17"), ("tcp", "6"), ("udp", "17"), ("tcp", "6"), ("udp", "17"),
                     ("tcp", "6"), ("tcp", "6"), ("tcp", "6"), ("99", "99"), ("gre", "6")]
    assert column(df, L.alert_protocol("c"))[:3] == ["TCP", "Other", "UDP"]
    assert column(df, L.alert_protocol("c", numbers=False))[:4] == ["Other", "Other", "Other", "TCP"]


def test_label_rules(text):
    df = text(["BENIGN", "Web Attack – XSS", "Web Attack � Brute Force", "Web Attack — Sql   Injection", "DoS Hulk",
               "Port Scan", "Bot", "FTP-Patator", None])
    assert [v["class"] for v in column(df, L.norm_label("c"))] == [
        "BENIGN", "Web Attack", "Web Attack", "Web Attack", "DoS", "Port Scan", "Bot", "Brute Force", ""]
    assert column(df, L.map_label6("c")) == [
        "BENIGN", "OTHER", "BRUTE_FORCE", "OTHER", "DOS", "OTHER", "BOT", "BRUTE_FORCE", "OTHER"]
    assert column(df, L.map_label10("c")) == [
        "BENIGN", "WEB_ATTACK", "WEB_ATTACK", "WEB_ATTACK", "DOS", "PORTSCAN", "BOT", "BRUTE_FORCE", "OTHER"]
    assert column(df, L.cic_attack_group("c"))[5] is None


def test_unknown_attack_type(text):
    df = text(["Port_Scan", "brute force", None, ""])
    assert column(df, L.parse_attack_type("c")) == ["PORTSCAN", "BRUTE_FORCE", None, None]
    with pytest.raises(Exception, match="unknown attack type"):
        column(text(["worm"]), L.parse_attack_type("c"))
    assert column(text(["worm"]), L.parse_attack_type("c", on_unknown="null")) == [None]


@pytest.mark.parametrize("score, attack, expected", [
    (0.95, "BENIGN", "Critical"), (0.8, "BENIGN", "High"), (0.5, "BENIGN", "Medium"), (0.1, "BENIGN", "Low"),
    (0.1, "DOS", "High"), (0.1, "DDOS", "Critical"), (0.1, "BOT", "Critical"), (0.1, "PORTSCAN", "Medium"),
    (0.1, "BRUTE_FORCE", "High"),
])
def test_severity(spark, score, attack, expected):
    assert spark.range(1).select(A.severity(F.lit(score), F.lit(attack))).first()[0] == expected


def test_flow_id_without_port(spark):
    df = spark.createDataFrame([("a", "b", None, 80, "tcp"), ("a", "b", 1, 80, "sctp")], "s string, d string, p int, q int, t string")
    assert column(df, L.flow_id("s", "d", "p", "q", "t")) == ["a-b-<NA>-80-6", "a-b-1-80-0"]


def test_metadata_keeps_nested_values(spark):
    df = spark.createDataFrame([('{"model":{"p":[1,2.5]},"dataset_source":"old","t":"a\\"b"}',), (None,)], "meta string")
    tagged = A.tag_dataset(df, "uploaded", "d1")
    first, second = tagged.select(
        A.meta_field("meta", "model.p[1]"), A.meta_field("meta", "dataset_source"), A.meta_field("meta", "t"),
        A.meta_field("meta", "dataset_id")).collect()
    assert tuple(first) == ("2.5", "uploaded", 'a"b', "d1")
    assert tuple(second) == (None, "uploaded", None, "d1")


def test_incident_context_prefers_metadata(spark):
    df = spark.createDataFrame([("DOS", '{"summary":"s","playbook":["x","y"]}'), ("WORM", "{}")], "a string, m string")
    first, second = column(df, A.incident_context("a", "m"))
    assert (first.summary, first.playbook) == ("s", ["x", "y"])
    assert (second.title, second.summary) == ("WORM", "WORM") and len(second.playbook) == 3


def test_format_bytes(spark):
    df = spark.createDataFrame([(0,), (-5,), (None,), (1023,), (1536,), (5 * 1024 ** 4,), (4096 * 1024 ** 4,)], "n bigint")
    assert column(df, N.format_bytes("n")) == ["0 B", "0 B", "0 B", "1023.0 B", "1.5 KB", "5.0 TB", "4096.0 TB"]


def test_top_k_keeps_order_of_ties(spark):
    m = F.create_map(*[F.lit(x) for x in ("a", 1.0, "b", 3.0, "c", 3.0, "d", 0.5)])
    assert [e.key for e in spark.range(1).select(A.top_k_map(m, 3)).first()[0]] == ["b", "c", "a"]
