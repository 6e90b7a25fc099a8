"""Records of delimited files against csv.reader, over one and many blocks."""

import csv
import io
import os
import random
import subprocess
import sys

import pyspark
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from flowlens.sources import files, logs, records


csv.field_size_limit(10**9)


def by_hand(text, sep=","):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def cells(spark, paths, sep=",", **kw):
    rows = records.records(spark, paths, sep, **kw)
    return [list(r[0]) for r in rows.filter(F.length("value") > 0).select(records.split_cells(F.col("value"), sep)).collect()]


@pytest.fixture()
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


LINES = ['a,"b,c",d', 'a"b,c', '"a""b",c', '"a"x,"y', 'z",k', ',,', '""', '"",""', '"a"b"c,d', '"""', 'x""y,"p""', 'é,"ü', '"ö",ñ', "﷐,﷑",
         '"﷐0,﷑1""",2', "plain,line,here", '"open', "still open", 'closed"', '","', '",', 'a,"', '"a" ,b', ' "a",b', "'q',\"r\"", "x\t\"y\",z"]


def test_cells_equal_csv_reader_for_single_records(spark):
    r = random.Random(1)
    alphabet = ['"', ",", "a", "b", '""', " ", "﷐", "﷑", "0", "1"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 14))) for _ in range(3000)] + LINES
    texts = [t for t in texts if t]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = df.select("value", records.split_cells(F.col("value"), ",").alias("c")).collect()
    assert [(r.value, list(r.c)) for r in got] == [(t, next(csv.reader([t]))) for t in texts]


@pytest.mark.parametrize("size", [1 << 20, 211, 61])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_over_many_blocks_equal_csv_reader(spark, tmp_path, small_blocks, size, end):
    r = random.Random(size)
    paths, want = [], []
    for i in range(3):
        text = end.join(r.choice(LINES) for _ in range(30)) + end + '"last",row' + end
        if i == 0:
            text = '"' + ("a long cell" + end) * 12 + '",' + text  # a record over many blocks
        if i == 1:
            text = text[:-len(end)] + f'{end}open at the end,"of{end}the file'
        paths.append(write(tmp_path / f"{i}.csv", text))
        want += by_hand(text)
    small_blocks(size)
    for bound in (100_000, 0) if size == 211 else (100_000,):
        got = cells(spark, paths, max_rows=bound)
        assert sorted(got) == sorted(want)


def test_lone_carriage_returns_and_encodings(spark, tmp_path):
    text = 'a,"b\rc\nd\r\ne"\rf,g\r\r\nh,"ï"\n'
    assert sorted(cells(spark, [write(tmp_path / "a.csv", text)])) == sorted(by_hand(text))
    assert sorted(cells(spark, [write(tmp_path / "b.csv", text, "latin-1")], encoding="ISO-8859-1")) == sorted(by_hand(text))
    plain = "a,b\rc,d\r\ne,f\n"
    assert sorted(cells(spark, [write(tmp_path / "c.csv", plain)])) == sorted(by_hand(plain))
    assert cells(spark, [write(tmp_path / "d.csv", "")]) == []
    long = "x" * 300_000 + ',"' + "line\n" * 20_000 + '",' + '""' * 3 + "\n"
    assert cells(spark, [write(tmp_path / "e.csv", long)]) == by_hand(long)


def test_quoted_headers_and_line_breaks_reach_the_readers(spark, tmp_path):
    text = 'uid,"a,b",proto\n1,x,tcp\n2,"multi\nline",udp\n3,"say ""hi"", twice",icmp\n4,short\n5,w,x,long\n'
    path = write(tmp_path / "c.csv", text)
    want = [("1", "x", "tcp"), ("2", "multi\nline", "udp"), ("3", 'say "hi", twice', "icmp"), ("5", "w", "x")]
    for df in (logs.read_conn_csv(spark, path), logs.read_feature_csv(spark, path), files.read_ragged(spark, path)):
        assert df.columns == ["uid", "a,b", "proto"] and sorted(map(tuple, df.collect())) == want
    padded = files.read_ragged(spark, path, short="pad")
    assert ("4", "short", "") in map(tuple, padded.collect()) and padded.count() == 5
    days = tmp_path / "days"
    days.mkdir()
    write(days / "Monday-WorkingHours.pcap_ISCX.csv", text.replace("multi", "mültí"), "latin-1")
    cic = logs.read_cic(spark, str(days))
    assert cic.columns == ["uid", "a,b", "proto", "source_file"]
    assert {tuple(r)[:3] for r in cic.collect()} == {("1", "x", "tcp"), ("2", "mültí\nline", "udp"), want[2], ("4", "short", None), want[3]}


def test_headers_over_several_lines(spark, tmp_path):
    a = write(tmp_path / "a.csv", '"long\nname",b\n1,2\n')
    b = write(tmp_path / "b.csv", "b,c\n3,4\n")
    got = files.read_ragged(spark, [a, b], provenance=True)
    assert got.columns == ["long name", "b", "source_file", "c"]
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        got.collect()[0].__class__(**{"long name": "1", "b": "2", "source_file": "a.csv", "c": None}),
        got.collect()[0].__class__(**{"long name": None, "b": "3", "source_file": "b.csv", "c": "4"})]))
    wide = '"' + "\n".join(f"part {i}" for i in range(40)) + '",z\n7,8\n'
    assert [tuple(r) for r in files.read_ragged(spark, write(tmp_path / "w.csv", wide)).collect()] == [("7", "8")]


def test_single_line_files_are_read_without_python(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,"x,y"\n2,z\n')
    plan = files.read_ragged(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "InPython" not in plan
    told = files.read_ragged(spark, path, multiline=False)
    assert sorted(map(tuple, told.collect())) == [("1", "x,y"), ("2", "z")]


def test_tasks_carry_the_readers_helpers(tmp_path):
    """A worker that does not have this repository can cut records."""
    task = tmp_path / "task"
    task.write_bytes(cloudpickle.dumps(records.state_after))
    code = f"import pickle; print(pickle.load(open({str(task)!r}, 'rb'))('a,\"b', ','))"
    env = {"PATH": os.environ["PATH"], "PYTHONPATH": os.path.dirname(os.path.dirname(pyspark.__file__))}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == str(records.QUOTED), done.stderr
