"""Sources, sinks and the stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from graphmill.sources import files, rest
from graphmill.streaming import monitor


def test_load_or_build(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.load_or_build(spark, str(tmp_path / "c"), build).count() == 3
    assert len(made) == 1


def test_json_tolerance(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n')
    assert sorted(r["x"] for r in files.read_json(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    assert files.read_json(spark, str(tmp_path / "none.jsonl"), "x int").count() == 0


def test_csv_round_trip_and_references(spark, tmp_path):
    df = spark.createDataFrame([("n", {"k": 'v,"q"'}, ["a"])], "id string, attrs map<string,string>, xs array<string>")
    files.write_csv(df, str(tmp_path / "o"))
    row = files.read_csv(spark, str(tmp_path / "o"), "id string, attrs string, xs string").collect()[0]
    assert json.loads(row["attrs"]) == {"k": 'v,"q"'}
    (tmp_path / "r.csv").write_text('node_id,reference\nn,"b, c"\nn,a\n,x\n')
    assert files.read_references(spark, str(tmp_path / "r.csv")).collect()[0]["references"] == ["a", "b, c"]


def test_manifest_and_archives(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "d").mkdir(parents=True)
    (root / "d" / "a.py").write_text("x")
    (root / "b.bin").write_bytes(b"a\0b")
    (root / "bad.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("d/a.py", "y")
        z.writestr("new.txt", "t")
    base = files.manifest(spark, str(root))
    got = {r["relpath"]: (r["is_text"], r["mime"]) for r in base.collect()}
    assert got["d/a.py"] == (True, "text/x-python") and got["b.bin"][0] is False
    merged = files.merged_manifest(base, files.expanded_archives(spark, str(root)))
    assert {r["relpath"] for r in merged.where("source_archive is not null").collect()} == {"new.txt"}


def test_git_log(spark, tmp_path):
    line = lambda s, m: "\x1f".join((s, "Ann", "a@x.example", "2024-01-01T00:00:00+00:00", "p1 p2", m))
    (tmp_path / "log").write_text("\n".join([line("s1", "old"), line("s1", "new"), "damaged"]) + "\n")
    row = files.read_git_log(spark, str(tmp_path / "log")).collect()
    assert len(row) == 1 and row[0]["message_head"] == "new" and row[0]["parents"] == ["p1", "p2"]


def test_html(spark):
    df = spark.createDataFrame([("<p>a&nbsp;&lt;b</p><script>x<1</script><!-- c -->",), (None,)], "h string")
    assert [r[0] for r in df.select(files.text_of_html(F.col("h"))).collect()] == ["a <b", None]


def test_paging():
    data = {1: [1, 2], 2: [3]}
    answers = iter([(429, ""), (200, json.dumps(data[1])), (500, ""), (200, json.dumps(data[2]))])
    assert list(rest.pages("http://x/c", 2, lambda u: next(answers), pause=0)) == [1, 2, 3]
    with pytest.raises(PermissionError):
        list(rest.pages("http://x/c", 2, lambda u: (401, ""), pause=0))
    with pytest.raises(ConnectionError):
        list(rest.pages("http://x/c", 2, lambda u: (503, ""), pause=0))


def test_rest_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"sha": "a"}, {"sha": "b"}]))
    (tmp_path / "2.json").write_text(json.dumps([{"sha": "c"}]))
    spark.dataSource.register(rest.RestSource)
    df = spark.read.format("graphmill_rest").option("stub", str(tmp_path)).option("per_page", "2").load("http://x/commits")
    assert sorted(json.loads(r["record"])["sha"] for r in df.collect()) == ["a", "b", "c"]


def test_serving_model(spark):
    df = spark.createDataFrame([("m", "m_1"), ("m", "m_10"), ("m", "m_9"), ("n", "n_1")], "family string, name string")
    assert {r["family"]: r["name"] for r in files.serving_model(df).collect()} == {"m": "m_9", "n": "n_1"}


def test_append_scores(spark):
    spark.sql("drop table if exists scores_test")
    for _ in range(2):
        files.append_scores(spark.range(2), "scores_test")
    assert spark.table("scores_test").count() == 4
    spark.sql("drop table scores_test")


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "a", float(i)) for i in range(6)] + [("2024-01-02 00:00:00", "a", 1.0)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(src))
    q = monitor.watch(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() >= 6 and out.agg(F.max("n")).collect()[0][0] == 1
