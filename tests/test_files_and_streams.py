"""Edges: files in and out, incremental runs against batch runs."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.sources import files
from gleaner.streaming import caches


def test_jsonl_keeps_unknown_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2, "odd": 3}\n\n{"id": "2"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path), schema).orderBy("id").collect()] == [("1", 2), ("2", None)]
    kept = files.read_jsonl_keeping(spark, str(tmp_path), schema).orderBy("id").collect()
    assert kept[0]["metadata"] == {"odd": "3"} and kept[1]["metadata"] == {}


def test_replace_keeps_the_old_rows_aside(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_jsonl(spark.range(3), path)
    files.append_jsonl(spark.range(3, 5), path)
    files.replace_jsonl(files.read_jsonl(spark, path, T.StructType([T.StructField("id", T.LongType())])).where("id > 2"), path)
    assert spark.read.json(path).count() == 2 and spark.read.json(f"{path}.bak").count() == 5


def test_report_csv_and_walk(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2])], "id long, note string, xs array<long>")
    files.write_report_csv(df, str(tmp_path / "r"), ["id", "note", "xs", "missing"])
    row = spark.read.option("header", True).csv(str(tmp_path / "r")).first()
    assert row["id"] == "1" and row["note"] is None and json.loads(row["xs"]) == [1, 2] and row["missing"] is None
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.cube").write_text("LUT_3D_SIZE 2\n" + "0 0 0\n" * 8)
    assert files.walk(spark, str(tmp_path / "d"), "*.cube").count() == 1
    assert files.read_cubes(spark, str(tmp_path / "d")).first()["name"] == "x.cube"


def _events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_stream_runs_resume_and_match_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    _events(spark, source, rows[:30])
    schema = spark.read.parquet(source).schema
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    caches.drain(stream(), caches.upsert_latest(target, "user_id", ["ts"]), mark)
    assert spark.read.parquet(target).count() == 30
    _events(spark, source, rows[30:])
    caches.drain(stream(), caches.upsert_latest(target, "user_id", ["ts"]), mark)
    stored = spark.read.parquet(target)
    assert stored.count() == 60
    last = {r["user_id"]: r["event_id"] for r in caches.latest(stored, "user_id", ["ts"], F.col("event_type") == "a").collect()}
    assert last == {0: 54, 1: 58, 2: 56}
    assert caches.pending(spark.range(70).withColumnRenamed("id", "event_id"), stored, "event_id").count() == 10


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    _events(spark, source, [(i, t0 + timedelta(minutes=9 * i), i % 3, "ab"[i % 2], float(i)) for i in range(80)])
    schema = spark.read.parquet(source).schema
    for name, make in {"w1": lambda e, late: caches.tumbling(e, "1 hour", late), "w2": lambda e, late: caches.sliding(e, "1 hour", "30 minutes", late)}.items():
        query = make(spark.readStream.schema(schema).parquet(source), "1 hour").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        want = {tuple(r) for r in make(spark.read.parquet(source), None).collect()}
        assert {tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()} == want
    twice = str(tmp_path / "twice")
    _events(spark, twice, [(i % 20, t0 + timedelta(minutes=i % 20), 0, "a", 1.0) for i in range(40)])
    query = caches.deduplicated(spark.readStream.schema(schema).parquet(twice), ["event_id"], "2 hours").writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM d").count() == 20
