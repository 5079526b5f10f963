"""Streams with state against their batch forms and plain loops, for different splits of the input."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from gleaner.streaming import stateful as S

T0 = datetime(2024, 5, 1)


@pytest.fixture
def store(spark):
    old = spark.conf.get(*S.STORE)
    spark.conf.set(*S.STORE)
    yield spark
    spark.conf.set(S.STORE[0], old)


def run(spark, tmp_path, batches, schema, stream, name):
    """Feed the batches one at a time through the same checkpoint, as restarts would; the rows that came out, with their batch."""
    source, out, mark = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "mark"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

        def write(df, number):
            df.selectExpr("*", f"cast({number} AS long) AS batch").write.mode("append").parquet(out)

        made = stream(spark.readStream.schema(schema).parquet(source))
        made.writeStream.outputMode("update" if name.startswith("new") else "append").foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def entries(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b"]), f"e{rng.randrange(40)}", T0 + timedelta(seconds=rng.randrange(300)), f"c{rng.randrange(5)}") for _ in range(n)]


def plain_newest(rows, most):
    out = []
    for shelf in {r[0] for r in rows}:
        last = {}
        for s, i, at, c in rows:
            if s == shelf and (i not in last or (at, c) > last[i]):
                last[i] = (at, c)
        order = sorted(((at, i, c) for i, (at, c) in last.items()), reverse=True)[:most]
        out += [(shelf, k + 1, i, at, c) for k, (at, i, c) in enumerate(order)]
    return Counter(out)


@pytest.mark.parametrize("splits", [[200], [1, 60, 139], [50, 50, 50, 50]])
def test_newest_entries_for_any_split(store, tmp_path, splits):
    rows, schema = entries(200, 3), "shelf string, id string, at timestamp, content string"
    batches, at = [], 0
    for n in splits:
        batches.append(rows[at : at + n])
        at += n
    lists = run(store, tmp_path, batches, schema, lambda s: S.newest_stream(s, 7), "newest")
    want = plain_newest(rows, 7)
    assert Counter(map(tuple, S.newest(store.createDataFrame(rows, schema), 7).collect())) == want
    assert Counter(map(tuple, S.newest_of_lists(lists, 7).collect())) == want
    assert all(len(r["entries"]) <= 7 for r in lists.collect())
    if len(splits) > 1:
        assert any(r["evicted"] for r in lists.collect())


def test_content_id_is_the_content(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    assert df.select(S.content_id(df["c"]).alias("i")).distinct().count() == 2


def arrivals(n, seed):
    rng = random.Random(seed)
    at, out = 0, []
    for k in range(n):
        at += rng.choice([0, 5, 40, 100, 900])
        out.append((rng.choice(["s1", "s1", "s2"]), k, T0 + timedelta(milliseconds=at)))
    return out


def plain_spaced(rows, ms):
    out, last = [], {}
    for source, seq, at in sorted(rows, key=lambda r: (r[2], r[1])):
        due = max(at, last[source] + timedelta(milliseconds=ms)) if source in last else at
        last[source] = due
        out.append((source, seq, at, due))
    return Counter(out)


@pytest.mark.parametrize("splits", [[120], [10, 50, 60]])
def test_rows_are_released_in_order_at_the_interval(store, tmp_path, splits):
    rows, schema = arrivals(120, 5), "source string, seq long, at timestamp"
    batches, at = [], 0
    rng = random.Random(1)
    for n in splits:
        batches.append(rng.sample(rows[at : at + n], n))  # out of order inside a batch
        at += n
    far = T0 + timedelta(hours=3)
    batches += [[("end", 10_000, far)], [("end", 10_001, far + timedelta(hours=1))]]  # the watermark goes past all of them
    got = run(store, tmp_path, batches, schema, lambda s: S.spaced_stream(s, 150, "10 seconds"), "spaced").where("source <> 'end'")
    want = plain_spaced(rows, 150)
    assert Counter(map(tuple, S.spaced(store.createDataFrame(rows, schema), 150).collect())) == want
    assert Counter(tuple(r)[:4] for r in got.collect()) == want
    by = {}
    for r in got.orderBy("batch", "released").collect():
        by.setdefault(r["source"], []).append(r["released"])
    assert all(b - a >= timedelta(milliseconds=150) for x in by.values() for a, b in zip(x, x[1:]))


def test_empty(spark):
    assert S.newest(spark.createDataFrame([], "shelf string, id string, at timestamp, content string"), 3).count() == 0
    assert S.spaced(spark.createDataFrame([], "source string, seq long, at timestamp"), 3).count() == 0
