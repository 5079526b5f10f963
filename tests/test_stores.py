"""Archives, tensors and published shards: real files, damaged ones, restarts."""

import io
import os
import zipfile

import numpy as np
import pytest

from gleaner.sources.archives import unsafe, zip_members, zipped
from gleaner.sources.publish import publish, sound, staged
from gleaner.sources.tensors import NpySource


def members(spark, path, *args, **options):
    files = spark.read.format("binaryFile").load(str(path))
    return {(os.path.basename(r["path"]), r["member"]): r for r in zip_members(files, *args, **options).collect()}


def test_zip_members_in_order_and_bounded(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.mkdir("d")
        for name in ("d/b.PNG", "a.png", "readme.txt", "d/a.png"):
            z.writestr(name, name * 3)
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../out.png", "x")
        z.writestr("big.png", b"0" * 5000)
        z.writestr("fits.png", b"1" * 100)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = members(spark, tmp_path, (".png",), 2, most_bytes=1000)
    assert {k: r["status"] for k, r in got.items()} == {("a.zip", "a.png"): "ok", ("a.zip", "d/a.png"): "ok", ("b.zip", "../out.png"): "unsafe_name", ("b.zip", "big.png"): "too_large", ("c.zip", None): "not_an_archive"}
    assert bytes(got["a.zip", "a.png"]["content"]) == b"a.png" * 3 and got["b.zip", "big.png"]["content"] is None
    nothing = spark.createDataFrame([("d.zip", b""), ("e.zip", None)], "path string, content binary")
    assert [r["status"] for r in zip_members(nothing).collect()] == ["not_an_archive"] * 2
    every = members(spark, tmp_path)
    assert ("a.zip", "readme.txt") in every and ("a.zip", "d/") not in every and every["b.zip", "fits.png"]["size"] == 100


def test_damaged_member(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("one.png", b"A" * 200)
        z.writestr("two.png", b"B" * 200)
    data = bytearray(held.getvalue())
    data[data.find(b"A" * 50) + 7] ^= 1
    (tmp_path / "x.zip").write_bytes(data)
    got = members(spark, tmp_path, (".png",))
    assert got["x.zip", "one.png"]["status"] == "unreadable" and got["x.zip", "two.png"]["status"] == "ok"


def test_zipped_and_back(spark):
    rows = [(i % 3, f"m{i}", bytes([i]) * i) for i in range(20)] + [(5, "null", None)]
    df = spark.createDataFrame(rows, "g int, name string, data binary")
    one, two = zipped(df, "g", "name", "data"), zipped(df.repartition(3), "g", "name", "data")
    assert {r["archive"]: bytes(r["content"]) for r in one.collect()} == {r["archive"]: bytes(r["content"]) for r in two.collect()}
    back = zip_members(one.selectExpr("cast(archive AS string) AS path", "content")).collect()
    assert {(int(r["path"]), r["member"], bytes(r["content"])) for r in back} == {(g, n, d or b"") for g, n, d in rows}


@pytest.mark.parametrize("name", ["/etc/x", "a/../../b", "..\\x", "C:/x"])
def test_unsafe(name):
    assert unsafe(name) and not unsafe("a/b..c/d")


@pytest.fixture
def npy(spark):
    spark.dataSource.register(NpySource)
    return spark.read.format("npy")


def test_tensors_of_all_kinds(spark, npy, tmp_path):
    rng = np.random.default_rng(0)
    made = {
        "plain": rng.random((7, 3, 2)), "columns": np.asfortranarray(rng.random((5, 4))), "bytes": rng.integers(0, 255, (6, 2)).astype(np.uint8), "big": rng.random((3, 2)).astype(">f4"),
        "flat": np.arange(11, dtype=np.int64), "single": np.array(2.5), "none": np.zeros((0, 4)), "flags": np.array([[True, False]]),
    }
    for name, a in made.items():
        np.save(tmp_path / f"{name}.npy", a)
    (tmp_path / "other.txt").write_text("x")
    df = npy.option("rangeBytes", 64).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > len(made)
    got = {}
    for r in df.collect():
        got.setdefault(r["name"], {})[r["row"]] = r["values"]
        assert tuple(r["shape"]) == made[r["name"]].shape
    assert set(got) == set(made) - {"none"}
    for name, rows in got.items():
        want = made[name].reshape(made[name].shape[0] if made[name].ndim else 1, -1).astype(float)
        assert np.array_equal(np.array([rows[k] for k in range(len(want))]), want), name
    one = npy.load(str(tmp_path / "flat.npy"))
    assert one.selectExpr("sum(values[0]) AS s").first()["s"] == 55


def test_tensors_written_once_whole(spark, npy, tmp_path):
    path = str(tmp_path / "store")
    rng = np.random.default_rng(1)
    made = {f"t{k}": rng.random((k + 1, 2, 2)) for k in range(5)}
    df = spark.createDataFrame([(n, list(a.shape), a.ravel().tolist()) for n, a in made.items()], "name string, shape array<int>, values array<double>")
    df.write.format("npy").mode("append").save(path)
    assert sorted(os.listdir(path)) == [f"t{k}.npy" for k in range(5)]
    assert all(np.array_equal(np.load(f"{path}/{n}.npy"), a) for n, a in made.items())
    bad = spark.createDataFrame([("good", [1], [1.0]), ("bad", [3], [1.0])], "name string, shape array<int>, values array<double>").coalesce(1)
    with pytest.raises(Exception):
        bad.write.format("npy").mode("append").save(path)
    assert "good.npy" not in os.listdir(path) and "bad.npy" not in os.listdir(path)
    with pytest.raises(Exception, match="not a file's name"):
        spark.createDataFrame([("../x", [1], [1.0])], "name string, shape array<int>, values array<double>").write.format("npy").mode("append").save(path)


def test_tensors_that_are_not_read(spark, npy, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="only numbers"):
        npy.load(str(tmp_path / "o.npy")).count()
    np.save(tmp_path / "cut.npy", np.arange(100.0))
    data = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(data[:-8])
    with pytest.raises(Exception, match="ends before its data"):
        npy.load(str(tmp_path / "cut.npy")).count()


def held(spark, path):
    return {(r["shard"], r["name"]): bytes(r["content"]) for r in staged(spark, path).collect()}


def test_restart_redoes_only_what_is_not_sound(spark, tmp_path):
    path = str(tmp_path / "published")
    rows = [(f"s{i % 4}", f"f{i:02}", bytes([i]) * (i + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "shard string, name string, content binary")
    assert sound(spark, path).count() == 0
    first = {r["shard"]: r for r in publish(df.where("shard <> 's3'"), path).collect()}
    assert set(first) == {"s0", "s1", "s2"} and all(r["written"] for r in first.values())
    whole = {(s, n): c for s, n, c in rows}
    assert held(spark, path) == {k: c for k, c in whole.items() if k[0] != "s3"}
    os.remove(f"{path}/s0.done")  # stopped before its marker
    with open(f"{path}/s1.tar", "r+b") as f:  # torn
        f.truncate(1000)
    with pytest.raises(Exception, match="differs from the manifest"):
        held(spark, path)
    again = {r["shard"]: r for r in publish(df, path).collect()}
    assert {s for s, r in again.items() if r["written"]} == {"s0", "s1", "s3"}
    assert all(again[s]["sha256"] == first[s]["sha256"] for s in first)
    assert held(spark, path) == whole
    assert not any(r["written"] for r in publish(df, path).collect())
    assert not [f for f in os.listdir(path) if f.endswith(".part")]


def test_publishing_refuses_names_that_lead_out(spark, tmp_path):
    df = spark.createDataFrame([("s", "../x", b"1")], "shard string, name string, content binary")
    with pytest.raises(Exception, match="leads out"):
        publish(df, str(tmp_path / "p"))
    assert publish(df.where("false"), str(tmp_path / "q")).count() == 0


def test_ranges_of_small_files_share_tasks():
    from gleaner.sources import tensors as T

    many = [T.Range(f"{i}.npy", str(i), (9, 9, 9, 3), False, "<f8", 128, 4 * k, 4 if k < 2 else 1) for i in range(6000) for k in range(3)]
    tasks = T.bundled(many)
    assert [r for t in tasks for r in t.ranges] == many and len(tasks) < 300
    big = [T.Range("a.npy", "a", (9, 1 << 22), False, "<f8", 128, k, 1) for k in range(9)]
    assert [len(t.ranges) for t in T.bundled(big)] == [1] * 9 and T.bundled([]) == []
