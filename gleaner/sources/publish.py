"""Verified shards: files gathered in tar archives, each with its digest, and a marker written last.

A shard counts as published when its marker names the digest that its bytes have.  A restart reads the shards again,
skips the sound ones and redoes those that are missing, torn or changed; the manifest is written when all are sound.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import cut
from .archives import unsafe
from .tensors import opened

MARK = "shard string, sha256 string, bytes long, members long"


def _tar(names, contents) -> bytes:
    """The same bytes for the same members: in order of names, without times or owners."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, content in sorted(zip(names, contents)):
            if unsafe(name):
                raise ValueError(f"a member's name leads out of the folder: {name}")
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, path)


def sound(spark: SparkSession, target: str) -> DataFrame:
    """(shard, sha256, bytes, members) of the shards whose bytes have the digest of their marker."""
    system, path = opened(target)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return spark.createDataFrame([], MARK)
    marks = spark.read.schema(MARK).option("pathGlobFilter", "*.done").json(target)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(target)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.tar$", 1)
    kept = files.select(name.alias("shard"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return marks.join(kept, ["shard", "sha256", "bytes"]).select("shard", "sha256", "bytes", "members")


def publish(files: DataFrame, target: str) -> DataFrame:
    """files (shard, name, content) -> the manifest; writes what is not yet sound, and the manifest after all shards.

    A shard must fit in a task.  A shard whose files changed since is left as it is: give changed content another name.
    """
    spark = files.sparkSession
    system, path = opened(target)
    system.create_dir(path, recursive=True)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        system, path = opened(target)
        shard = part["shard"].iloc[0]
        data = _tar(part["name"], map(bytes, part["content"]))
        mark = {"shard": shard, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "members": len(part)}
        _put(system, f"{path}/{shard}.tar", data)
        _put(system, f"{path}/{shard}.done", json.dumps(mark).encode())
        return pd.DataFrame([mark])

    rows = files.select(F.col("shard").cast("string").alias("shard"), F.col("name").cast("string").alias("name"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    done = cut(sound(spark, target))
    written = cut(rows.join(F.broadcast(done.select("shard")), "shard", "left_anti").groupBy("shard").applyInPandas(write, MARK))
    manifest = cut(sound(spark, target))
    lost = written.join(manifest, ["shard", "sha256"], "left_anti")
    if not lost.isEmpty():
        raise OSError(f"shards are not on disk as written: {[r['shard'] for r in lost.limit(5).collect()]}")
    manifest.orderBy("shard").coalesce(1).write.mode("overwrite").json(f"{target.rstrip('/')}/manifest")
    return manifest.join(written.select("shard", F.lit(True).alias("w")), "shard", "left").select("shard", "sha256", "bytes", "members", F.coalesce("w", F.lit(False)).alias("written"))


def staged(spark: SparkSession, target: str) -> DataFrame:
    """(shard, name, content) of a published folder; a shard that differs from the manifest fails the read."""
    target = target.rstrip("/")
    manifest = spark.read.schema(MARK).json(f"{target}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(target)
    files = files.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.tar$", 1).alias("shard"), "content")

    def run(parts):
        for part in parts:
            for shard, want, content in zip(part["shard"], part["sha256"], part["content"]):
                if content is None or hashlib.sha256(content).hexdigest() != want:
                    raise OSError(f"shard {shard} differs from the manifest")
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile() and not unsafe(member.name):
                            yield pd.DataFrame({"shard": [shard], "name": [member.name], "content": [tar.extractfile(member).read()]})

    return manifest.join(files, "shard", "left").select("shard", "sha256", "content").mapInPandas(run, "shard string, name string, content binary")
