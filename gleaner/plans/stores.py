"""Files behind tables: archives, tensors and published shards, written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.components import cut, shared_folder
from ..registry import query
from ..sources.archives import zip_members, zipped
from ..sources.publish import publish, staged
from ..sources.tables import table
from ..sources.tensors import NpySource
from .color import _NODES, N, _tables
from .grids import R

PACK = 40  #: pages in an archive or shard
MOST = 9  #: members that are taken of an archive
_MEMBER = "CASE WHEN page_id % 5 = 0 THEN 'notes/' || page_id || '.txt' ELSE 'p' || page_id % 3 || '/' || page_id || '.HTML' END"


@query(
    f"""WITH m AS (SELECT page_id // {PACK} AS archive, {_MEMBER} AS member, coalesce(html, '') AS content FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY member, md5(content)) AS k FROM m WHERE lower(member) LIKE '%.html')
    SELECT archive, member, strlen(content)::BIGINT AS size, md5(content) AS digest, 'ok' AS status FROM r WHERE k <= {MOST}"""
)
def archive_members(spark, sf_dir):
    """Pages packed in zips, then each zip's first members of one kind; the limit is the source's."""
    member = F.expr(_MEMBER.replace("page_id ||", "cast(page_id AS string) ||").replace("|| page_id % 3 ||", "|| cast(page_id % 3 AS string) ||").replace("|| page_id %", "|| page_id %"))
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PACK).alias("archive"), member.alias("member"), "html")
    files = cut(zipped(pages, "archive", "member", "html"))
    found = zip_members(files.select(F.col("archive").cast("string").alias("path"), "content"), (".html",), MOST)
    return found.select(F.col("path").cast("long").alias("archive"), "member", "size", F.md5("content").alias("digest"), "status")


@query(f"WITH {_NODES} SELECT 'table-' || lut AS name, r, round(sum(x + 2 * y + 3 * z), 5) AS total, [{N}, {N}, {N}, 3]::VARCHAR AS shape FROM n GROUP BY lut, r")
def tensor_store(spark, sf_dir):
    """Each table as a .npy file, then all files read in ranges of their first axis."""
    spark.dataSource.register(NpySource)
    path = f"{shared_folder(spark)}/tensors-{uuid.uuid4().hex}"
    shape = F.array(*[F.lit(k) for k in (N, N, N, 3)])
    tensors = R.gathered(_tables(spark, sf_dir), "lut", N).select(F.concat(F.lit("table-"), F.col("lut").cast("string")).alias("name"), shape.alias("shape"), "values")
    tensors.write.format("npy").mode("append").save(path)
    rows = spark.read.format("npy").option("rangeBytes", 4 * N * N * 3 * 8).load(path)
    total = F.aggregate(F.transform("values", lambda v, i: v * (i % 3 + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("name", F.col("row").cast("long").alias("r"), F.round(total, 5).alias("total"), F.concat(F.lit("["), F.array_join(F.col("shape").cast("array<string>"), ", "), F.lit("]")).alias("shape"))


@query(f"SELECT page_id // {PACK} AS shard, count(*) AS members, sum(strlen(coalesce(html, '')))::BIGINT AS bytes, md5(string_agg('page-' || page_id || ':' || md5(coalesce(html, '')), ' ' ORDER BY 'page-' || page_id || ':' || md5(coalesce(html, '')))) AS digest FROM pages GROUP BY 1")
def published_shards(spark, sf_dir):
    """Pages published in verified shards, in two runs of which the second redoes nothing, and read back."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    shard = F.floor(F.col("page_id") / PACK)
    files = pages.select(shard.cast("string").alias("shard"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("html").cast("binary").alias("content"))
    publish(files.where(shard % 2 == 0), path)
    publish(files, path)
    back = staged(spark, path)
    line = F.concat("name", F.lit(":"), F.md5("content"))
    return back.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count("*").alias("members"), F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.md5(F.array_join(F.sort_array(F.collect_list(line)), " ").cast("binary")).alias("digest")
    )
