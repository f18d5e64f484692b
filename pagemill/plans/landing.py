"""Readers driven by tables that are written from the given ones and read back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.plans.registry import Tables, query
from pagemill.session import new_folder
from pagemill.sources import tables as R


def _folder(t: Tables, name: str) -> str:
    return new_folder(t._spark, name)  # noqa: SLF001


@query("read_responses", """
  SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS source_id, 200 AS status_code, strlen(html) AS bytes FROM pages WHERE page_id % 4 <> 1""")
def responses(t: Tables):  # noqa: ANN201
    """Pages landed as responses, a quarter of them failed ones."""
    status = F.when(F.col("page_id") % 4 == 1, F.lit(404)).otherwise(F.lit(200))
    landed = t.pages.select(
        U.url_host("url").alias("source_id"), "url", status.alias("status_code"), F.create_map(F.lit("X-Page"), F.col("page_id").cast("string")).alias("headers"),
        F.encode("html", "UTF-8").alias("content"), F.lit("utf-8").alias("encoding"), F.timestamp_seconds(F.lit(1704067200)).alias("fetched_at"),
    )
    path = _folder(t, "responses")
    landed.write.parquet(path)
    back = R.read_responses(t._spark, path)  # noqa: SLF001
    return back.select(F.element_at("headers", "X-Page").cast("long").alias("page_id"), "source_id", "status_code", F.octet_length("content").cast("long").alias("bytes"))


@query("read_rules", """
  SELECT 's' || page_id AS source_id, CASE WHEN page_id % 5 = 3 THEN NULL ELSE 'a[href="' || page_id || '"]' END AS rule,
         CASE page_id % 5 WHEN 1 THEN 'broken' WHEN 3 THEN 'broken' ELSE 'rule' END AS kind FROM pages WHERE page_id % 5 <> 1
  UNION ALL SELECT NULL, NULL, 'broken' FROM pages WHERE page_id % 5 = 1""")
def rules(t: Tables):  # noqa: ANN201
    """One rule line per page; one in five is cut off, one in five lacks its rule: they are rejects, the others are read."""
    k = F.col("page_id")
    rule = F.when(k % 5 != 3, F.concat(F.lit('a[href="'), k.cast("string"), F.lit('"]')))
    whole = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.lit("book").alias("capability"), F.lit("title").alias("field"), rule.alias("rule")))
    path = _folder(t, "rules")
    t.pages.select(F.when(k % 5 == 1, F.left(whole, F.lit(12))).otherwise(whole).alias("value")).write.text(path)
    good, bad = R.read_rules(t._spark, path)  # noqa: SLF001
    kinds = [df.select("source_id", "rule", F.lit(kind).alias("kind")) for df, kind in ((good, "rule"), (bad, "broken"))]
    return kinds[0].unionByName(kinds[1])


@query("read_assets", """
  SELECT 'page-' || page_id || '.png' AS name, strlen(url)::BIGINT AS bytes, md5(url) AS digest FROM pages WHERE page_id % 3 <> 0""")
def assets(t: Tables):  # noqa: ANN201
    """The address of every page as an image file, in folders by host; a third have another suffix and are not assets."""
    path = _folder(t, "assets")

    def put(batches):  # noqa: ANN001, ANN202
        system, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for number, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/{number % 7}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/page-{number}.{'txt' if number % 3 == 0 else 'png'}") as out:
                    out.write(url.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["page_id"])

    t.pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(put, "page_id long").count()
    found = R.read_assets(t._spark, path)  # noqa: SLF001
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.md5("content").alias("digest"))
