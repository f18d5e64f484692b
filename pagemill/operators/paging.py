"""Catalogues that span pages: chains of next links over landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.session import cut_lineage


def follow_pages(starts: DataFrame, links: DataFrame, max_pages: int = fixed.MAX_PAGES) -> DataFrame:
    """The pages of every chain in order: start, url, page_no, and on the last page a stop_reason.

    ``starts``: start (a URL). ``links``: url, next_url (null when the page has none), one row per landed page.
    The chain ends where there is no link (end), the link was visited (loop), the page limit is reached while there
    is another page (limit), or the next page has not landed (not_landed).

    Every page has one next link, so the page n steps ahead is found by doubling: each round joins the jump table with
    itself and extends all chains by as many pages as they have. A limit of 200 pages takes 8 rounds of joins on the
    link, not 200; each round is a checkpoint, and no path is carried along in the rows.
    """
    landed = links.groupBy("url").agg(F.min("next_url").alias("next_url"))
    landed = cut_lineage(landed)
    jump = landed.filter(F.col("next_url").isNotNull()).withColumnRenamed("next_url", "ahead")
    reach = starts.select(F.col("start")).distinct().join(
        landed.select(F.col("url").alias("start")), "start", "left_semi"
    ).select("start", F.col("start").alias("url"), F.lit(1).alias("page_no"))
    step = 1
    while step < max_pages:
        further = (
            reach.join(jump, "url")
            .select("start", F.col("ahead").alias("url"), (F.col("page_no") + step).alias("page_no"))
            .filter(F.col("page_no") <= max_pages)
            .join(landed.select("url"), "url", "left_semi")
        )
        # the first visit of a page counts; a repeat means the chain has closed into a loop
        reach = cut_lineage(
            reach.unionByName(further).groupBy("start", "url").agg(F.min("page_no").alias("page_no"))
        )
        step *= 2
        if step < max_pages:
            far = jump.select(F.col("url").alias("ahead"), F.col("ahead").alias("_far"))
            jump = cut_lineage(jump.join(far, "ahead").select("url", F.col("_far").alias("ahead")))
    return _with_reasons(reach, landed, max_pages)


def _with_reasons(reach: DataFrame, landed: DataFrame, max_pages: int) -> DataFrame:
    last = reach.groupBy("start").agg(F.max_by("url", "page_no").alias("url"), F.max("page_no").alias("page_no"))
    onward = last.join(landed, "url").select("start", "page_no", "next_url")
    seen = reach.select("start", F.col("url").alias("next_url"), F.lit(True).alias("_seen"))
    there = landed.select(F.col("url").alias("next_url"), F.lit(True).alias("_landed"))
    judged = onward.join(seen, ["start", "next_url"], "left").join(there, "next_url", "left")
    reason = (
        F.when(F.col("next_url").isNull(), "end").when(F.col("_seen"), "loop")
        .when(F.col("page_no") >= max_pages, "limit").when(F.col("_landed").isNull(), "not_landed").otherwise("limit")
    )
    return reach.join(judged.select("start", "page_no", reason.alias("stop_reason")), ["start", "page_no"], "left")
