"""The response cache as a table: key, source_id, url, size_bytes, created_at, expires_at, accessed_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.values import expires_at


def reusable(responses: DataFrame, now: Column | None = None) -> DataFrame:
    """Bodies that may be served again: status 200 and, given a time, not expired."""
    kept = responses.filter(F.col("status_code") == 200)
    return kept if now is None else kept.filter(F.col("expires_at") > now)


def with_expiry(responses: DataFrame, page_kind: str | None = None) -> DataFrame:
    """Expiry from the time to live of the page kind: long for chapter bodies, short for the rest."""
    ttl = F.lit(fixed.CACHE_TTL_SECONDS)
    if page_kind:
        ttl = F.when(F.col(page_kind) == "content", fixed.CACHE_CONTENT_TTL_SECONDS).otherwise(ttl)
    return responses.withColumn("expires_at", expires_at("created_at", ttl))


def cache_stats(cache: DataFrame, max_size_bytes: int = 0) -> DataFrame:
    return cache.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.lit(max_size_bytes).cast("long").alias("max_size_bytes"),
    )


def purge_expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def touch_access(cache: DataFrame, reads: DataFrame, by: str = "key") -> DataFrame:
    """Fold a read log (key, read_at) in: reads are reduced to the last per key first, and the access time moves only
    when the known one is at least an hour old. Reads of expired rows do not count. ``by`` names the column that tells
    entries apart, where several may share a key."""
    last = reads.groupBy(by).agg(F.max("read_at").alias("_read"))
    stale = F.col("_read") >= F.col("accessed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(fixed.ACCESS_REFRESH_SECONDS))
    valid = F.col("_read") < F.col("expires_at")
    moved = F.when(stale & valid, F.col("_read")).otherwise(F.col("accessed_at"))
    return cache.join(last, by, "left").withColumn("accessed_at", moved).drop("_read")


def invalidate(cache: DataFrame, source_id: str | None = None, url: str | None = None) -> DataFrame:
    """Drop one link of a source, a whole source, or everything."""
    if source_id is None:
        return cache.limit(0)
    hit = F.col("source_id") == source_id
    if url is not None:
        hit = hit & (F.col("url") == url)
    return cache.filter(~hit)


def invalidate_many(cache: DataFrame, targets: DataFrame) -> DataFrame:
    """Batch form: ``targets`` has source_id and url, a null url stands for the whole source."""
    links = targets.filter(F.col("url").isNotNull()).select("source_id", "url").distinct()
    whole = targets.filter(F.col("url").isNull()).select("source_id").distinct()
    return cache.join(links, ["source_id", "url"], "left_anti").join(whole, "source_id", "left_anti")


NEVER = "1900-01-01 00:00:00"


# --- capacity -----------------------------------------------------------------------------------------------------
def _fall(entries: DataFrame, digit: Column, need: int) -> tuple | None:
    """The value of ``digit`` in which the running size reaches ``need``, and what is still needed inside it."""
    sums = entries.groupBy(digit.alias("d")).agg(F.sum("size_bytes").alias("s"))
    upto = F.sum("s").over(Window.orderBy("d"))
    row = sums.select("d", "s", upto.alias("u")).filter(F.col("u") >= need).orderBy("d").first()
    return None if row is None else (row["d"], need - row["u"] + row["s"])


def evict_lru(cache: DataFrame, max_size_bytes: int) -> DataFrame:
    """Oldest access first until the total fits; returns the cache with an ``evicted`` flag. 0 means no limit.

    The order is (accessed_at, digest of the key). The cut-off is found digit by digit, like selecting the k-th
    element: sizes are summed per day, then per second of the day in which the limit falls, per microsecond of that
    second, and per digest where access times are equal. Each step aggregates map-side into at most a million groups,
    reads only the entries of the value found before (a pushed-down time range) and brings one row to the driver. No
    ordered pass over all entries takes place; the flag is a comparison with the cut-off. An entry without an access time is
    the oldest.
    """
    kept = F.lit(False)
    if max_size_bytes <= 0:
        return cache.withColumn("evicted", kept)
    at = F.coalesce("accessed_at", F.lit(NEVER).cast("timestamp"))
    entries = cache.select("size_bytes", at.alias("accessed_at"), F.coalesce("key", F.lit("")).alias("key"))
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    need = total - max_size_bytes
    if need <= 0:
        return cache.withColumn("evicted", kept)
    start = 0
    for finer in (86_400_000_000, 1_000_000, 1):
        digit, need = _fall(entries, F.expr(f"floor((unix_micros(accessed_at) - {start}) / {finer}D)"), need)
        start += digit * finer
        span = [F.timestamp_micros(F.lit(edge)) for edge in (start, start + finer)]
        entries = entries.filter((F.col("accessed_at") >= span[0]) & (F.col("accessed_at") < span[1]))
    digest = F.md5("key")
    group, need = _fall(entries, F.substring(digest, 1, 5), need)
    last, _ = _fall(entries.filter(F.startswith(digest, F.lit(group))), digest, need)
    edge, digest = F.timestamp_micros(F.lit(start)), F.md5(F.coalesce("key", F.lit("")))
    return cache.withColumn("evicted", (at < edge) | ((at == edge) & (digest <= last)))


def enforce_capacity(cache: DataFrame, max_size_bytes: int) -> DataFrame:
    return evict_lru(cache, max_size_bytes).filter(~F.col("evicted")).drop("evicted")
