"""Scalars about responses, retries, tasks and records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed
from pagemill.functions.core import blank_to_null, col, literal_map, strip


def retry_delay(
    attempt: Column | str,
    retry_after: Column | None = None,
    base: float = fixed.RETRY_BASE_SECONDS,
    ceiling: float = fixed.RETRY_MAX_SECONDS,
    jitter: float = 0.0,
    seed: int = 0,
) -> Column:
    """Seconds to wait: the server's wish capped, else an exponential curve capped; jitter is a seeded spread."""
    curve = F.least(F.lit(base) * F.pow(F.lit(2.0), col(attempt)), F.lit(ceiling))
    if jitter:
        curve = F.greatest(F.lit(0.0), curve * (1 + (2 * F.rand(seed) - 1) * jitter))
    if retry_after is None:
        return curve
    return F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(ceiling))).otherwise(curve)


def parse_retry_after(value: Column | str) -> Column:
    """Seconds only; dates and anything else are null."""
    text = strip(value)
    return F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))


def is_retryable(
    code: Column | str, status_code: Column | str, attempt: Column | str, max_retries: int = fixed.RETRY_MAX
) -> Column:
    """Network trouble, 429 and server errors may be tried again while attempts are left."""
    kind, status = col(code), col(status_code)
    by_status = F.coalesce((status >= 500) | (status == 429), F.lit(False))
    by_code = F.coalesce(kind.isin(*fixed.RETRYABLE_CODES), F.lit(False))
    return (col(attempt) < max_retries) & F.when(kind == "NETWORK_HTTP_STATUS", by_status).otherwise(by_code)


def task_progress(completed: Column | str, failed: Column | str, total: Column | str) -> Column:
    whole = col(total)
    share = F.try_divide((col(completed) + col(failed)).cast("double"), whole)
    return F.when(whole <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), share))


def expires_at(created_at: Column | str, ttl_seconds: Column | int = fixed.CACHE_TTL_SECONDS) -> Column:
    seconds = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
    return col(created_at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def is_expired(expiry: Column | str, now: Column) -> Column:
    return col(expiry) <= now


def redact_map(values: Column | str, keys: Iterable[str] = fixed.SENSITIVE_KEYS) -> Column:
    """Mask the values of sensitive keys, whatever their case."""
    hidden = [k.lower() for k in keys]
    return F.transform_values(col(values), lambda k, v: F.when(F.lower(k).isin(*hidden), F.lit("***")).otherwise(v))


def redact_struct(schema: T.StructType, keys: Iterable[str] = fixed.SENSITIVE_KEYS, prefix: str = "") -> list[Column]:
    """Columns of a record with sensitive fields masked at any depth; records and string maps are walked."""
    hidden = {k.lower() for k in keys}
    out = []
    for field in schema.fields:
        path = f"{prefix}`{field.name}`"
        value = F.col(path)
        if field.name.lower() in hidden:
            value = F.lit("***")
        elif isinstance(field.dataType, T.StructType):
            inner = F.struct(*redact_struct(field.dataType, keys, path + "."))
            value = F.when(value.isNotNull(), inner)
        elif isinstance(field.dataType, T.MapType) and isinstance(field.dataType.valueType, T.StringType):
            value = redact_map(value, keys)
        out.append(value.alias(field.name))
    return out


def detect_charset(content: Column | str, headers: Column) -> Column:
    """Response header, then meta tags in the first 4096 bytes, then utf-8; GB2312 and GBK are read as GB18030."""
    content_type = F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "content-type"), F.lit(0))["value"]
    announced = F.when(
        F.contains(content_type, F.lit("charset=")),
        F.substring_index(F.substring_index(content_type, "charset=", -1), ";", 1),
    )
    head = F.decode(F.substring(col(content), 1, fixed.CHARSET_PROBE_BYTES), "ISO-8859-1")
    found = [
        blank_to_null(F.btrim(F.lower(strip(candidate)), F.lit("\"'")))
        for candidate in (
            announced,
            F.regexp_extract(head, fixed.META_CHARSET, 1),
            F.regexp_extract(head, fixed.META_CONTENT_CHARSET, 1),
        )
    ]
    name = F.coalesce(*found, F.lit("utf-8"))
    return F.coalesce(F.try_element_at(literal_map(fixed.CHARSET_PROMOTIONS), name), name)


@F.pandas_udf(T.StringType())
def _decode_rare(content, charset):  # noqa: ANN001, ANN202
    def one(body: bytes | None, name: str) -> str | None:
        if body is None:
            return None
        try:
            return body.decode(name, errors="replace")
        except LookupError:
            return body.decode("utf-8", errors="replace")

    return content.combine(charset, one) if len(content) else content.astype("object")


def decode_body(content: Column | str, charset: Column | str, rare_charsets: bool = True) -> Column:
    """Decode with bad bytes replaced. UTF-8 and Latin-1 stay in the JVM; only other charsets reach Python,
    and the bodies of the first two are not sent there."""
    body, name = col(content), F.lower(col(charset))
    utf8 = name.isin("utf-8", "utf8", "us-ascii", "ascii")
    latin = name.isin("iso-8859-1", "latin-1", "latin1")
    native = F.when(utf8, F.make_valid_utf8(body.cast("string"))).when(latin, F.decode(body, "ISO-8859-1"))
    if not rare_charsets:
        return native
    return F.coalesce(native, _decode_rare(F.when(~utf8 & ~latin, body), name))


def asset_suffix(url: Column | str, content_type: Column | str) -> Column:
    """Image suffix from the content type, else from the URL path; null when neither names a known image type."""
    kind = F.lower(strip(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1)))
    ending = F.lower(F.regexp_extract(F.substring_index(col(url), "?", 1), r"[^/.](\.[^./]+)$", 1))
    return F.coalesce(
        F.try_element_at(literal_map(fixed.CONTENT_TYPE_SUFFIX), kind),
        F.when(ending.isin(*fixed.ASSET_SUFFIXES), ending),
    )
