"""URL columns: parts, canonical form, joining, hosts, identity and request keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.core import SPACE, col, let, strip

_SEP = "\x1f"
_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_parts(url: Column) -> Column:
    """scheme, //authority, path, ?query, #fragment as an array of five strings, from one pass of one pattern."""
    return F.split(F.regexp_replace(url, _URL, _SEP.join(f"${i}" for i in range(1, 6))), _SEP)


def url_host(url: Column | str) -> Column:
    """Lower-case host without port; null for templates and for values that are no URLs."""
    text = col(url)
    host = F.lower(F.regexp_extract(text, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return F.when(~F.contains(text, F.lit("{{")) & (host != ""), host)


def request_host(url: Column | str) -> Column:
    """Host the runtime would contact: user info and port removed, lower case, '' when absent."""
    authority = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def _decode(text: Column) -> Column:
    """Form decoding; a percent sign without two hex digits stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Decoded (k, v) pairs of a query string; pairs without '=' have an empty value."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )


def _encode_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def normalize_url(
    url: Column | str,
    params: Column | None = None,
    tracking_prefixes: Iterable[str] = fixed.TRACKING_PREFIXES,
    tracking_keys: Iterable[str] = fixed.TRACKING_KEYS,
) -> Column:
    """Canonical form for identity: case, default port, fragment, tracking parameters, order, trailing slash.

    ``params`` (a map) is merged into the query before it is ordered.
    """
    prefixes, keys = tuple(tracking_prefixes), [F.lit(k) for k in tracking_keys]

    def tracked(pair: Column) -> Column:
        name = F.lower(pair["k"])
        hit = name.isin(*keys)
        for prefix in prefixes:
            hit = hit | F.startswith(name, F.lit(prefix))
        return hit

    def assemble(parts: Column) -> Column:
        scheme = F.lower(F.get(parts, F.lit(0)))
        authority = F.lower(F.get(parts, F.lit(1)))
        path, query = F.get(parts, F.lit(2)), F.substring(F.get(parts, F.lit(3)), F.lit(2), F.lit(2**31 - 1))
        authority = F.when(
            ((scheme == "http") & F.endswith(authority, F.lit(":80")))
            | ((scheme == "https") & F.endswith(authority, F.lit(":443"))),
            F.regexp_replace(authority, ":[0-9]+$", ""),
        ).otherwise(authority)
        path = F.when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise(path)
        path = F.when((F.length(authority) > 2) & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path))\
            .otherwise(path)
        pairs = query_pairs(query)
        if params is not None:
            extra = F.transform(F.map_entries(params), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
            pairs = F.concat(pairs, F.coalesce(extra, F.array().cast("array<struct<k:string,v:string>>")))
        text = _encode_pairs(F.sort_array(F.filter(pairs, lambda p: ~tracked(p))))
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(F.length(authority) > 2, authority).otherwise(""),
            path,
            let(text, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")),
        )

    text = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    return F.when(F.coalesce(col(url), F.lit("")) == "", F.lit("")).otherwise(let(url_parts(text), assemble))


def _resolve_dots(segments: Column) -> Column:
    """'.' and '..' removed from path segments; a trailing one leaves the folder itself (an empty last segment)."""

    def step(acc: Column, seg: Column) -> Column:
        # '..' drops the segment before it, but never the empty one that stands for the root
        shorter = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(seg == "..", shorter).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.slice(segments, 1, 1), step)
    return F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))
    ).otherwise(kept)


def url_join(base: Column | str, ref: Column | str) -> Column:
    """Resolve a reference against a base URL."""
    base_col, ref_col = col(base), strip(ref)

    def with_base(b: Column) -> Column:
        return let(url_parts(ref_col), lambda r: combine(b, r))

    def combine(b: Column, r: Column) -> Column:
        at = lambda parts, i: F.get(parts, F.lit(i))
        folder = F.regexp_replace(at(b, 2), "[^/]*$", "")
        merged = F.when(F.startswith(at(r, 2), F.lit("/")), at(r, 2)).otherwise(
            F.regexp_replace(
                F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), at(r, 2)), "(?<=.)/{2,}", "/"
            )
        )
        path = F.array_join(_resolve_dots(F.split(merged, "/")), "/")
        head = F.concat(at(b, 0), F.lit(":"), at(b, 1))
        own_scheme = (at(r, 0) != "") & ((F.lower(at(r, 0)) != F.lower(at(b, 0))) | (at(r, 1) != ""))
        return (
            F.when(own_scheme, ref_col)
            .when(at(r, 1) != "", F.concat(at(b, 0), F.lit(":"), ref_col))
            .when(
                at(r, 2) == "",
                F.concat(head, at(b, 2), F.when(at(r, 3) != "", at(r, 3)).otherwise(at(b, 3)), at(r, 4)),
            )
            .otherwise(F.concat(head, path, at(r, 3), at(r, 4)))
        )

    return F.when(ref_col == "", base_col).otherwise(let(url_parts(base_col), with_base))


def looks_like_url(value: Column | str) -> Column:
    """Whether a rule value is a URL reference rather than a title: no inner blanks, and a path, scheme or page name."""
    text = strip(value)
    return (
        (text != "")
        & ~text.rlike(SPACE)
        & (
            F.contains(text, F.lit("/"))
            | text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://")
            | text.rlike(r"(?i)^[\p{L}\p{N}_\-.%]+\.(?:x?html?|php\d?|aspx?|jsp|json|xml|txt)$")
        )
    )


def identity_key(source_chapter_id: Column | str, url: Column | str, index: Column | str, title: Column | str) -> Column:
    """sid before url before index and title."""
    sid, link = col(source_chapter_id), col(url)
    return (
        F.when(F.coalesce(sid, F.lit("")) != "", F.concat(F.lit("sid:"), sid))
        .when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("url:"), normalize_url(link)))
        .otherwise(F.concat(F.lit("idx:"), col(index).cast("string"), F.lit(":"), col(title)))
    )


def candidate_keys(
    source_chapter_id: Column | str, url: Column | str, index: Column | str, title: Column | str
) -> Column:
    """Every key a chapter may be matched by, strongest first."""
    sid, link = col(source_chapter_id), col(url)
    strong = F.array_compact(
        F.array(
            F.when(sid != "", F.concat(F.lit("sid:"), sid)),
            F.when(link != "", F.concat(F.lit("url:"), normalize_url(link))),
        )
    )
    return F.when(F.size(strong) > 0, strong).otherwise(
        F.array(F.concat(F.lit("idx:"), col(index).cast("string"), F.lit(":"), col(title)))
    )


def request_key(
    source_id: Column | str,
    method: Column | str,
    url: Column | str,
    params: Column | None = None,
    body: Column | None = None,
    headers: Column | None = None,
    relevant_headers: Iterable[str] = fixed.CACHE_KEY_HEADERS,
) -> Column:
    """One key per logical request: parameter order and tracking do not matter, header values do not enter."""
    pieces = [col(source_id), F.upper(col(method)), normalize_url(url, params=params)]
    if body is not None:
        pieces.append(F.md5(body))
    if headers is not None:
        names = F.transform(F.map_keys(headers), F.lower)
        present = F.filter(F.array(*[F.lit(h) for h in relevant_headers]), lambda h: F.array_contains(names, h))
        flags = F.array_join(F.transform(present, lambda h: F.concat(h, F.lit("=1"))), ",")
        pieces.append(F.nullif(flags, F.lit("")))
    return F.md5(F.concat_ws(_SEP, *pieces))
