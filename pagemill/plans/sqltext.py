"""Pieces of DuckDB SQL that spell out the column functions, for the comparison queries."""

from __future__ import annotations

from pagemill import fixed
from pagemill.functions.core import SPACE_CHARS, SPACE_CLASS

LF = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def rep(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


def fold(x: str) -> str:
    return strip(rep(x, SPACE_CLASS + "+", "' '"))


def content_hash(x: str) -> str:
    return f"md5({fold(x)})"


def lines(x: str) -> str:
    return f"list_transform(string_split({x}, {LF}), lambda ln: {strip('ln')})"


def squeeze(x: str) -> str:
    return strip(rep(x, r"\n{3,}", f"{LF} || {LF}"))


JUNK = "^(?:" + "|".join(f"(?:{'(?i:' + p[4:] + ')' if p.startswith('(?i)') else p})" for p in fixed.JUNK_LINE_PATTERNS) + ")"


def clean(x: str) -> str:
    tagged = f"CASE WHEN contains({x}, '<') AND contains({x}, '>') THEN {rep(x, '<[^>]+>')} ELSE {x} END"
    plain = f"replace(replace({tagged}, '&nbsp;', ' '), '&amp;', '&')"
    plain = rep(plain, r"[\x{a0}\x{3000}]", "' '")
    plain = rep(plain, fixed.ZERO_WIDTH_CLASS + "|" + fixed.CONTROL_CLASS)
    kept = f"list_filter({lines(plain)}, lambda ln: NOT regexp_matches(ln, {lit(JUNK)}))"
    return squeeze(f"array_to_string({kept}, {LF})")


def normalize(x: str) -> str:
    lined = rep(f"replace({x}, chr(13) || {LF}, {LF})", r"[\r\n]", LF)
    folded = rep(lined, r"[ \t\f\x{0b}\x{3000}]+", "' '")
    return squeeze(f"array_to_string({lines(folded)}, {LF})")


def paragraphs(x: str) -> str:
    """``x`` must be normalised already."""
    cut = f"CASE WHEN contains({x}, {LF} || {LF}) THEN string_split({x}, {LF} || {LF}) ELSE string_split({x}, {LF}) END"
    return f"list_filter(list_transform({cut}, lambda p: {strip('p')}), lambda p: p <> '')"


def count_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def words(x: str) -> str:
    return f"({count_matches(x, fixed.CJK_CLASS)} + {count_matches(x, '[A-Za-z0-9]+')})"


def script_ratio(x: str, script: str) -> str:
    solid = f"(length({x}) - {count_matches(x, SPACE_CLASS)})"
    return f"CASE WHEN {solid} = 0 THEN 0.0 ELSE {count_matches(x, script)} / {solid} END"


def repeat_ratio(x: str) -> str:
    ls = f"list_filter({lines(x)}, lambda ln: ln <> '')"
    return (
        f"(WITH l AS (SELECT unnest({ls}) AS ln), g AS (SELECT count(*) AS c FROM l GROUP BY ln) "
        f"SELECT CASE WHEN coalesce(sum(c), 0) < 3 THEN 0.0 "
        f"ELSE coalesce(sum(c) FILTER (WHERE c > 1), 0)::DOUBLE / sum(c) END FROM g)"
    )


def gate(table: str, text: str, low: str, high: str, script: str, script_min: str, repeat_max: str) -> str:
    """SELECT giving every row of ``table`` plus reason, measure, threshold."""
    return f"""
      SELECT *, CASE WHEN {strip(text)} = '' THEN 'empty' WHEN n < {low} THEN 'too_short' WHEN n > {high} THEN 'too_long'
                     WHEN sr < {script_min} THEN 'low_script_ratio' WHEN rr > {repeat_max} THEN 'high_repeat_ratio' END AS reason
      FROM (SELECT *, length({text}) AS n, {script_ratio(text, script)} AS sr, {repeat_ratio(text)} AS rr FROM {table})"""


# --- URLs ---------------------------------------------------------------------------------------------------------
_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TRACKED = "^(?:(?:" + "|".join(fixed.TRACKING_PREFIXES) + ").*|" + "|".join(fixed.TRACKING_KEYS) + ")$"


def normalize_url(u: str) -> str:
    part = lambda i: f"regexp_extract({u}, {lit(_URL)}, {i})"
    enc = lambda t: f"replace(url_encode({t}), '%20', '+')"
    dec = lambda t: f"url_decode(replace({t}, '+', ' '))"
    host = rep(f"CASE WHEN lower({part(1)}) IN ('http', 'https') THEN lower({part(1)}) || '|' || lower({part(2)}) ELSE lower({part(2)}) END",
               r"^(?:http\|(.*):80|https\|(.*):443|https?\|(.*))$", r"'\1\2\3'")
    path = f"CASE WHEN length({part(3)}) > 1 THEN rtrim({part(3)}, '/') ELSE {part(3)} END"
    pairs = (f"list_transform(list_filter(string_split({part(4)}, '&'), lambda p: p <> ''), "
             f"lambda p: {{'k': {dec('''string_split(p, '=')[1]''')}, 'v': {dec('''regexp_replace(p, '^[^=]*=?', '')''')}}})")
    kept = f"list_sort(list_filter({pairs}, lambda p: NOT regexp_matches(lower(p.k), {lit(TRACKED)})))"
    query = f"array_to_string(list_transform({kept}, lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&')"
    return (f"(CASE WHEN coalesce({u}, '') = '' THEN '' ELSE CASE WHEN {part(1)} <> '' THEN lower({part(1)}) || ':' ELSE '' END || "
            f"CASE WHEN {part(2)} <> '' THEN '//' || {host} ELSE '' END || {path} || "
            f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END)")


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1))"
