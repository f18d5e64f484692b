"""The ten value transforms of the rule language, for transform lists that are data and for lists known up front."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.core import col, fold_space, let, strip
from pagemill.functions.urls import looks_like_url, url_join

STEP = "op: string, pattern: string, replacement: string, value: string, separator: string"
STEPS = f"array<struct<{STEP}>>"
OPS = (
    "trim", "replace", "regex_replace", "join", "prepend", "append", "url_join", "default", "remove_html",
    "normalize_whitespace",
)
# Common entities first to last; the ampersand goes last so that nothing is decoded twice.
ENTITIES = (
    ("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&times;", "×"), ("&bull;", "•"), ("&amp;", "&"),
)


# The standard table of named references comes with Python; names that are valid without a semicolon are matched by prefix.
_NAMED = "\x1e".join(f"{k}\x1f{v}" for k, v in html.entities.html5.items())
_SHORT = "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True))
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What the bytes 128 to 159 mean in numeric references, and code points that give nothing.
_WINDOWS = bytes(range(128, 160)).decode("cp1252", "replace")
_NOTHING = r"^(?:[1-8]|1[4-9]|2[0-9]|3[01]|12[7-9]|1[34][0-9]|15[0-9]|11)$"


def _numeric(reference: Column) -> Column:
    """The character of a numeric reference; unusable numbers give the replacement character, control codes nothing."""
    digits = F.regexp_replace(F.regexp_extract(reference, r"^&#[xX]?0*([0-9a-fA-F]*)", 1), "^$", "0")
    base16 = F.substring(F.lower(reference), 3, 1) == "x"
    number = F.when(F.length(digits) > 8, F.lit("99999999")).when(base16, F.conv(digits, 16, 10)).otherwise(digits).cast("long")

    def character(n: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        plane_end = (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE) | n.between(0xFDD0, 0xFDEF)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n == 13, "\r")
            .when(n.between(128, 159), F.substring(F.lit(_C1), (n - 127).cast("int"), F.lit(1)))
            .when(n.cast("string").rlike(_NOTHING) | plane_end, "")
            .otherwise(wide)
        )

    return let(number, character)


# as the table above, but the five bytes without a meaning stay control characters
_C1 = "".join(c if c != "\ufffd" else chr(128 + k) for k, c in enumerate(_WINDOWS))


def _decoded(reference: Column) -> Column:
    named = F.str_to_map(F.lit(_NAMED), F.lit("\x1e"), F.lit("\x1f"))
    name = F.substring(reference, 2, 40)
    short = F.regexp_extract(name, f"^(?:{_SHORT})", 0)
    by_prefix = F.when(short != "", F.concat(F.element_at(named, short), F.substring(name, F.length(short) + 1, F.lit(40))))
    return F.when(F.startswith(reference, F.lit("&#")), _numeric(reference)).otherwise(F.coalesce(F.element_at(named, name), by_prefix, reference))


def _unescape_all(text: Column) -> Column:
    """Every reference once: the text is cut at references and put together with what they stand for."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), _decoded)
    pieces = F.split(text, _REFERENCE, -1)
    return F.array_join(F.zip_with(pieces, found, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


# Names that are complete with their semicolon though a shorter one of them is valid without.
_WHOLE = "|".join(sorted(k for k in html.entities.html5 if re.match(f"(?:{_SHORT}).*;$", k)))
_CUT = rf"&(?!amp|(?:{_WHOLE}))(?=#[0-9]+(?![0-9;])|#[xX][0-9a-fA-F]+(?![0-9a-fA-F;])|{_SHORT})"


def cut_references_as_text(markup: Column | str) -> Column:
    """Markup in which references without their semicolon, other than ``&amp``, are text: their ampersand is written out, so that
    a parser, which takes ``&quot`` for a quotation mark, leaves them as they stand."""
    return F.regexp_replace(col(markup), _CUT, "&amp;")


def unescape_entities(value: Column | str) -> Column:
    """References to characters. The common ones are replaced directly; a text that holds others is taken apart."""
    text = col(value)
    plain = text
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    unusual = text.rlike(r"&(?!(?:" + "|".join(e[1:-1] for e, _ in ENTITIES) + r");)[#A-Za-z]")
    return F.when(unusual, _unescape_all(text)).when(F.contains(text, F.lit("&")), plain).otherwise(text)


def remove_html(value: Column | str) -> Column:
    """Line breaks for <br> and closing blocks, then no tags, then no entities."""
    text = F.regexp_replace(col(value), r"(?i)<\s*br\s*/?\s*>", "\n")
    text = F.regexp_replace(text, r"(?i)</\s*(?:p|div|li|tr|h[1-6]|blockquote|section|article)\s*>", "\n")
    return unescape_entities(F.regexp_replace(text, "<[^>]+>", ""))


def to_java_replacement(text: str) -> str:
    r"""``\1`` and ``\g<1>`` become ``$1``; a dollar sign is literal."""
    return re.sub(r"\\(?:g<)?(\d+)>?", r"$\1", text.replace("$", r"\$"))


def _java_replacement(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("$"), F.lit("\\$")), r"\\(?:g<)?(\d+)>?", r"\$$1")


def apply_transforms(value: Column | str, steps: Iterable[str | Mapping], base_url: Column | None = None) -> Column:
    """Fold a list known up front into one expression. A step is an op name or ``{"op": ..., ...}``."""
    current = col(value)
    for raw in steps:
        step = {"op": raw} if isinstance(raw, str) else dict(raw)
        op = step["op"]
        if op not in OPS:
            raise ValueError(f"unknown transform {op!r}")
        if op in ("replace", "regex_replace") and step.get("pattern") is None:
            raise ValueError(f"{op} needs a pattern")
        given = F.lit(step.get("value") or "")
        if op == "trim":
            current = strip(current)
        elif op == "normalize_whitespace":
            current = fold_space(current)
        elif op == "remove_html":
            current = remove_html(current)
        elif op == "replace":
            current = F.replace(current, F.lit(step["pattern"]), F.lit(step.get("replacement") or ""))
        elif op == "regex_replace":
            current = F.regexp_replace(current, step["pattern"], to_java_replacement(step.get("replacement") or ""))
        elif op == "prepend":
            current = F.concat(given, F.coalesce(current, F.lit("")))
        elif op == "append":
            current = F.concat(F.coalesce(current, F.lit("")), given)
        elif op == "default":
            current = F.coalesce(F.nullif(current, F.lit("")), F.lit(step.get("value")))
        elif op == "url_join":
            if base_url is None:
                raise ValueError("url_join needs a base URL")
            current = F.when(looks_like_url(current), url_join(base_url, current)).otherwise(current)
    return current


def apply_transform_column(value: Column, steps: Column, base_url: Column) -> Column:
    """Run a transform list that is itself data: one generic expression, whatever the number of rules."""

    def run(current: Column, step: Column) -> Column:
        op, given = step["op"], F.coalesce(step["value"], F.lit(""))
        filled, put = F.coalesce(current, F.lit("")), F.coalesce(step["replacement"], F.lit(""))
        return (
            F.when(op == "trim", strip(current))
            .when(op == "normalize_whitespace", fold_space(current))
            .when(op == "remove_html", remove_html(current))
            .when(op == "replace", F.replace(current, step["pattern"], put))
            .when(op == "regex_replace", F.regexp_replace(current, step["pattern"], _java_replacement(put)))
            .when(op == "prepend", F.concat(given, filled))
            .when(op == "append", F.concat(filled, given))
            .when(op == "default", F.coalesce(F.nullif(current, F.lit("")), step["value"]))
            .when(
                (op == "url_join") & F.coalesce(looks_like_url(current), F.lit(False)), url_join(base_url, current)
            )
            .otherwise(current)
        )

    return F.aggregate(F.coalesce(steps, F.array().cast(STEPS)), value, run)


def join_values(values: Column, separator: Column | str = "") -> Column:
    """The documented list form of ``join``."""
    return F.array_join(values, separator) if isinstance(separator, str) else F.concat_ws(separator, values)
