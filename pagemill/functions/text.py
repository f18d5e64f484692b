"""Text columns: cleaning, normalising, measuring and hashing."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.core import SPACE, col, count_chars, fold_space, let, literal_map, strip

HASH_ALGORITHM = "md5"


def content_hash(text: Column | str) -> Column:
    """128-bit digest of the text with white space folded; equal texts up to white space get equal hashes."""
    return F.md5(fold_space(text))


def content_changed(text: Column | str, known_hash: Column | str) -> Column:
    return ~content_hash(text).eqNullSafe(col(known_hash))


def junk_pattern(patterns: Iterable[str]) -> str:
    """One anchored alternation from a list of whole-line patterns; ``.`` and ``$`` only know the line feed."""
    return "(?d)^(?:" + "|".join(f"(?:{_scoped(p)})" for p in patterns) + ")"


def _scoped(pattern: str) -> str:
    return f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else pattern


def usable_patterns(patterns: Iterable[str]) -> list[str]:
    """The patterns that Java compiles, named groups rewritten; one that does not is reported and left out, so that a bad
    argument never fails the job."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    context, kept = SparkContext._active_spark_context, []
    for pattern in patterns:
        java = pattern.replace("(?P<", "(?<")
        try:
            context._jvm.java.util.regex.Pattern.compile(junk_pattern([java])) if context else re.compile(pattern)
        except (IllegalArgumentException, re.error):
            warnings.warn(f"junk pattern ignored: {pattern!r}", stacklevel=2)
        else:
            kept.append(java)
    return kept


def clean_text(
    text: Column | str,
    extra_junk: Iterable[str] = (),
    junk: Iterable[str] = fixed.JUNK_LINE_PATTERNS,
) -> Column:
    """Drop tags, invisible characters and junk lines; strip every line; keep at most one blank line. Extra patterns that
    cannot be compiled are ignored."""
    raw = col(text)
    tagged = F.contains(raw, F.lit("<")) & F.contains(raw, F.lit(">"))
    plain = F.when(tagged, F.regexp_replace(raw, "<[^>]+>", "")).otherwise(raw)
    for mark, by in (("&nbsp;", " "), ("&amp;", "&"), ("\xa0", " "), ("\u3000", " ")):
        plain = F.replace(plain, F.lit(mark), F.lit(by))
    plain = F.regexp_replace(plain, _INVISIBLE, "")
    lines = F.transform(F.split(plain, "\n"), strip)
    patterns = [*junk, *usable_patterns(extra_junk)]
    if patterns:
        lines = F.filter(lines, lambda line: ~line.rlike(junk_pattern(patterns)))
    return let(F.array_join(lines, "\n"), lambda joined: strip(_one_blank_line(joined)))


# Printable ASCII and the Latin to Indic blocks are ruled out first, so most characters cost one comparison.
_INVISIBLE = f"[[^ -~\\x{{80}}-\\x{{200a}}]&&{fixed.ZERO_WIDTH_CLASS[:-1]}{fixed.CONTROL_CLASS[1:]}]"
_BLANKS = r"[ \t\f\x{0b}\x{3000}]+"


def _one_blank_line(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)


def normalize_text(text: Column | str) -> Column:
    """One newline style, inline blanks folded, lines stripped, at most one blank line. Idempotent.

    The regex passes are guarded by substring tests, which are far cheaper and fail on most texts.
    """
    lined = F.replace(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def fold(body: Column) -> Column:
        needed = F.contains(body, F.lit("  "))
        for mark in "\t\f\x0b\u3000":
            needed = needed | F.contains(body, F.lit(mark))
        folded = F.when(needed, F.regexp_replace(body, _BLANKS, " ")).otherwise(body)
        return F.array_join(F.transform(F.split(folded, "\n"), strip), "\n")

    return F.coalesce(let(let(lined, fold), lambda body: strip(_one_blank_line(body))), F.lit(""))


def split_paragraphs(text: Column | str) -> Column:
    """Paragraphs of the normalised text: blank lines separate them, or single newlines when there are none."""

    def cut(body: Column) -> Column:
        pieces = F.when(F.contains(body, F.lit("\n\n")), F.split(body, "\n\n")).otherwise(F.split(body, "\n"))
        return F.filter(F.transform(pieces, strip), lambda p: p != "")

    return let(normalize_text(text), cut)


def count_words(text: Column | str) -> Column:
    """CJK characters plus runs of ASCII letters and digits."""
    body = F.coalesce(col(text), F.lit(""))
    return count_chars(body, fixed.CJK_CLASS) + F.regexp_count(body, F.lit("[A-Za-z0-9]+"))


def script_ratio(text: Column | str, script: str = fixed.CJK_CLASS) -> Column:
    """Share of ``script`` characters among the characters that are not white space; 0 when there are none."""
    body = col(text)
    solid = F.length(body) - F.regexp_count(body, F.lit(SPACE))
    return F.coalesce(F.try_divide(count_chars(body, script), solid), F.lit(0.0))


def repeat_line_ratio(text: Column | str) -> Column:
    """Lines that occur more than once over non-empty lines; 0 below three lines.

    The lines of one text are sorted, so equal lines are neighbours: n log n in the row, not n squared.
    """
    lines = F.filter(F.transform(F.split(col(text), "\n"), strip), lambda line: line != "")

    def ratio(ordered: Column) -> Column:
        repeated = F.filter(
            ordered,
            lambda line, i: line.eqNullSafe(F.get(ordered, i - 1)) | line.eqNullSafe(F.get(ordered, i + 1)),
        )
        return F.when(F.size(ordered) < 3, F.lit(0.0)).otherwise(F.size(repeated) / F.size(ordered))

    return let(F.array_sort(lines), ratio)


def parse_status(value: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Whole-value lookup, case and outer blanks ignored; everything else is unknown."""
    table = literal_map(aliases or fixed.STATUS_ALIASES)
    return F.coalesce(F.try_element_at(table, F.lower(strip(value))), F.lit("unknown"))


def fold_ascii_case(value: Column | str) -> Column:
    return F.translate(col(value), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_keyword(text: Column | str, keyword: Column | str) -> Column:
    """Literal substring, ASCII case ignored; an empty keyword matches nothing.

    Written as LIKE over the escaped keyword only where a pattern is needed elsewhere; ``contains`` needs no escape.
    """
    needle = F.lit(keyword) if isinstance(keyword, str) else keyword
    return (needle != "") & F.contains(fold_ascii_case(text), fold_ascii_case(needle))


def escape_like(value: Column | str) -> Column:
    return F.regexp_replace(col(value), r"([\\%_])", r"\\$1")


def make_snippet(text: Column | str, keyword: Column | str, context: int = 30, ignore_case: bool = True) -> Column:
    """The first hit with ``context`` characters on each side, an ellipsis where the text was cut."""
    body = col(text)
    needle = F.lit(keyword) if isinstance(keyword, str) else keyword
    haystack, wanted = (fold_ascii_case(body), fold_ascii_case(needle)) if ignore_case else (body, needle)

    def cut(at: Column) -> Column:
        begin = F.greatest(F.lit(0), at - 1 - context)
        end = F.least(F.length(body), at - 1 + F.length(needle) + context)
        middle = strip(F.substring(body, begin + 1, end - begin))
        return F.when(at == 0, strip(F.substring(body, F.lit(1), F.lit(2 * context)))).otherwise(
            F.concat(
                F.when(begin > 0, "…").otherwise(""), middle, F.when(end < F.length(body), "…").otherwise("")
            )
        )

    return let(F.position(wanted, haystack), cut)
