"""Templates, file names and export paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.core import SPACE, blank_to_null, col, let, strip


def template_variables(template: Column | str, pattern: str = fixed.REQUEST_VARIABLE) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(template), F.lit(pattern), F.lit(1)))


def render_template(
    template: Column | str, values: Column, pattern: str = fixed.EXPORT_VARIABLE, keep_unknown: bool = False
) -> Column:
    """Fill ``{{name}}`` from a map column; unknown names become empty, or stay when ``keep_unknown``.

    The text between the placeholders and the placeholder names are two arrays walked in step, so a value that itself
    contains braces is never expanded again.
    """
    text = col(template)
    opaque = pattern.replace("([", "[").replace("]+)", "]+").replace("]*)", "]*")

    def weave(names: Column) -> Column:
        gaps = F.split(text, opaque, -1)
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.array_join(
            F.transform(
                gaps,
                lambda gap, i: F.concat(
                    gap,
                    F.coalesce(
                        F.try_element_at(values, F.get(names, i)),
                        F.get(whole, i) if keep_unknown else F.lit(None).cast("string"),
                        F.lit(""),
                    ),
                ),
            ),
            "",
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), weave)


def unknown_variables(template: Column | str, values: Column, pattern: str = fixed.REQUEST_VARIABLE) -> Column:
    """Names a strict rendering would fail on."""
    names = template_variables(template, pattern)
    return F.filter(names, lambda n: F.try_element_at(values, n).isNull())


def sanitize_component(name: Column | str) -> Column:
    """A safe file name: illegal characters replaced, dots and blanks stripped, reserved names marked, length cut."""
    cleaned = F.btrim(strip(F.regexp_replace(col(name), fixed.ILLEGAL_NAME_CLASS, "_")), F.lit("."))
    cleaned = F.regexp_replace(cleaned, SPACE + "+", " ")

    def finish(text: Column) -> Column:
        reserved = F.upper(F.substring_index(text, ".", 1)).isin(*fixed.RESERVED_NAMES)
        return F.substring(F.when(reserved, F.concat(F.lit("_"), text)).otherwise(text), 1, fixed.MAX_NAME_LENGTH)

    return let(F.coalesce(blank_to_null(cleaned), F.lit("untitled")), finish)


def is_unsafe_component(name: Column | str) -> Column:
    text = col(name)
    return text.isNull() | text.isin("", ".", "..") | text.rlike(r"[/\\\x{00}]")


def book_variables(
    title: Column, author: Column, source_id: Column, source_book_id: Column, latest_chapter: Column, status: Column
) -> Column:
    return F.create_map(
        F.lit("title"), F.coalesce(blank_to_null(title), F.lit("untitled")),
        F.lit("author"), F.coalesce(blank_to_null(author), F.lit("unknown")),
        F.lit("source_id"), source_id.cast("string"),
        F.lit("source_book_id"), source_book_id.cast("string"),
        F.lit("latest_chapter"), F.coalesce(latest_chapter, F.lit("")),
        F.lit("status"), status,
    )


def chapter_variables(book: Column, index: Column, title: Column, chapter_id: Column) -> Column:
    return F.map_concat(
        book,
        F.create_map(
            F.lit("index"), index.cast("string"), F.lit("chapter_title"), title, F.lit("chapter_id"),
            chapter_id.cast("string"),
        ),
    )


def render_filename(values: Column, template: Column | str = fixed.BOOK_NAME_TEMPLATE) -> Column:
    text = F.lit(template) if isinstance(template, str) else template
    return sanitize_component(render_template(text, values))


def export_path(explicit: Column, directory: Column | str, name: Column, suffix: Column | str) -> Column:
    folder = F.lit(directory) if isinstance(directory, str) else directory
    ending = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.coalesce(blank_to_null(explicit), F.concat(folder, F.lit("/"), name, F.lit("."), ending))
