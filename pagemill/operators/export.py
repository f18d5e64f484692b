"""Books as text, Markdown and e-book parts.

A book is never gathered into one row: every operator returns ordered pieces (book_id, part, ord, content) whose
concatenation in order is the file. The sinks write them range-sorted, so a book that is a third of all text is written
by many tasks into consecutive files of its folder. What a piece must know about the rest of its book (is it the last
one, which number does it have) comes from aggregates and prefix sums per book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.core import SPACE_CHARS, blank_to_null, col, literal_map
from pagemill.functions.naming import book_variables, render_template
from pagemill.functions.text import split_paragraphs
from pagemill.operators.ordered import row_numbers

_BODY_COLUMNS = ("book_id", "part", "ord", "content")
INDEX_WIDTH = 10_000

#: The look of the e-book; nothing else depends on it.
STYLE = """\
@page { margin: 6%; }
html { color: #1d1d1b; background: #fffefb; }
body > * { max-width: 36em; margin-left: auto; margin-right: auto; }
h1, h2 { line-height: 1.2; break-after: avoid; }
p { margin-top: 0; margin-bottom: 0; hyphens: auto; }
p + p { text-indent: 1.4em; }
.cover img { display: block; width: auto; max-height: 96vh; }
"""


def escape_xml(text: Column | str) -> Column:
    out = col(text)
    for char, entity in fixed.XML_ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def resolve_format(name: Column | str) -> Column:
    """txt, markdown (or md), epub; anything else is null and thus a reject."""
    text = F.lower(col(name))
    return F.when(text == "md", "markdown").when(text.isin(*fixed.EXPORT_FORMATS), text)


def _trim_ends(pieces: DataFrame) -> DataFrame:
    """Strip the file as a whole and end it with one newline: only the first and the last piece change."""
    ends = pieces.groupBy("book_id").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
    white = F.lit(SPACE_CHARS)
    content = F.col("content")
    content = F.when(F.col("ord") == F.col("_first"), F.ltrim(content, white)).otherwise(content)
    content = F.when(F.col("ord") == F.col("_last"), F.concat(F.rtrim(content, white), F.lit("\n"))).otherwise(content)
    return pieces.join(ends, "book_id").withColumn("content", content).select(*_BODY_COLUMNS)


def _pieces(books: DataFrame, header: Column, chapters: DataFrame, body: Column, part: str) -> DataFrame:
    head = books.select(F.col("id").alias("book_id"), F.lit(part).alias("part"), F.lit(-1).cast("long").alias("ord"), header.alias("content"))
    known = books.select(F.col("id").alias("book_id"))
    rest = chapters.join(known, "book_id", "left_semi").select(
        "book_id", F.lit(part).alias("part"), F.col("index").cast("long").alias("ord"), body.alias("content")
    )
    return _trim_ends(head.unionByName(rest))


def export_txt(books: DataFrame, chapters: DataFrame, include_header: bool = True) -> DataFrame:
    """Header, then per chapter title, body and a rule. Books: id, title, author, intro; chapters: book_id, index
    (0 or more, unique per book), title, content."""
    rule = F.lit("\n\n" + fixed.TXT_RULE + "\n\n")
    header = F.concat(
        F.col("title"),
        F.coalesce(F.concat(F.lit("\n" + fixed.AUTHOR_LABEL), blank_to_null("author")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\n"), blank_to_null("intro")), F.lit("")),
        rule,
    )
    body = F.concat(F.col("title"), F.lit("\n\n"), F.coalesce("content", F.lit("")), rule)
    if include_header:
        return _pieces(books, header, chapters, body, "book.txt")
    pieces = _pieces(books, F.lit(""), chapters, body, "book.txt")
    return _trim_ends(pieces.filter(F.col("ord") >= 0))


def export_markdown(books: DataFrame, chapters: DataFrame, heading_level: int = 2) -> DataFrame:
    """Title, bullets, quoted intro; per chapter a heading and its paragraphs, a note where there are none."""
    header = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("\n- " + fixed.AUTHOR_LABEL), blank_to_null("author")), F.lit("")),
        F.lit("\n- " + fixed.SOURCE_LABEL), F.col("source_id"),
        F.coalesce(F.concat(F.lit("\n\n> "), blank_to_null("intro")), F.lit("")),
        F.lit("\n"),
    )
    text = F.array_join(split_paragraphs(F.coalesce("content", F.lit(""))), "\n\n")
    body = F.concat(
        F.lit("#" * heading_level + " "), F.col("title"), F.lit("\n\n"),
        F.coalesce(blank_to_null(text), F.lit("_" + fixed.EMPTY_CHAPTER + "_")), F.lit("\n"),
    )
    return _pieces(books, header, chapters, body, "book.md")


# --- e-book parts -------------------------------------------------------------------------------------------------
def book_uuid(book_id: Column, namespace: str = "book") -> Column:
    """Name-based UUID (version 5, URL namespace), from one SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(fixed.URL_NAMESPACE)), F.encode(F.concat(F.lit(namespace + ":"), book_id), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def iso_utc(moment: Column | str) -> Column:
    return F.date_format(col(moment), fixed.UTC_FORMAT)


def number_chapters(chapters: DataFrame) -> DataFrame:
    """1-based position and file name of every chapter of its book."""
    numbered = row_numbers(chapters, ["book_id"], ["index"], INDEX_WIDTH, "position")
    return numbered.withColumn("file_name", F.format_string(fixed.CHAPTER_FILE, "position"))


def chapter_xhtml(title: Column, content: Column) -> Column:
    paragraphs = F.transform(split_paragraphs(content), lambda p: F.format_string(fixed.PARAGRAPH, escape_xml(p)))
    body = F.coalesce(blank_to_null(F.array_join(paragraphs, "\n")), F.lit(fixed.EMPTY_PARAGRAPH))
    return F.format_string(fixed.CHAPTER_XHTML, escape_xml(title), body)


def export_metadata(books: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(book_id, metadata): book fields, overridden by rendered templates that are not empty; title, creator and
    language first, the rest by key. ``templates`` maps a field to its template."""
    filled = F.create_map(
        F.lit("title"), F.col("title"),
        F.lit("creator"), F.coalesce(blank_to_null("author"), F.lit(fixed.DEFAULT_CREATOR)),
        F.lit("language"), F.coalesce(blank_to_null("language"), F.lit(fixed.DEFAULT_LANGUAGE)),
        F.lit("source"), F.col("source_id"),
        F.lit("description"), F.coalesce("intro", F.lit("")),
        F.lit("publisher"), F.coalesce(F.try_element_at("metadata", F.lit("publisher")), F.lit("")),
    )
    fields = F.map_filter(filled, lambda k, v: v != "")
    if templates:
        values = book_variables(*[F.col(c) for c in ("title", "author", "source_id", "source_book_id", "latest_chapter", "status")])
        rendered = F.map_from_entries(
            F.array(*[F.struct(F.lit(k), render_template(F.lit(t), values)) for k, t in templates.items()])
        )
        fields = F.map_concat(fields, F.map_filter(rendered, lambda k, v: v != ""))
    lead = literal_map({"title": "0", "creator": "1", "language": "2"})
    ordered = F.array_sort(
        F.transform(
            F.map_entries(fields),
            lambda e: F.struct(
                F.coalesce(F.try_element_at(lead, e["key"]), F.concat(F.lit("9"), e["key"])).alias("rank"),
                e["key"].alias("key"), e["value"].alias("value"),
            ),
        )
    )
    return books.select(
        F.col("id").alias("book_id"), F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("metadata")
    )


def export_xhtml_parts(
    books: DataFrame, chapters: DataFrame, covers: DataFrame | None = None, templates: dict[str, str] | None = None,
    namespace: str = "book",
) -> DataFrame:
    """All text parts of an e-book as pieces; concatenating the pieces of a part in order gives its file.

    ``covers``: book_id, suffix (an admitted image kind). The archive container itself is not written here.
    """
    uid = F.concat(F.lit("urn:uuid:"), book_uuid(F.col("id").cast("string"), namespace))
    meta = export_metadata(books, templates).withColumnRenamed("book_id", "id")
    head = books.join(meta.withColumnRenamed("metadata", "_meta"), "id").withColumn("_uid", uid)
    media = literal_map(fixed.SUFFIX_MEDIA_TYPE)
    if covers is not None:
        cover = covers.select(F.col("book_id").alias("id"), F.lower("suffix").alias("_suffix"))
        head = head.join(cover, "id", "left")
    else:
        head = head.withColumn("_suffix", F.lit(None).cast("string"))
    head = head.withColumn("_media", F.try_element_at(media, F.col("_suffix")))
    has_cover = F.col("_media").isNotNull()
    image = F.concat(F.lit("cover"), F.col("_suffix"))
    counts = chapters.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("_n"))
    head = head.join(counts, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    title = escape_xml("title")

    fill = F.format_string
    nothing, empty = F.lit(""), F.col("_n") == 0
    opf_meta = F.array_join(F.transform(F.col("_meta"), lambda e: fill(fixed.OPF_FIELD, e["key"], escape_xml(e["value"]))), "")
    opf_open = F.concat(
        fill(fixed.OPF_OPEN, F.col("_uid"), opf_meta, iso_utc("updated_at"), iso_utc("created_at")),
        F.when(has_cover, fixed.OPF_COVER_META).otherwise(""),
        F.lit(fixed.OPF_MANIFEST),
        F.when(has_cover, fill(fixed.OPF_COVER_ITEMS, image, F.col("_media"))).otherwise(nothing),
    )
    opf_middle = F.concat(
        F.lit(fixed.OPF_LAST_ITEMS + fixed.OPF_SPINE),
        F.when(has_cover, fixed.OPF_COVER_REF).when(empty, "\n").otherwise(""),
    )
    nav_open = F.concat(fill(fixed.NAV_OPEN, title), F.when(empty, fixed.NAV_EMPTY).otherwise(""))
    ncx_open = F.concat(fill(fixed.NCX_OPEN, F.col("_uid"), title), F.when(empty, "\n").otherwise(""))
    cover_page = fill(fixed.COVER_XHTML, title, image)
    far = 1 << 40
    fixed_parts = [
        ("mimetype", 0, F.lit(fixed.EPUB_MIMETYPE), None),
        ("META-INF/container.xml", 0, F.lit(fixed.EPUB_CONTAINER), None),
        ("OEBPS/style.css", 0, F.lit(STYLE), None),
        ("OEBPS/cover.xhtml", 0, cover_page, has_cover),
        ("OEBPS/toc.xhtml", 0, nav_open, None),
        ("OEBPS/toc.xhtml", far, F.lit(fixed.NAV_CLOSE), None),
        ("OEBPS/toc.ncx", 0, ncx_open, None),
        ("OEBPS/toc.ncx", far, F.lit(fixed.NCX_CLOSE), None),
        ("OEBPS/content.opf", 0, opf_open, None),
        ("OEBPS/content.opf", far, opf_middle, None),
        ("OEBPS/content.opf", 3 * far, F.lit(fixed.OPF_CLOSE), None),
    ]
    book_rows = head.select(
        F.col("id").alias("book_id"),
        F.inline(
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(part).alias("part"), F.lit(at).cast("long").alias("ord"),
                            (content if only is None else F.when(only, content)).alias("content"),
                        )
                        for part, at, content, only in fixed_parts
                    ]
                ),
                lambda p: p["content"].isNotNull(),
            )
        ),
    )
    number, file_name = F.col("position"), F.col("file_name")
    chapter_parts = [
        (F.concat(F.lit("OEBPS/"), file_name), F.lit(0), chapter_xhtml(F.col("title"), F.col("content"))),
        (F.lit("OEBPS/toc.xhtml"), number, fill(fixed.NAV_ITEM, file_name, escape_xml("title"))),
        (F.lit("OEBPS/toc.ncx"), number, fill(fixed.NCX_POINT, number, escape_xml("title"), file_name)),
        (F.lit("OEBPS/content.opf"), number, fill(fixed.OPF_ITEM, number, file_name)),
        (F.lit("OEBPS/content.opf"), number + 2 * far, fill(fixed.OPF_REF, number)),
    ]
    chapter_rows = (
        number_chapters(chapters).join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
        .select(
            "book_id",
            F.inline(F.array(*[F.struct(p.alias("part"), o.cast("long").alias("ord"), c.alias("content")) for p, o, c in chapter_parts])),
        )
    )
    return book_rows.unionByName(chapter_rows)


def export_ledger(events: DataFrame, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Current row per export job from its appended status rows."""
    rest = [c for c in events.columns if c != "export_id"]
    latest = F.max_by(F.struct(*rest), F.struct(at, tie))
    return events.groupBy("export_id").agg(
        latest.alias("_r"), F.min(at).alias("created_at"),
        F.max(F.when(F.col("status").isin("success", "failed"), F.col(at))).alias("finished_at"),
    ).select("export_id", "created_at", "finished_at", "_r.*")
