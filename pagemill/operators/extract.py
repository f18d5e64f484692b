"""Extraction: rules are rows, pages are rows, and one generic expression evaluates any rule on any page."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed
from pagemill.functions.core import blank_to_null, col, fold_space, let, strip
from pagemill.functions.text import parse_status
from pagemill.functions.urls import normalize_url
from pagemill.operators.html import inside, node_value, parse_selector, scan_pages, select_nodes, selector_supported
from pagemill.operators.ordered import running_sums
from pagemill.operators.transforms import OPS, STEPS, apply_transform_column
from pagemill.session import written
from pagemill.sizes import join_small


# --- the rule language --------------------------------------------------------------------------------------------
def parse_rule(raw: Column | str) -> Column:
    """Rule text to struct(rule_type, expression, attribute)."""
    text = strip(raw)
    lowered = F.lower(text)

    def tail(prefix: str) -> Column:
        return F.substring(text, F.lit(len(prefix) + 1), F.length(text))

    none = F.lit(None).cast("string")
    kinds = [
        (F.startswith(lowered, F.lit(f"{kind}:")), F.lit(kind), tail(f"{kind}:"), none)
        for kind in ("xpath", "jsonpath", "regex")
    ]
    kinds.append((F.startswith(text, F.lit("@")), F.lit("attr"), tail("@"), none))
    kinds.append(
        (
            F.contains(text, F.lit("@")), F.lit("css"), F.regexp_replace(text, "@[^@]*$", ""),
            F.substring_index(text, "@", -1),
        )
    )
    out = F.when(text == "", F.lit(None))
    for hit, kind, expression, attribute in kinds:
        out = out.when(
            hit, F.struct(kind.alias("rule_type"), expression.alias("expression"), attribute.alias("attribute"))
        )
    return out.otherwise(F.struct(F.lit("css").alias("rule_type"), text.alias("expression"), none.alias("attribute")))


def format_rule(rule: Column) -> Column:
    kind, expression = rule["rule_type"], rule["expression"]
    return (
        F.when(kind == "attr", F.concat(F.lit("@"), expression))
        .when((kind == "css") & (rule["attribute"] != ""), F.concat(expression, F.lit("@"), rule["attribute"]))
        .when(kind == "css", expression)
        .otherwise(F.concat(kind, F.lit(":"), expression))
    )


def xpath_to_selector(path: Column) -> Column:
    """The simple path subset (steps, //, [@a='v'], final @a or text()) as selector text and attribute."""
    final = F.regexp_extract(path, r"/+(@[\w\-]+|text\(\))$", 1)
    body = F.regexp_replace(path, r"/+(@[\w\-]+|text\(\))$", "")
    body = F.regexp_replace(body, r"\[@([\w\-]+)\s*(=\s*['\"][^'\"]*['\"])?\]", "[$1$2]")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "^/+", ""), "//", " "), "/", " > ")
    return F.struct(
        body.alias("expression"),
        F.when(F.startswith(final, F.lit("@")), F.substring(final, F.lit(2), F.length(final))).alias("attribute"),
    )


#: What the path evaluators understand. Anything else is rejected, never guessed.
XPATH_STEPS = r"^/{0,2}[a-zA-Z*][\w\-]*(?:\[@[\w\-]+(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"))?\])*(?:/{1,2}[a-zA-Z][\w\-]*(?:\[@[\w\-]+(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"))?\])*)*(?:/{1,2}(?:@[\w\-]+|text\(\)))?$"
JSON_STEPS = r"^\$(?:\.[^.\[\]*?@() ]+|\[\d+\]|\[\*\]|\['[^'\]]+'\])*$"


@F.arrow_udf(T.StringType())
def java_pattern(patterns: pa.Array) -> pa.Array:
    """The pattern in Java's spelling, or null if it is no pattern or means something else there. Lines end at ``\\n`` alone, as in
    Python. Runs over rules, not pages."""

    def one(pattern: str | None) -> str | None:
        if pattern is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("error")  # sets that other engines read as nested
                names = re.compile(pattern).groupindex
        except (re.error, Warning, OverflowError, RecursionError):
            return None
        if re.search(r"\(\?(?:\(|#|[a-zA-Z]*[aLu])|&&|\\Z", pattern):
            return None
        spelled = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern).replace("(?P<", "(?<").replace("{,", "{0,")
        if re.search("[.^$]", pattern):
            spelled = f"(?d){spelled}"
        return None if any(not n.isalnum() or not n.isascii() for n in names) else spelled

    return pa.array([one(p) for p in patterns.to_pylist()], pa.string())


def compile_rules(rules: DataFrame, raw: str = "rule") -> DataFrame:
    """Parse the rule text of every row once; simple xpaths are routed to the selector form.

    ``problem`` says why a rule cannot be evaluated; such a rule has the type ``unsupported`` and gives no values. A source
    with a bad rule stops nothing: its other rules run.
    """
    parsed = rules.withColumn("_r", parse_rule(raw)).withColumn(
        "_x", F.when(F.col("_r.rule_type") == "xpath", xpath_to_selector(F.col("_r.expression")))
    )
    selector = F.coalesce(F.col("_x.expression"), F.when(F.col("_r.rule_type") == "css", F.col("_r.expression")))
    kind, expression = F.col("_r.rule_type"), F.col("_r.expression")
    checked = parsed.withColumn("_java", java_pattern(F.when(kind == "regex", expression)))
    problem = (
        F.when(kind.isNull(), "empty rule")
        .when((kind == "css") & ~selector_supported(expression), "unsupported selector")
        .when((kind == "xpath") & ~(expression.rlike(XPATH_STEPS) & selector_supported(F.col("_x.expression"))), "unsupported path")
        .when((kind == "jsonpath") & ~expression.rlike(JSON_STEPS), "unsupported JSON path")
        .when((kind == "regex") & F.col("_java").isNull(), "unusable pattern")
        .when((kind == "attr") & (expression == ""), "empty attribute")
    )
    return checked.withColumn("problem", problem).withColumns(
        {
            "rule_type": F.when(F.col("problem").isNotNull(), "unsupported").otherwise(kind),
            "expression": F.coalesce("_java", expression),
            "attribute": F.coalesce(F.col("_x.attribute"), F.col("_r.attribute")),
            "selector": F.when(selector.isNotNull() & F.col("problem").isNull(), parse_selector(selector)),
        }
    ).drop("_r", "_x", "_java")


def rule_rejects(rules: DataFrame, raw: str = "rule") -> DataFrame:
    """The rules that cannot be evaluated, in all their columns, with the reason in ``problem``."""
    return compile_rules(rules, raw).filter(F.col("problem").isNotNull()).select(*rules.columns, "problem")


@F.arrow_udf(T.BooleanType())
def replacement_fits(patterns: pa.Array, replacements: pa.Array) -> pa.Array:
    """Whether every group that a replacement names is in its pattern, and nothing else stands behind a backslash."""

    def one(pattern: str | None, replacement: str | None) -> bool:
        if pattern is None or not replacement:
            return True
        if re.search(r"\\(?!\d|g<\d+>)", replacement):
            return False
        try:
            re.compile(pattern).sub(replacement, "")
        except (re.error, IndexError, OverflowError, RecursionError):
            return False
        return True

    return pa.array([one(p, r) for p, r in zip(patterns.to_pylist(), replacements.to_pylist(), strict=True)], pa.bool_())


def compile_transforms(transforms: DataFrame) -> DataFrame:
    """Check every row of a transform table once; ``problem`` says why a step cannot run. Such a step is left out of its list and
    the others run; patterns come out in Java's spelling."""
    op, pattern = F.col("op"), F.col("pattern")
    by_pattern = op == "regex_replace"
    checked = transforms.withColumns(
        {"_java": java_pattern(F.when(by_pattern, pattern)), "_fits": replacement_fits(F.when(by_pattern, pattern), F.when(by_pattern, F.col("replacement")))}
    )
    problem = (
        F.when(op.isNull() | ~op.isin(*OPS), "unknown transform")
        .when(op.isin("replace", "regex_replace") & pattern.isNull(), "no pattern")
        .when(by_pattern & F.col("_java").isNull(), "unusable pattern")
        .when(by_pattern & ~F.col("_fits"), "unusable replacement")
    )
    return checked.withColumn("problem", problem).withColumn("pattern", F.coalesce("_java", pattern)).drop("_java", "_fits")


def transform_rejects(transforms: DataFrame) -> DataFrame:
    """The transform rows that cannot run, as they were given, with the reason in ``problem``."""
    given = transforms.withColumn("_given", F.col("pattern"))
    bad = compile_transforms(given).filter(F.col("problem").isNotNull()).withColumn("pattern", F.col("_given"))
    return bad.select(*transforms.columns, "problem")


# --- values of one rule -------------------------------------------------------------------------------------------
def css_values(page: Column, nodes: Column, selector: Column, attribute: Column) -> Column:
    found = F.transform(
        select_nodes(nodes, selector), lambda n: node_value(n, attribute, page["page_text"], page["html"])
    )
    return F.array_compact(found)


def root_values(page: Column, root: Column, name: Column) -> Column:
    """``@text``, ``@own_text``, ``@html`` or an attribute of the item itself."""
    return F.array_compact(F.array(node_value(root, name, page["page_text"], page["html"])))


def extract_regex(text: Column | str, pattern: Column | str) -> Column:
    """All matches; the first group when the pattern has groups, else the whole match."""
    body = col(text)
    rule = F.lit(pattern) if isinstance(pattern, str) else pattern
    groups = F.when(rule.rlike(r"(?<!\\)\((?!\?)|\(\?P?<[A-Za-z]"), 1).otherwise(0)
    return F.regexp_extract_all(body, rule, groups)


def extract_jsonpath(text: Column | str, path: Column | str) -> Column:
    """Values at a path as strings; a ``[*]`` path gives every element, nulls are dropped."""
    rule = F.lit(path) if isinstance(path, str) else path
    found = F.call_function("get_json_object", col(text), rule)
    many = F.array_compact(F.from_json(found, "array<string>"))
    spread_out = F.contains(rule, F.lit("[*]")) & F.startswith(found, F.lit("["))
    return F.when(found.isNull(), F.array().cast("array<string>")).when(spread_out, many).otherwise(F.array(found))


def extract_xpath(text: Column | str, path: str) -> Column:
    """All matches of a path over well-formed XML or XHTML; use rules for tag soup."""
    return F.transform(F.xpath(col(text), F.lit(path)), strip)


def first_value(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def rule_values(page: Column, nodes: Column, rule: Column) -> Column:
    """Values of any compiled rule inside ``nodes`` (a page or one list item of it)."""
    root = F.get(nodes, F.lit(0))
    markup = node_value(root, F.lit("html"), page["page_text"], page["html"])
    return (
        F.when(rule["selector"].isNotNull(), css_values(page, nodes, rule["selector"], rule["attribute"]))
        .when(rule["rule_type"] == "attr", root_values(page, root, rule["expression"]))
        .when(
            rule["rule_type"] == "regex",
            extract_regex(F.when(root["node"] == 0, page["html"]).otherwise(markup), rule["expression"]),
        )
        .when(rule["rule_type"] == "jsonpath", extract_jsonpath(page["html"], rule["expression"]))
        .otherwise(F.array().cast("array<string>"))
    )


# --- records ------------------------------------------------------------------------------------------------------
def rule_sets(rules: DataFrame, transforms: DataFrame | None = None) -> DataFrame:
    """One row per (source_id, capability): list rule, field rules, transform list.

    ``rules``: source_id, capability, field, rule (field ``list`` is the list rule).
    ``transforms``: source_id, capability (null for all), ord, op, pattern, replacement, value, separator.
    Rules and steps that cannot be evaluated are left out (``rule_rejects``, ``transform_rejects``). The rules of one source are a handful of rows by nature, so gathering them per source is bounded.
    """
    compiled = compile_rules(rules)
    rule = F.struct(*[F.col(c) for c in ("field", "rule_type", "expression", "attribute", "selector")])
    grouped = compiled.groupBy("source_id", "capability").agg(
        F.first(F.when(F.col("field") == "list", rule), ignorenulls=True).alias("list_rule"),
        F.collect_list(F.when(F.col("field") != "list", rule)).alias("fields"),
    ).withColumn("sheet", F.to_json(F.struct(F.col("list_rule").alias("list"), "fields")))
    if transforms is None:
        return grouped.withColumn("transforms", F.array().cast(STEPS))
    step = F.struct(*[F.col(c) for c in ("op", "pattern", "replacement", "value", "separator")])
    general = F.col("capability").isNull()
    steps = (
        compile_transforms(transforms).filter(F.col("problem").isNull()).withColumn("capability", F.explode(
            F.when(general, F.array(*[F.lit(c) for c in fixed.CAPABILITIES])).otherwise(F.array("capability"))))
        .withColumn("_rank", F.struct(~general, F.col("ord")))
        .groupBy("source_id", "capability")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", step.alias("s")))), lambda x: x["s"]).alias("transforms"))
    )
    return grouped.join(steps, ["source_id", "capability"], "left")


def with_rules(shredded: DataFrame, sets: DataFrame, capability: str) -> DataFrame:
    """Attach the rule set of a capability to every page of its source."""
    return join_small(shredded, sets.filter(F.col("capability") == capability).drop("capability"), "source_id")


def scan(landed: DataFrame, sets: DataFrame, capability: str, many: bool = False, drop: Iterable[str] = ()) -> DataFrame:
    """Landed pages (``source_id``, ``url``, ``html``) with what their rules find: one parse, in which the selectors are swept
    too. ``many`` takes the items of the list rule instead of the whole page; ``drop`` removes matching nodes first.

    The result goes to ``extract_one``, ``extract_many`` or ``extract_content``. Use ``shred_html`` and ``with_rules`` instead
    where the node arrays themselves are wanted.
    """
    dropped = list(drop)
    if dropped:
        gone = F.to_json(F.struct(parse_selector(F.lit(",".join(dropped))).alias("drop")))
        sets = sets.withColumn("sheet", F.concat(F.expr("left(sheet, length(sheet) - 1)"), F.lit(","), F.substring(gone, F.lit(2), F.length(gone))))
    return scan_pages(with_rules(landed, sets, capability), many)


def _page() -> Column:
    return F.struct(F.col("page_text"), F.col("html"))


def _record(page: Column, nodes: Column, fields: Column, transforms: Column, base: Column) -> Column:
    return F.map_from_entries(
        F.transform(
            fields,
            lambda f: F.struct(
                f["field"],
                apply_transform_column(first_value(rule_values(page, nodes, f)), transforms, base),
            ),
        )
    )


def _found_record(found: Column, body: Column, fields: Column, transforms: Column, base: Column) -> Column:
    """The record of one entry of ``scan``: selector values are there, patterns and JSON paths are evaluated here."""

    def value(f: Column, at: Column) -> Column:
        got = F.get(found["values"], at)
        mode = F.when(f["rule_type"] == "attr", f["expression"]).otherwise(F.coalesce(f["attribute"], F.lit("text")))
        return (
            F.when(f["rule_type"] == "regex", first_value(extract_regex(found["markup"], f["expression"])))
            .when(f["rule_type"] == "jsonpath", first_value(extract_jsonpath(body, f["expression"])))
            .when(mode.isin("text", "own_text"), fold_space(got))
            .otherwise(got)
        )

    return F.map_from_entries(
        F.transform(fields, lambda f, at: F.struct(f["field"], apply_transform_column(value(f, at), transforms, base)))
    )


def extract_one(pages: DataFrame, base_url: str = "url") -> DataFrame:
    """Every field rule on the whole page: adds ``record``, a map from field to transformed first value or null. Takes the
    result of ``scan``, or pages with node arrays and rules."""
    keep = [c for c in pages.columns if c not in _SPENT]
    if "found" in pages.columns:
        record = _found_record(F.get("found", F.lit(0)), F.col("html"), F.col("fields"), F.col("transforms"), F.col(base_url))
    else:
        record = _record(_page(), F.col("nodes"), F.col("fields"), F.col("transforms"), F.col(base_url))
    return pages.select(*keep, F.inline(F.array(F.struct(record.alias("record")))))


_SPENT = ("nodes", "page_text", "html", "fields", "list_rule", "transforms", "sheet", "found")


def _json_elements(body: Column) -> Column:
    """The texts of the elements that a JSON list rule finds (or of a single value); null elements are skipped."""
    found = F.call_function("get_json_object", body, F.col("list_rule.expression"))
    elements = F.when(F.startswith(found, F.lit("[")), F.from_json(found, "array<string>")).otherwise(F.array(found))
    return F.filter(elements, lambda i: i.isNotNull() & (i != "null"))


def extract_many(pages: DataFrame, base_url: str = "url") -> DataFrame:
    """One row per list item with ``item_no`` (from 0) and ``record``; all in the row of the page, no shuffle. Takes the
    result of ``scan`` with ``many``, or pages with node arrays and rules.

    An item of a selector is the part of the page below it; an item of a JSON path is the text of an array element (or of a
    single value), on which the JSON paths of the fields are evaluated; null elements are skipped.
    """
    body, fields, transforms, base = F.col("html"), F.col("fields"), F.col("transforms"), F.col(base_url)
    is_json = F.col("list_rule.rule_type") == "jsonpath"
    if "found" in pages.columns:
        none = F.array().cast("array<string>")
        json = F.transform(_json_elements(body), lambda i: F.struct(F.struct(none.alias("values"), i.alias("markup")).alias("found"), i.alias("body")))
        dom = F.transform("found", lambda e: F.struct(e.alias("found"), body.alias("body")))
        records = F.transform(
            F.when(is_json, json).otherwise(dom), lambda item: _found_record(item["found"], item["body"], fields, transforms, base)
        )
    else:
        nodes = F.col("nodes")
        dom = F.transform(select_nodes(nodes, F.col("list_rule.selector")), lambda i: F.struct(inside(nodes, i).alias("scope"), body.alias("body")))
        none = F.filter(nodes, lambda n: F.lit(False))
        json = F.transform(_json_elements(body), lambda i: F.struct(none.alias("scope"), i.alias("body")))
        records = F.transform(
            F.when(is_json, json).otherwise(dom),
            lambda item: _record(F.struct(F.col("page_text"), item["body"].alias("html")), item["scope"], fields, transforms, base),
        )
    keep = [c for c in pages.columns if c not in _SPENT]
    return pages.select(*keep, F.posexplode(records).alias("item_no", "record"))


def extract_many_json(pages: DataFrame, path: str, fields: dict[str, str], text: str = "text") -> DataFrame:
    """JSON lists: the array at ``path`` is flattened, null items are skipped, each item gives one row."""
    found = F.get_json_object(col(text), path)
    items = F.filter(F.from_json(found, "array<string>"), lambda i: i.isNotNull() & (i != "null"))
    flat = F.when(F.startswith(found, F.lit("[")), items).otherwise(F.array_compact(F.array(found)))
    keep = [c for c in pages.columns if c != text]
    out = pages.select(*keep, F.posexplode(flat).alias("item_no", "_item"))
    for name, rule in fields.items():
        out = out.withColumn(name, first_value(extract_jsonpath("_item", rule)))
    return out.drop("_item")


# --- typed results ------------------------------------------------------------------------------------------------
def _extra(known: Iterable[str]) -> Column:
    return F.map_filter("record", lambda k, v: ~k.isin(*known))


def _field(name: str) -> Column:
    return F.try_element_at(F.col("record"), F.lit(name))


def extract_search(items: DataFrame) -> DataFrame:
    """Search hits: rows lacking a title or a link are skipped, unknown fields go to ``extra``."""
    keep = [c for c in items.columns if c not in ("record", "url")]
    return (
        items.filter((F.coalesce(_field("title"), F.lit("")) != "") & (F.coalesce(_field("url"), F.lit("")) != ""))
        .select(
            *keep,
            *[_field(f).alias({"cover": "cover_url"}.get(f, f)) for f in fixed.SEARCH_FIELDS],
            _extra(fixed.SEARCH_FIELDS).alias("extra"),
        )
    )


def extract_book(records: DataFrame, book_url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Books, and rejects without a title; the id falls back to the canonical URL."""
    named = F.coalesce(_field("title"), F.lit("")) != ""
    keep = [c for c in records.columns if c != "record"]
    books = records.filter(named).select(
        *keep,
        F.coalesce(blank_to_null(_field("id")), normalize_url(book_url)).alias("source_book_id"),
        *[_field(f).alias({"cover": "cover_url"}.get(f, f)) for f in ("title", "author", "intro", "cover", "latest_chapter")],
        parse_status(_field("status")).alias("status"),
        _extra(fixed.BOOK_FIELDS).alias("extra"),
    )
    return books, records.filter(~named).select(*keep, F.lit("no_title").alias("reason"))


def extract_chapters(items: DataFrame, book: str = "book_id", reverse: str | None = None) -> DataFrame:
    """Chapter drafts of books whose catalogue spans pages (``page_no``, ``item_no``).

    The index is the position before incomplete rows are dropped. The items are written once, so that no page is parsed twice;
    their numbers per page, read from two narrow columns, give the offset of a page as the sum over the pages before it, taken
    by ranges of pages, so a book of any length never meets in one sort. Rows without a book or page number form one of their own.
    """
    items = written(items, "items")
    counts = items.groupBy(book, "page_no").agg(F.count("*").alias("_n"))
    placed = running_sums(counts, [book], ["page_no"], None, {"_upto": F.col("_n")})
    offsets = placed.select(F.col(book).alias("_book"), F.col("page_no").alias("_page"), (F.col("_upto") - F.col("_n")).alias("_before"))
    if reverse:
        totals = counts.groupBy(F.col(book).alias("_of")).agg(F.sum("_n").alias("_total"))
        offsets = offsets.join(totals, F.col("_book").eqNullSafe(F.col("_of")), "left").drop("_of")
    position = F.col("_before") + F.col("item_no")
    if reverse:
        position = F.when(F.col(reverse), F.col("_total") - 1 - position).otherwise(position)
    keep = [c for c in items.columns if c not in ("record", "page_no", "item_no", "url")]
    return (
        items.join(offsets, F.col(book).eqNullSafe(F.col("_book")) & F.col("page_no").eqNullSafe(F.col("_page")))
        .withColumn("_index", position)
        .filter((F.coalesce(_field("title"), F.lit("")) != "") & (F.coalesce(_field("url"), F.lit("")) != ""))
        .select(
            *keep, F.col("_index").alias("index"), _field("title").alias("title"), _field("url").alias("url"),
            _field("id").alias("source_chapter_id"),
        )
    )


def extract_content(pages: DataFrame, base_url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Chapter bodies from pages with a ``body`` rule (noise already dropped); pages without a match are rejects."""
    done = extract_one(pages, base_url)
    body = _field("body")
    keep = [c for c in done.columns if c != "record"]
    return (
        done.filter(body.isNotNull()).select(*keep, body.alias("content")),
        done.filter(body.isNull()).select(*keep, F.lit("no_body").alias("reason")),
    )
