"""Node arrays for HTML pages and selectors over them.

Parsing tag soup is the one batch step that needs Python. It turns each page into one row that carries all its nodes in
document order, numbered so that the descendants of a node are a range. Every selector is then a filter over that array
inside the row: no shuffle, no self-join of a node table, and the page text is stored once rather than once per ancestor.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed
from pagemill.functions.core import blank_to_null, col, fold_space, let, strip

NODE = (
    "node: int, last: int, parent: int, depth: int, tag: string, id: string, classes: array<string>, "
    "attrs: map<string,string>, own: string, text_start: int, text_end: int, html_start: int, html_end: int, tail_end: int"
)
_ARROW_NODE = pa.struct(
    [
        ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
        ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("own", pa.string()),
        ("text_start", pa.int32()), ("text_end", pa.int32()),
        ("html_start", pa.int32()), ("html_end", pa.int32()), ("tail_end", pa.int32()),
    ]
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select", "datalist"}),
    **{tag: ({"p"}, {"td", "th", "button", "caption", "table"}) for tag in _ENDS_PARAGRAPH},
}


class _Shredder(HTMLParser):
    """Collects the nodes of one page; open elements are kept on a stack."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.opened: Counter[str] = Counter()  # open elements by tag, so that no deep stack is searched in vain
        self.pieces: list[str] = []
        self.own: list[str] = []
        self.length = 0
        self.waiting: dict | None = None
        self.lines = [0]
        at = page.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = page.find("\n", at + 1)
        self.page = page
        self.feed(page)
        self.close()
        self._finish_tail(len(page))
        while self.open:
            self._shut(len(page), len(page))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _finish_tail(self, at: int) -> None:
        if self.waiting is not None:
            self.waiting["tail_end"] = at
            self.waiting = None

    def _seal_own(self) -> None:
        if self.open and self.open[-1]["own"] is None:
            self.open[-1]["own"] = "".join(self.own)
        self.own = []

    def _shut(self, inner_end: int, outer_end: int) -> None:
        self._seal_own()
        node = self.open.pop()
        self.opened[node["tag"]] -= 1
        node["last"] = len(self.nodes) - 1
        node["text_end"] = self.length
        node["html_end"] = node["tail_end"] = outer_end
        self.waiting = node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._offset()
        self._finish_tail(at)
        closes = _CLOSES.get(tag)
        if closes and any(self.opened[t] for t in closes[0]):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] in closes[0]:
                    while len(self.open) > i:
                        self._shut(at, at)
                    self.waiting = None
                    break
                if self.open[i]["tag"] in closes[1]:
                    break
        self._seal_own()
        named = {k: (v if v is not None else "") for k, v in reversed(attrs)}
        node = {
            "node": len(self.nodes), "last": len(self.nodes),
            "parent": self.open[-1]["node"] if self.open else -1, "depth": len(self.open), "tag": tag,
            "id": named.get("id"), "classes": (named.get("class") or "").split(), "attrs": list(named.items()),
            "own": None, "text_start": self.length, "text_end": self.length,
            "html_start": at, "html_end": at, "tail_end": at,
        }
        self.nodes.append(node)
        if tag in _VOID:
            node["own"] = ""
            node["html_end"] = node["tail_end"] = at + len(self.get_starttag_text() or "")
            self.waiting = node
        else:
            self.open.append(node)
            self.opened[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        at = self._offset()
        self._finish_tail(at)
        if not self.opened[tag]:
            return
        while self.open[-1]["tag"] != tag:
            self._shut(at, at)
            self.waiting = None
        self._shut(at, self.page.find(">", at) + 1 or len(self.page))

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.own.append(data)
        self.length += len(data)

    def handle_comment(self, data: str) -> None:
        self._seal_own()


def shred_html(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``nodes`` (array in document order) and ``page_text`` to every page."""
    keep = df.columns
    position = keep.index(html)
    added = T.StructType.fromDDL(f"nodes array<struct<{NODE}>>, page_text string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                pages = [_Shredder(p or "") for p in batch.column(position).to_pylist()]
                nodes = pa.array([p.nodes for p in pages], type=pa.list_(_ARROW_NODE))
                texts = pa.array(["".join(p.pieces) for p in pages], type=pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, nodes, texts], [*keep, "nodes", "page_text"])

    return df.mapInArrow(parse, T.StructType([*df.schema.fields, *added.fields]))


# --- values in one pass over the page -----------------------------------------------------------------------------
class _Steps:
    """One alternative of a selector: for every step what a node must have, and whether it must be a child."""

    def __init__(self, steps: list[dict]) -> None:
        self.needs = [
            (s.get("tag"), s.get("id"), frozenset(s.get("classes") or ()), [(a["name"], a.get("value")) for a in s.get("attrs") or ()])
            for s in steps
        ]
        self.child = [bool(s.get("child")) for s in steps]


def _fits(node: dict, need: tuple) -> bool:
    tag, name, classes, attrs = need
    if (tag is not None and node["tag"] != tag) or (name is not None and node["id"] != name):
        return False
    if classes and not classes.issubset(node["classes"]):
        return False
    if attrs:
        own = node["named"]
        return all(k in own and (v is None or own[k] == v) for k, v in attrs)
    return True


def sweep(nodes: list[dict], alternatives: list[_Steps], first: int, last: int) -> Iterator[dict]:
    """Nodes of ``first`` to ``last`` that a selector matches, in document order, in one pass.

    Parents come before their children, so a node needs only two masks of its parent: the steps that the parent has matched
    itself, and those that some node above it has. Work is nodes times steps, whatever matches and however deep the page is.
    """
    masks = [([0] * (last - first + 1), [0] * (last - first + 1)) for _ in alternatives]
    for at in range(first, last + 1):
        node = nodes[at]
        if node["gone"]:
            continue
        up, hit = node["parent"] - first, False
        for steps, (own, above) in zip(alternatives, masks, strict=True):
            parent, over = (own[up], above[up] | own[up]) if up >= 0 else (0, 0)
            above[at - first] = over
            mask = 0
            for k, need in enumerate(steps.needs):
                if (k == 0 or (parent if steps.child[k] else over) >> (k - 1) & 1) and _fits(node, need):
                    mask |= 1 << k
            own[at - first] = mask
            hit = hit or bool(mask >> (len(steps.needs) - 1))
        if hit:
            yield node


class _Page:
    """A parsed page with the values of its nodes; removed nodes lose their text and markup."""

    def __init__(self, html: str, drop: list[_Steps]) -> None:
        shredded = _Shredder(html)
        self.html, self.nodes, self.text = html, shredded.nodes, "".join(shredded.pieces)
        for node in self.nodes:
            node["gone"], node["named"] = False, dict(node["attrs"])
        if drop and self.nodes:
            self._remove(list(sweep(self.nodes, drop, 0, len(self.nodes) - 1)))

    def _remove(self, doomed: list[dict]) -> None:
        text, markup, end = [], [], -1
        at_text = at_html = 0
        for node in doomed:
            if node["node"] <= end:
                continue  # below one that is gone already
            end = node["last"]
            for k in range(node["node"], end + 1):
                self.nodes[k]["gone"] = True
            for pieces, whole, lo, hi, at in (
                (text, self.text, node["text_start"], node["text_end"], at_text), (markup, self.html, node["html_start"], node["html_end"], at_html)
            ):
                pieces += [whole[at:lo], BLANK * (hi - lo)]
            at_text, at_html = node["text_end"], node["html_end"]
        self.text = "".join(text) + self.text[at_text:]
        self.html = "".join(markup) + self.html[at_html:]

    def value(self, node: dict, mode: str | None) -> str | None:
        """As ``node_value``, but white space is folded later, in the JVM."""
        if mode is None or mode == "text":
            return self.text[node["text_start"] : node["text_end"]].replace(BLANK, "")
        if mode in ("html", "inner_html"):
            return self.html[node["html_start"] : node["tail_end"]].replace(BLANK, "")
        return node["own"] if mode == "own_text" else node["named"].get(mode)

    def root(self, first: int, last: int) -> dict | None:
        return next((n for n in self.nodes[first : last + 1] if not n["gone"]), None)

    def record(self, fields: list[dict], first: int, last: int) -> list[str | None]:
        """The first value of every selector or root rule inside a range of nodes."""
        out: list[str | None] = []
        for field in fields:
            found = None
            if field["steps"]:
                values = (self.value(n, field.get("attribute")) for n in sweep(self.nodes, field["steps"], first, last))
                found = next((v for v in values if v is not None), None)
            elif field.get("rule_type") == "attr" and (root := self.root(first, last)) is not None:
                found = self.value(root, field["expression"])
            out.append(found)
        return out


def _compiled(selector: list | None) -> list[_Steps]:
    return [_Steps(steps) for steps in selector or ()]


class _Sheet:
    """The rules of one source as they arrive beside a page; compiled once per worker and text."""

    def __init__(self, text: str | None) -> None:
        given = json.loads(text) if text else {}
        self.drop = _compiled(given.get("drop"))
        self.list = given.get("list")
        self.items = _compiled((self.list or {}).get("selector"))
        self.fields = [dict(f, steps=_compiled(f.get("selector"))) for f in given.get("fields") or ()]
        self.markup = any(f.get("rule_type") == "regex" for f in self.fields)


FOUND = "array<struct<values: array<string>, markup: string>>"
_ARROW_FOUND = pa.list_(pa.struct([("values", pa.list_(pa.string())), ("markup", pa.string())]))


def scan_pages(df: DataFrame, many: bool, html: str = "html", sheet: str = "sheet", out: str = "found") -> DataFrame:
    """Parse every page once and take the values of its rules from it, in the same pass: adds an array with one entry for the
    whole page, or (``many``) one for every node that the list rule selects.

    ``sheet`` is the rule set as JSON: ``drop`` and ``list.selector`` (parsed selectors), ``fields`` (selector, rule_type,
    expression, attribute). Values stand in the order of the fields; patterns and JSON paths are left null for the JVM, with
    the markup of the entry beside them where a pattern needs it. A null page is an empty one, a page without nodes has an
    entry of nulls, or none (``many``).
    """
    keep = df.columns
    at_html, at_sheet = keep.index(html), keep.index(sheet)
    added = T.StructType.fromDDL(f"`{out}` {FOUND}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheets: dict[str | None, _Sheet] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, found = whole.slice(start, 256), []
                for text, rules in zip(batch.column(at_html).to_pylist(), batch.column(at_sheet).to_pylist(), strict=True):
                    if rules not in sheets:
                        sheets[rules] = _Sheet(rules)
                    found.append(_entries(sheets[rules], text or "", many))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_FOUND)], [*keep, out])

    return df.mapInArrow(parse, T.StructType([*df.schema.fields, *added.fields]))


def _entries(sheet: _Sheet, text: str, many: bool) -> list[dict]:
    page = _Page(text, sheet.drop)
    last = len(page.nodes) - 1
    if not many:
        return [{"values": page.record(sheet.fields, 0, last), "markup": page.html.replace(BLANK, "") if sheet.markup else None}]
    items = sweep(page.nodes, sheet.items, 0, last) if sheet.items else ()
    return [
        {"values": page.record(sheet.fields, i["node"], i["last"]), "markup": page.value(i, "html") if sheet.markup else None}
        for i in items
    ]


def node_table(shredded: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row per node, for SQL users; ``text`` is the folded text below the node."""
    flat = shredded.select(*keys, "page_text", F.inline("nodes"))
    return flat.withColumn("text", _text_between(F.col("page_text"), F.col("text_start"), F.col("text_end"))).drop("page_text")


def _text_between(text: Column, start: Column, end: Column) -> Column:
    return fold_space(F.replace(F.substring(text, start + 1, end - start), F.lit(BLANK), F.lit("")))


# Overwrites removed characters; a parser never lets it through as page text.
BLANK = "\x00"


# --- selectors ----------------------------------------------------------------------------------------------------
_NAME = r"[\w\-]+"
SELECTOR_TOKEN = (
    rf"^>?(?:[a-zA-Z]{_NAME[:-1]}*|[a-zA-Z]|\*)?(?:[.#]{_NAME}|\[[\w:\-]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\]\"']*))?\])*$"
)


def _tokens(alternative: Column) -> Column:
    return F.split(strip(F.regexp_replace(alternative, r"\s*>\s*", " >")), r"\s+")


def parse_selector(expression: Column | str) -> Column:
    """Selector text to alternatives of steps: tag, id, classes, attributes, child or descendant."""

    def step(token: Column) -> Column:
        bare = F.regexp_replace(token, r"\[[^\]]*\]", "")
        return F.struct(
            F.startswith(token, F.lit(">")).alias("child"),
            blank_to_null(F.lower(F.regexp_extract(bare, r"^>?([a-zA-Z][\w\-]*)", 1))).alias("tag"),
            blank_to_null(F.regexp_extract(bare, rf"#({_NAME})", 1)).alias("id"),
            F.regexp_extract_all(bare, F.lit(rf"\.({_NAME})"), F.lit(1)).alias("classes"),
            F.transform(
                F.regexp_extract_all(token, F.lit(r"\[([^\]]+)\]"), F.lit(1)),
                lambda a: F.struct(
                    F.lower(F.substring_index(a, "=", 1)).alias("name"),
                    F.when(
                        F.contains(a, F.lit("=")), F.btrim(F.regexp_replace(a, "^[^=]*=", ""), F.lit("\"'"))
                    ).alias("value"),
                ),
            ).alias("attrs"),
        )

    return F.transform(F.split(col(expression), ","), lambda alt: F.transform(_tokens(alt), step))


def selector_supported(expression: Column | str) -> Column:
    tokens = F.flatten(F.transform(F.split(col(expression), ","), _tokens))
    return F.forall(tokens, lambda t: (t != "") & (t != ">") & t.rlike(SELECTOR_TOKEN))


def _matches(node: Column, step: Column) -> Column:
    return (
        (step["tag"].isNull() | (node["tag"] == step["tag"]))
        & (step["id"].isNull() | F.coalesce(node["id"] == step["id"], F.lit(False)))
        & (F.size(F.array_except(step["classes"], node["classes"])) == 0)
        & F.forall(
            step["attrs"],
            lambda a: F.map_contains_key(node["attrs"], a["name"])
            & (a["value"].isNull() | F.coalesce(F.try_element_at(node["attrs"], a["name"]) == a["value"], F.lit(False))),
        )
    )


def select_nodes(nodes: Column, alternatives: Column) -> Column:
    """Nodes matched by a parsed selector, in document order.

    The steps are folded left to right; each keeps the nodes that match and lie in the range of a node kept before.
    """

    def follow(steps: Column) -> Column:
        first = F.filter(nodes, lambda n: _matches(n, F.get(steps, F.lit(0))))

        def narrow(kept: Column, step: Column) -> Column:
            return F.filter(
                nodes,
                lambda n: _matches(n, step)
                & F.exists(
                    kept,
                    lambda a: (n["node"] > a["node"])
                    & (n["node"] <= a["last"])
                    & (~step["child"] | (n["parent"] == a["node"])),
                ),
            )

        return F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), first, narrow)

    def merge(hits: Column) -> Column:
        return F.when(F.size(alternatives) == 1, hits).otherwise(
            F.filter(nodes, lambda n: F.exists(hits, lambda h: h["node"] == n["node"]))
        )

    return let(F.flatten(F.transform(alternatives, follow)), merge)


def inside(nodes: Column, item: Column) -> Column:
    """The node itself and everything below it: a slice while the numbering has no gaps, else a filter."""
    gapless = F.element_at(nodes, -1)["node"] == F.size(nodes) - 1
    return F.when(gapless, F.slice(nodes, item["node"] + 1, item["last"] - item["node"] + 1)).otherwise(
        F.filter(nodes, lambda n: (n["node"] >= item["node"]) & (n["node"] <= item["last"]))
    )


def node_value(node: Column, attribute: Column, page_text: Column, html: Column) -> Column:
    """Text (default), outer markup with the text that follows it, direct text, or an attribute; null when absent."""
    mode = F.coalesce(attribute, F.lit("text"))
    return (
        F.when(mode == "text", _text_between(page_text, node["text_start"], node["text_end"]))
        .when(mode.isin("html", "inner_html"), _outer(html, node))
        .when(mode == "own_text", fold_space(node["own"]))
        .otherwise(F.try_element_at(node["attrs"], mode))
    )


def _outer(html: Column, node: Column) -> Column:
    markup = F.substring(html, node["html_start"] + 1, node["tail_end"] - node["html_start"])
    return F.replace(markup, F.lit(BLANK), F.lit(""))


def drop_nodes(shredded: DataFrame, selectors: Iterable[str] | Column = fixed.CLEAN_SELECTORS) -> DataFrame:
    """Remove matching subtrees: their nodes go, and their text and markup are blanked where they stood.

    Offsets of the remaining nodes stay valid because the removed characters are overwritten, not cut out; the
    overwritten text is dropped again when a value is read (``\\x00`` never survives parsing).
    """
    if isinstance(selectors, Column):
        alternatives = F.flatten(F.transform(selectors, parse_selector))
    else:
        alternatives = parse_selector(F.lit(",".join(selectors)))
    gone = select_nodes(F.col("nodes"), alternatives)
    out = shredded.withColumn("_gone", F.transform(gone, lambda g: F.struct(*[g[k].alias(k) for k in _SPANS])))
    kept = F.filter(
        F.col("nodes"),
        lambda n: ~F.exists(F.col("_gone"), lambda g: (n["node"] >= g["node"]) & (n["node"] <= g["last"])),
    )
    return out.withColumns(
        {
            "nodes": kept,
            "page_text": _blank_spans(F.col("page_text"), "text_start", "text_end"),
            "html": _blank_spans(F.col("html"), "html_start", "html_end"),
        }
    ).drop("_gone")


_SPANS = ("node", "last", "text_start", "text_end", "html_start", "html_end")


def _blank_spans(text: Column, start: str, end: str) -> Column:
    return F.aggregate(
        F.col("_gone"),
        text,
        lambda acc, g: F.overlay(acc, F.repeat(F.lit(BLANK), g[end] - g[start]), g[start] + 1, g[end] - g[start]),
    )


def drop_markup(html: Column | str, tags: Iterable[str] = fixed.CLEAN_SELECTORS) -> Column:
    """Pattern form of ``drop_nodes`` for whole elements that do not nest; stays in the JVM."""
    out = col(html)
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out
