"""Rules as data: catalogue checks, request rendering, admission, coverage and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.core import literal_map
from pagemill.functions.naming import render_template, template_variables, unknown_variables
from pagemill.functions.text import fold_ascii_case  # noqa: F401
from pagemill.functions.urls import request_host, url_host
from pagemill.functions.values import asset_suffix
from pagemill.operators.extract import parse_rule, rule_rejects, transform_rejects
from pagemill.operators.transforms import OPS
from pagemill.sizes import join_small


# --- requests -----------------------------------------------------------------------------------------------------
def render_map(templates: Column, values: Column) -> Column:
    return F.transform_values(
        F.coalesce(templates, F.create_map().cast("map<string,string>")),
        lambda k, v: render_template(v, values, fixed.REQUEST_VARIABLE),
    )


def build_requests(requests: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch list: request templates of a source filled for its work items.

    ``requests``: source_id, capability, method, url, headers, default_headers, query, body, encoding, timeout_ms.
    ``items``: source_id, capability, item_id, vars (map). Unknown variables make a row a reject with their names.
    """
    joined = join_small(items, requests, ["source_id", "capability"])
    none = F.create_map().cast("map<string,string>")
    headers = F.map_concat(F.coalesce("default_headers", none), F.coalesce("headers", none))
    texts = F.concat(
        F.array(F.col("url"), F.coalesce("body", F.lit(""))), F.map_values(headers), F.map_values(F.coalesce("query", none))
    )
    unknown = F.array_distinct(F.flatten(F.transform(texts, lambda t: unknown_variables(t, F.col("vars")))))
    judged = joined.withColumn("unknown", unknown)
    ready = judged.filter(F.size("unknown") == 0).select(
        "source_id", "capability", "item_id", F.upper("method").alias("method"),
        render_template("url", F.col("vars"), fixed.REQUEST_VARIABLE).alias("url"),
        render_map(headers, F.col("vars")).alias("headers"),
        render_map(F.col("query"), F.col("vars")).alias("params"),
        F.when(F.col("body").isNotNull(), render_template("body", F.col("vars"), fixed.REQUEST_VARIABLE)).alias("body"),
        "encoding", "timeout_ms",
    )
    return ready, judged.filter(F.size("unknown") > 0).select("source_id", "capability", "item_id", "unknown")


# --- admission ----------------------------------------------------------------------------------------------------
def host_suffixes(host: Column) -> Column:
    """a.b.c gives a.b.c, b.c and c, so that 'equal or subdomain' becomes an equality."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )


def domain_admission(
    rows: DataFrame, source_domains: DataFrame, global_domains: DataFrame | None = None, url: str = "url"
) -> DataFrame:
    """Adds ``admitted``: the host is an allowed domain of its source or below one, and of the global list too.

    ``source_domains``: source_id, domain. A source without domains allows all, and so does an absent global list.
    Per-source domains are gathered (a handful per source) and tested against the suffixes of the host inside the row,
    so rows are never multiplied; the global list is a membership test by semi join on the suffix.
    """
    suffixes = host_suffixes(request_host(url))
    own = source_domains.groupBy("source_id").agg(F.collect_set("domain").alias("_own"))
    out = join_small(rows, own, "source_id", "left")
    out = out.withColumn("admitted", F.coalesce(F.arrays_overlap(suffixes, "_own"), F.lit(True))).drop("_own")
    if global_domains is None:
        return out
    hosts = out.select(request_host(url).alias("_host")).distinct()
    listed = (
        hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
        .join(global_domains.select("domain").distinct(), "domain", "left_semi")
        .select("_host", F.lit(True).alias("_listed")).distinct()
    )
    open_list = global_domains.limit(1).agg((F.count("*") == 0).alias("e")).scalar()
    return (
        out.withColumn("_host", request_host(url)).join(listed, "_host", "left")
        .withColumn("admitted", F.col("admitted") & (open_list | F.coalesce("_listed", F.lit(False))))
        .drop("_host", "_listed")
    )


def asset_admission(assets: DataFrame, at: str = "fetched_at", max_bytes: int = fixed.MAX_ASSET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Images of a known kind and size; the latest per book. Rejects carry a reason."""
    judged = assets.withColumns(
        {
            "suffix": asset_suffix("url", "content_type"),
            "reason": F.when(F.octet_length("content") > max_bytes, "too_large"),
        }
    ).withColumn("reason", F.coalesce("reason", F.when(F.col("suffix").isNull(), "unknown_format")))
    good = judged.filter(F.col("reason").isNull())
    # the winner is chosen on narrow columns; bodies are fetched by key afterwards
    latest = good.groupBy("book_id").agg(F.max_by(F.struct("asset_id", "suffix"), F.struct(at, "asset_id")).alias("_w"))
    current = latest.select("book_id", "_w.*", F.concat(F.lit("covers/"), F.col("book_id"), F.col("_w.suffix")).alias("path"))
    return current, judged.filter(F.col("reason").isNotNull()).select("asset_id", "book_id", "reason")


# --- catalogue checks ---------------------------------------------------------------------------------------------
def valid_source_id(value: Column) -> Column:
    return value.rlike(fixed.SOURCE_ID_PATTERN)


def valid_version(value: Column) -> Column:
    return value.rlike(fixed.VERSION_PATTERN)


def capability_consistency(declared: DataFrame, provided: DataFrame) -> DataFrame:
    """Declared iff provided (source_id, capability); the mismatches with their kind."""
    a = declared.select("source_id", "capability", F.lit(True).alias("_d")).distinct()
    b = provided.select("source_id", "capability", F.lit(True).alias("_p")).distinct()
    both = a.join(b, ["source_id", "capability"], "full_outer")
    kind = F.when(F.col("_p").isNull(), "declared_not_provided").when(F.col("_d").isNull(), "provided_not_declared")
    return both.select("source_id", "capability", kind.alias("problem")).filter("problem IS NOT NULL")


def _report(rows: DataFrame, severity: str, path: Column, message: Column, hint: Column) -> DataFrame:
    return rows.select(
        "source_id", F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"), hint.alias("hint")
    )


def lint_rules(
    sources: DataFrame, rules: DataFrame, templates: DataFrame, removes: DataFrame, transforms: DataFrame | None = None
) -> DataFrame:
    """Findings (source_id, severity, path, message, hint).

    ``sources``: source_id, allowed (array of domains), engine_min_version, engine_max_version (may be absent).
    ``rules``: source_id, capability, field, rule. ``templates``: source_id, capability, path, template (request URLs
    have the path ``request.url``). ``removes``: source_id, selector (the clean list of the content capability).
    """
    text = F.concat
    checks = []
    # unknown variables
    loose = templates.select(
        "source_id", "capability", "path", F.explode(template_variables("template")).alias("name")
    ).filter(~F.col("name").isin(*fixed.KNOWN_VARIABLES) & ~F.startswith("name", F.lit("config.")))
    checks.append(
        _report(loose, "error", text("capability", F.lit("."), "path"), text(F.lit("unknown variable "), "name"),
                F.lit("known: " + ", ".join(sorted(fixed.KNOWN_VARIABLES))))
    )
    # hosts outside the allow list
    urls = templates.filter(F.col("path") == "request.url").withColumn("host", url_host("template"))
    outside = join_small(urls, sources.select("source_id", "allowed"), "source_id").filter(
        F.col("host").isNotNull() & (F.size("allowed") > 0) & ~F.arrays_overlap(host_suffixes(F.col("host")), "allowed")
    )
    checks.append(
        _report(outside, "error", text("capability", F.lit(".request.url")), text(F.lit("host not allowed: "), "host"),
                text(F.lit("allow "), "host"))
    )
    checks.append(
        _report(sources.filter(F.size("allowed") == 0), "warning", F.lit("permissions.network"), F.lit("no allowed domains"),
                F.lit("list the domains the source visits"))
    )
    # clean list
    present = removes.groupBy("source_id").agg(F.collect_set("selector").alias("have"))
    content = rules.filter(F.col("capability") == "content").select("source_id").distinct()
    lacking = content.join(present, "source_id", "left").select(
        "source_id",
        F.explode(F.array_except(F.array(*[F.lit(s) for s in fixed.CLEAN_SELECTORS]),
                                 F.coalesce("have", F.array().cast("array<string>")))).alias("selector"),
    )
    checks.append(
        _report(lacking, "warning", F.lit("content.clean.remove"), text(F.lit("not removed: "), "selector"),
                text(F.lit("add "), "selector"))
    )
    # search fields
    fields = rules.filter(F.col("capability") == "search").groupBy("source_id").agg(F.collect_set("field").alias("have"))
    for severity, names in (("error", ("title", "url")), ("warning", ("author",))):
        short = fields.select("source_id", F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), "have")).alias("name"))
        checks.append(
            _report(short, severity, text(F.lit("search.result.fields."), "name"), text(F.lit("missing field "), "name"),
                    text(F.lit("add a rule for "), "name"))
        )
    # rules that cannot be evaluated
    parsed = rules.withColumn("r", parse_rule("rule"))
    hints = {
        "unsupported selector": "use tag, .class, #id, [attr], descendant, > and comma", "unsupported path": "use steps, [@name='value'], @name and text()",
        "unsupported JSON path": "use $, .name, ['name'], [n] and [*]", "unusable pattern": "write a pattern that compiles", "empty attribute": "name an attribute",
    }
    broken = rule_rejects(rules).filter(F.col("problem") != "empty rule").withColumn("r", parse_rule("rule"))
    checks.append(
        _report(broken, "error", text("capability", F.lit("."), "field"), text("problem", F.lit(" "), "r.expression"),
                F.element_at(literal_map(hints), F.col("problem")))
    )
    wrong_list = parsed.filter((F.col("field") == "list") & F.col("r.rule_type").isin("xpath", "regex", "attr"))
    checks.append(
        _report(wrong_list, "error", text("capability", F.lit(".list")), text(F.lit("list rule of type "), "r.rule_type"),
                F.lit("use a selector or a JSON path"))
    )
    # transforms that cannot run
    if transforms is not None:
        advice = {
            "unknown transform": "use one of " + ", ".join(OPS), "no pattern": "give a pattern", "unusable pattern": "write a pattern that compiles",
            "unusable replacement": "name groups that the pattern has",
        }
        where = text(F.coalesce("capability", F.lit("transforms")), F.lit("."), F.col("ord").cast("string"))
        what = text("problem", F.lit(" "), F.coalesce("op", F.lit("")), F.lit(" "), F.coalesce("pattern", F.lit("")))
        checks.append(_report(transform_rejects(transforms), "error", where, what, F.element_at(literal_map(advice), F.col("problem"))))
    return reduce(DataFrame.unionByName, checks)


def lint_summary(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Errors, warnings and verdict of every source; a source without findings is ready."""
    counts = findings.groupBy("source_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    zero = F.lit(0)
    return sources.select("source_id").join(counts, "source_id", "left").select(
        "source_id", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"),
        F.when(F.coalesce("errors", zero) == 0, "READY").otherwise("BROKEN").alias("result"),
    )


def supported_version(low: Column, high: Column, engine: tuple[int, int, int]) -> Column:
    """Engine version inside the declared bounds; absent bounds are open."""

    def parts(v: Column) -> Column:
        return F.transform(F.slice(F.split(F.regexp_extract(v, r"^(\d+\.\d+\.\d+)", 1), r"\."), 1, 3), lambda p: p.cast("int"))

    here = F.array(*[F.lit(p) for p in engine])
    return F.coalesce(parts(low) <= here, F.lit(True)) & F.coalesce(here <= parts(high), F.lit(True))


def source_health(summary: DataFrame, home_pages: DataFrame) -> DataFrame:
    """Rule errors make a source broken, an unreachable home page alone makes it degraded."""
    reach = home_pages.groupBy("source_id").agg(F.max((F.col("status_code") == 200).cast("int")).alias("_up"))
    joined = summary.join(reach, "source_id", "left")
    health = F.when(F.col("errors") > 0, "broken").when(F.col("_up") == 0, "degraded").otherwise("healthy")
    return joined.select("source_id", "errors", health.alias("health"))


def extraction_coverage(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Per source, capability and field: items, matched, empty, verdict.

    ``records``: source_id, capability, record (map). ``expected``: source_id, capability, field.
    A capability of the catalogue without any output fails, and so does a body that is always blank.
    """
    cells = records.select("source_id", "capability", F.explode_outer("record").alias("field", "value"))
    counts = cells.groupBy("source_id", "capability", "field").agg(
        F.count("*").alias("items"), F.count_if(F.trim("value") != "").alias("matched")
    )
    joined = expected.distinct().join(counts, ["source_id", "capability", "field"], "left")
    items, matched = F.coalesce("items", F.lit(0)), F.coalesce("matched", F.lit(0))
    return joined.select(
        "source_id", "capability", "field", items.alias("items"), matched.alias("matched"), (items - matched).alias("empty"),
        F.when((items == 0) | ((F.col("capability") == "content") & (matched == 0)), "fail").otherwise("ok").alias("verdict"),
    )
