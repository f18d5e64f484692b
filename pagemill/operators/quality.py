"""Cleaning, the quality gate with reasons, and where its thresholds come from."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.core import NOT_SPACE, let, strip
from pagemill.functions.text import (
    clean_text, content_hash, count_words, normalize_text, repeat_line_ratio, script_ratio,
)
from pagemill.sizes import join_small


@dataclass(frozen=True)
class ContentPolicy:
    """Thresholds; each may be a number or a column (see ``resolve_policy``)."""

    min_length: int | Column = fixed.MIN_LENGTH
    max_length: int | Column = fixed.MAX_LENGTH
    min_script_ratio: float | Column = fixed.MIN_SCRIPT_RATIO
    max_repeat_line_ratio: float | Column = fixed.MAX_REPEAT_LINE_RATIO
    reject_on_empty: bool = True
    script: str = fixed.CJK_CLASS


def quality_gate(text: Column, policy: ContentPolicy = ContentPolicy()) -> Column:
    """struct(reason, measure, threshold) of the first failing rule, null when the text passes.

    The rules are nested so that a dearer measure is taken only once and only for texts that passed the cheaper ones.
    """

    def verdict(reason: str, measure: Column, threshold: Column) -> Column:
        return F.struct(
            F.lit(reason).alias("reason"),
            measure.cast("double").alias("measure"),
            threshold.cast("double").alias("threshold"),
        )

    low, high, script_min, repeat_max = (
        value if isinstance(value, Column) else F.lit(value)
        for value in (policy.min_length, policy.max_length, policy.min_script_ratio, policy.max_repeat_line_ratio)
    )
    empty = F.lit(policy.reject_on_empty) & ~text.rlike(NOT_SPACE)

    def by_repeat(ratio: Column) -> Column:
        return F.when(ratio > repeat_max, verdict("high_repeat_ratio", F.round(ratio, 4), repeat_max))

    def by_script(ratio: Column) -> Column:
        return F.when(
            ratio < script_min, verdict("low_script_ratio", F.round(ratio, 4), script_min)
        ).otherwise(let(repeat_line_ratio(text), by_repeat))

    length = F.length(text)
    return (
        F.when(empty, verdict("empty", length, F.lit(None)))
        .when(length < low, verdict("too_short", length, low))
        .when(length > high, verdict("too_long", length, high))
        .otherwise(let(script_ratio(text, policy.script), by_script))
    )


def process_content(
    df: DataFrame,
    text: str = "text",
    policy: ContentPolicy = ContentPolicy(),
    extra_junk: Iterable[str] = (),
) -> DataFrame:
    """Clean, normalise, gate, count and hash; adds ``body, rejected, word_count, content_hash``.

    Rejected rows keep their reason and stay in the result, so one bad row never stops a batch. The four values come
    out of one generator: a later filter on ``rejected`` is not pushed below it, so no text is cleaned twice.
    """
    def measure(body: Column) -> Column:
        return F.struct(
            body.alias("body"),
            quality_gate(body, policy).alias("rejected"),
            count_words(body).alias("word_count"),
            content_hash(body).alias("content_hash"),
        )

    keep = [F.col(c) for c in df.columns]
    done = let(normalize_text(clean_text(text, extra_junk)), measure)
    return df.select(*keep, F.inline(F.array(done)))


def accepted(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("rejected").isNull()).drop("rejected")


def rejected(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("rejected").isNotNull()).select(
        *[c for c in processed.columns if c not in ("rejected", "body", "word_count", "content_hash")], "rejected.*"
    )


def fallback_content(df: DataFrame, text: str = "text") -> DataFrame:
    """The path without a gate: strip, count, hash."""
    return (
        df.withColumn("body", strip(text))
        .withColumn("word_count", count_words("body"))
        .withColumn("content_hash", content_hash("body"))
    )


THRESHOLDS = tuple(f.name for f in fields(ContentPolicy) if f.name not in ("reject_on_empty", "script"))


def resolve_policy(
    df: DataFrame,
    task_policies: DataFrame | None = None,
    source_policies: DataFrame | None = None,
    global_policy: dict | None = None,
    task_key: str = "task_id",
    source_key: str = "source_id",
    script: str = fixed.CJK_CLASS,
) -> tuple[DataFrame, ContentPolicy]:
    """Attach thresholds in the order task, source, global, default; returns the rows and a policy of columns."""
    layers: dict[str, list[Column]] = {name: [] for name in THRESHOLDS}
    for label, policies, key in (("task", task_policies, task_key), ("source", source_policies, source_key)):
        if policies is None:
            continue
        known = [n for n in THRESHOLDS if n in policies.columns]
        renamed = policies.select(key, *[F.col(n).alias(f"_{label}_{n}") for n in known])
        df = join_small(df, renamed, key, "left")
        for name in known:
            layers[name].append(F.col(f"_{label}_{name}"))
    defaults = ContentPolicy()
    chosen = {}
    for name in THRESHOLDS:
        fallback = (global_policy or {}).get(name, getattr(defaults, name))
        chosen[f"policy_{name}"] = F.coalesce(*layers[name], F.lit(fallback))
    out = df.withColumns(chosen).drop(*[c for c in df.columns if c.startswith(("_task_", "_source_"))])
    return out, ContentPolicy(**{n: F.col(f"policy_{n}") for n in THRESHOLDS}, script=script)
