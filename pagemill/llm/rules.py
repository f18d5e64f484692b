"""Quality rules as a bitmask ledger: every rule is evaluated once per document, policies are applied to the stored bits.

The ledger holds the measurements and one long whose bit k says that rule k failed. A policy is a mask over the bits with a
version; applying another one, or asking what a rule contributes, reads the bits and never the texts again. Native column
functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.core import let

#: The characters that separate words, and those that count as symbols.
SPACES = "\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule by name; ``failed`` is true for a row of measurements that breaks it."""

    name: str
    failed: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule("many_symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    Rule("short_words", lambda m: m("word_chars") < m("n_words") * 2),
    Rule("long_words", lambda m: m("word_chars") > m("n_words") * 20),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(r.name for r in RULES))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, first occurrences included.

    Windows are sorted with their places, equal neighbours mark places, and the marked windows are united: n log n for a text
    of n words, whatever repeats in it.
    """
    last = F.size(words) - 2
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i"))
    )

    def marked(s: Column) -> Column:
        same = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), x["i"]))
        return F.sort_array(F.array_compact(same))

    def covered(p: Column) -> Column:
        width = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(F.sort_array(windows), marked), covered)


def measures(text: Column) -> Column:
    """All measurements of a text as one struct; null counts as empty."""

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_words(words: Column, whole: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
        lines = let(F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)), of_lines)
        symbols = F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS + "+", ""))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            lines.alias("lines"), repeat_words(words).alias("n_repeat_words"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda w: of_words(w, t)))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``failed_bits``. Null and empty texts have no words; their measurements are 0."""
    # a generator keeps the optimizer from copying the measurements into every use of them
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(measures(F.col("text")))).alias("m"))
    flat = one.select("doc_id", *[F.col(f"m.lines.{n}" if n in ("n_lines", "n_dup_lines") else f"m.{n}").alias(n) for n in MEASURES])
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.failed(F.col), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return flat.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``kept`` and ``policy``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0).withColumn("policy", F.lit(policy.version))


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that the policy keeps without it.

    Bit patterns are counted first, at most two to the number of rules; everything else is read from these counts.
    """
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in rules]
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in policy.rules]))
    crossed = patterns.select("bits", "n", listed.alias("r")).select("bits", "n", "r.*")
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return crossed.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
        F.coalesce(F.sum(F.when(rest == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
    ).withColumn("policy", F.lit(policy.version))


def quality(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """``doc_id``, the base measurements, ``base_failed``, ``kept`` and the ledger bits of every document.

    ``kept`` never holds where the base rules fail. Repeated rows and null ids come back as they are; further columns are
    ignored; an empty table gives no rows.
    """
    judged = apply_policy(ledger(docs), policy)
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE.mask())) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (F.col("kept") & ~base).alias("kept"), "failed_bits",
    )
