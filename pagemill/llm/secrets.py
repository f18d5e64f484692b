"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control for what they miss.

Candidates are all long tokens. The encoding of a candidate is inferred (hexadecimal, base 32, 36, 62 and 64, or the union of
both kinds of base 64) and gives an alphabet; uniformity of the alphabet (chi-squared), runs about the middle of the alphabet,
serial correlation, and runs of one class of characters together with the share of common letters (words and names stay in a
class and prefer e, t, a, o, i, n, s, r) are tested against random characters. The smallest of the four p-values, corrected for taking the smallest,
says how unlike random characters the token is. Tests on short tokens are weak, so the Benjamini-Hochberg step that
declares tokens ordinary is made within classes of length, over all documents, from a histogram of bounded size. What it
doesn't declare ordinary is reported. Native column functions only; every text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.core import let
from pagemill.session import cut_lineage

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings by the pattern of all their characters, and their alphabets; the first that fits is taken.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("either", "^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
COMMON = "etaoinsrETAOINSR"
CLASS_RUN = "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
LENGTH_CLASSES = (20, 28, 40, 64, 128)
FDR = 0.01
BINS = 400
SPAN = "array<struct<start:bigint,rank:int,stop:bigint>>"


def _places(text: Column, pattern: str, keep) -> Column:  # noqa: ANN001
    """Code point spans of the leftmost non-overlapping matches: lengths of the pieces between matches are summed."""

    def walk(found: Column, pieces: Column) -> Column:
        step = F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
        empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))

        def add(a: Column, s: Column) -> Column:
            lo = a["at"] + s["gap"]
            span = F.struct(lo.alias("start"), (lo + s["len"]).alias("stop"))
            return F.struct((lo + s["len"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return keep(F.aggregate(step, empty, add)["out"], found)

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(every, lambda found: let(F.split(text, pattern, -1), lambda pieces: walk(found, pieces)))


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and kind. Cheap tests decide whether a text needs the slower patterns."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    long_enough = lambda least: lambda spans, found: F.filter(spans, lambda s: s["stop"] - s["start"] >= least)

    def valued(spans: Column, _found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        return let(values, lambda v: F.filter(spans, lambda s, i: F.length(F.get(v, i)) >= ASSIGN_LEAST))

    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(F.lower(text), F.lit(word))
    assign = F.when(named, _places(text, ASSIGN, valued)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _places(text, ACCESS, long_enough(ACCESS_LEAST))).otherwise(none)
    # a run that is long enough is matched whole by the bounded pattern too, and short runs are skipped without a span
    digits = F.when(text.rlike("[0-9a-f]{%d}" % HEX_LEAST), _places(text, "[0-9a-f]{%d,}" % HEX_LEAST, long_enough(HEX_LEAST))).otherwise(none)
    return F.sort_array(F.concat(*[_ranked(s, k) for k, s in enumerate((assign, access, digits))]).cast(SPAN))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the logistic approximation (error below 0.0002)."""
    return let(F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0)), lambda z: 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z)))


def _class_shares(letters: str) -> tuple[float, float, float]:
    """Chances that two, and that three, random characters of the alphabet are of one class, and that one is a common letter."""
    kinds = (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())
    shares = [sum(map(kind, letters)) / len(letters) for kind in kinds]
    return sum(x**2 for x in shares), sum(x**3 for x in shares), sum(c in COMMON for c in letters) / len(letters)


def nonrandom_p(token: Column) -> Column:
    """p-value of the battery under random characters of the inferred encoding; null if no encoding fits."""
    body = F.rtrim(token, F.lit("="))
    alphabet = F.lit(None).cast("struct<letters:string,two:double,three:double,common:double>")
    for _, pattern, letters in reversed(ENCODINGS):
        named = zip(("letters", "two", "three", "common"), (letters, *_class_shares(letters)), strict=True)
        alphabet = F.when(body.rlike(pattern), F.struct(*[F.lit(v).alias(k) for k, v in named])).otherwise(alphabet)

    def battery(x: Column) -> Column:
        s, (letters, two, three, common) = x["body"], [x["alphabet"][k] for k in ("letters", "two", "three", "common")]
        n, k = F.length(s).cast("double"), F.length(letters).cast("double")
        squares = F.aggregate(
            F.split(letters, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
        )
        df = k - 1
        chi = (squares * k / n - n) * n / (n - 1)
        hilferty = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        values = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(letters, c).cast("double") - (k + 1) / 2)

        same = n - F.regexp_count(s, F.lit(CLASS_RUN)).cast("double")  # neighbours of one class
        spread_same = (n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two * two)
        often = F.regexp_count(s, F.lit(f"[{COMMON}]")).cast("double")
        z_class = ((same - (n - 1) * two) / F.sqrt(spread_same) + (often - n * common) / F.sqrt(n * common * (1 - common))) / F.sqrt(F.lit(2.0))

        def ordered(v: Column) -> Column:
            high = F.aggregate(v, F.lit(0.0), lambda a, y: a + F.when(y > 0, 1.0).otherwise(0.0))
            runs = F.aggregate(F.transform(v, lambda y, i: F.when((i > 0) & ((y > 0) == (F.get(v, i - 1) > 0)), 0.0).otherwise(1.0)), F.lit(0.0), lambda a, y: a + y)
            mean = 2 * high * (n - high) / n + 1
            variance = (mean - 1) * (mean - 2) / (n - 1)
            z_runs = F.when(variance > 0, F.abs(runs - mean) / F.sqrt(variance)).otherwise(12.0)

            def serial(mid: Column) -> Column:  # bound, or it would be summed again for every character
                spread = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mid) * (y - mid))
                pairs = F.aggregate(F.transform(v, lambda y, i: F.when(i > 0, (y - mid) * (F.get(v, i - 1) - mid)).otherwise(0.0)), F.lit(0.0), lambda a, y: a + y)
                return F.when(spread > 0, F.abs(pairs / spread) * F.sqrt(n)).otherwise(12.0)

            z_serial = let(F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n, serial)
            return F.least(F.lit(1.0), 4 * F.least(_tail(hilferty), _tail(z_class), 2 * _tail(z_runs), 2 * _tail(z_serial)))

        return let(values, ordered)

    whole = let(F.struct(body.alias("body"), alphabet.alias("alphabet")), lambda x: F.when(x["alphabet"].isNotNull(), battery(x)))
    return whole


def _candidates(text: Column, base: Column) -> Column:
    """Candidate tokens outside the base spans with length and p-value."""

    def found(spans: Column, tokens: Column) -> Column:
        apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        all_of = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.get(tokens, i).alias("token")))
        kept = F.filter(all_of, apart)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), nonrandom_p(x["token"]).alias("p")))

    none = F.array().cast("array<struct<start:bigint,stop:bigint,p:double>>")
    return F.when(text.rlike(CANDIDATE), _places(text, CANDIDATE, found)).otherwise(none)


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTH_CLASSES):
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def ordinary_below(candidates: DataFrame, rate: float = FDR) -> dict[int, float]:
    """Per class of length, the p-value up to which Benjamini-Hochberg declares tokens ordinary at the given rate.

    ``candidates`` has ``length`` and ``p``. p-values are counted in ``BINS`` logarithmic bins, so at most BINS rows per class
    reach the driver, whatever the number of tokens; a bin is judged by its upper edge.
    """
    place = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-40))) * 10), F.lit(BINS - 1)).cast("int")
    counted = candidates.filter("p IS NOT NULL").groupBy(length_class(F.col("length")).alias("c"), place.alias("b")).count().collect()
    out: dict[int, float] = {}
    for c in range(len(LENGTH_CLASSES)):
        bins = sorted(((r["b"], r["count"]) for r in counted if r["c"] == c), reverse=True)  # from the smallest p
        total, below = sum(n for _, n in bins), 0
        for b, n in bins:
            below += n
            edge = 10 ** (-b / 10)
            if edge * total <= rate * below:
                out[c] = edge
    return out


def _scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    both = let(base_spans(text), lambda base: F.struct(base.alias("base"), _candidates(text, base).alias("found")))
    return docs.select(*columns, F.explode(F.array(both)).alias("s")).select(*columns, "s.base", "s.found")


def _reported(base: Column, found: Column, limits: dict[int, float]) -> Column:
    def random(s: Column) -> Column:
        edge = F.lit(-1.0)
        for c, value in limits.items():
            edge = F.when(length_class(s["stop"] - s["start"]) == c, F.lit(value)).otherwise(edge)
        return s["p"] > edge

    return F.sort_array(F.concat(base, _ranked(F.filter(found, random), 3).cast(SPAN)))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(each, ",")


def find_secrets(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` of every document.

    Spans are ``kind:start:end`` in code points, the end exclusive. Null texts count as empty and have no span. Repeated rows
    and null ids come back as they are; further columns are ignored; an empty table gives no rows.
    """
    scanned = cut_lineage(_scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    each = scanned.select(F.explode("found").alias("f")).select((F.col("f.stop") - F.col("f.start")).alias("length"), "f.p")
    reported = scanned.select("doc_id", "base", _reported(F.col("base"), F.col("found"), ordinary_below(each, rate)).alias("all"))
    count = lambda rank: F.size(F.filter("all", lambda s: s["rank"] == rank)).cast("long")
    return reported.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
    )


MASK = "[SECRET]"


def mask_secrets(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced by ``[SECRET]``; overlapping spans are replaced once.

    Every text is scanned twice, once for the limits of the false-discovery step and once to replace. Null texts stay null.
    """
    names = [f"`{c}`" for c in docs.columns]
    row = F.struct(*names)
    each = _scan(docs.select("text"), []).select(F.explode("found").alias("f"))
    limits = ordinary_below(each.select((F.col("f.stop") - F.col("f.start")).alias("length"), "f.p"), rate)
    scanned = _scan(docs.select("text", row.alias("row")), ["row"])

    def rest(a: Column, text: Column) -> Column:
        return F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))

    def masked(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            gap = F.substring(text, a["at"] + 1, s["start"].cast("int") - a["at"])
            fresh = F.struct(s["stop"].cast("int").alias("at"), F.concat(a["out"], gap, F.lit(MASK)).alias("out"))
            longer = F.struct(F.greatest(a["at"], s["stop"].cast("int")).alias("at"), a["out"].alias("out"))
            return F.when(s["start"] >= a["at"], fresh).otherwise(longer)

        return F.aggregate(spans, start, step, lambda a: rest(a, text))

    spans = _reported(F.col("base"), F.col("found"), limits)
    text = F.col("row.text")
    new = F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(masked(text, spans))
    return scanned.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
