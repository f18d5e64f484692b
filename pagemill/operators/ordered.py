"""Running values over long ordered groups, without sorting a whole group in one task.

A window ordered over a key that holds a third of all rows sorts that third in one task. Here the order is cut into
ranges; totals per (key, range) are taken map-side and prefix-summed (a table with one row per range), then each range
is finished on its own. Rows are shuffled once, by (key, range), so a hot key is spread over its ranges.

Ranges come from a fixed ``width`` of the first order column where its values are known to be spread out (an index that
is unique in its book), and otherwise from splitters taken from a sample of (key, order) tuples, which also cut through
ties of the first order column. Count and sample are subqueries of the same query: nothing runs while a plan is built, and no
sample reaches the driver. They read the key and order columns only; what is costly to compute is better written first. Null keys form a key of their own and null order values come first; the order tuple should
be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.core import let

RANGE = "_range"
PER_RANGE = 16


def with_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None = None, ranges: int | None = None
) -> DataFrame:
    """Add the range number: rising with the order inside each key. ``ranges`` defaults to four per shuffle partition. Rows that
    have range numbers already keep them, also through the functions below, so several passes can share one cut."""
    if RANGE in df.columns:
        return df
    if width is not None:
        first = F.floor(F.col(order[0]).cast("double") / F.lit(float(width))).cast("long")
        return df.withColumn(RANGE, F.coalesce(first, F.lit(-(1 << 62))))
    if ranges is None:
        ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*keys, *order)
    found = df.withColumn("_splitters", _splitters(df.select(place.alias("o")), ranges))
    # the optimizer puts the subquery into the expression, so the splitters are one constant and travel with no row
    number = let(F.col("_splitters"), lambda s: let(place, lambda here: _bisected(s, here, ranges)))
    return found.withColumn(RANGE, number.cast("long")).drop("_splitters")


def _splitters(places: DataFrame, ranges: int) -> Column:
    """Ascending tuples that cut the order into about ``ranges`` parts, as a subquery that runs with the query it is used in.

    An even sample by hash, so that any re-run picks the same tuples; equal tuples count once, so the sample is about
    ranges * PER_RANGE narrow rows whatever the size and the skew of the input.
    """
    rows = places.agg(F.count(F.lit(1))).scalar()
    sampled = places.withColumn("_rows", rows).filter(
        F.pmod(F.xxhash64("o"), F.lit(1 << 40)) < F.least(F.lit(1.0), F.lit(float(ranges * PER_RANGE)) / F.greatest("_rows", F.lit(1))) * float(1 << 40)
    )
    chosen = sampled.select("o").distinct().agg(F.sort_array(F.collect_list("o")).alias("all"))
    stride = F.greatest(F.lit(PER_RANGE), F.floor(F.size("all") / F.lit(ranges))).cast("int")
    cuts = F.floor((F.size("all") - 1) / F.col("stride")).cast("int")
    at = F.when(F.col("cuts") > 0, F.sequence(F.lit(1), F.col("cuts"))).otherwise(F.array().cast("array<int>"))
    strided = chosen.withColumn("stride", stride).withColumn("cuts", cuts)
    return strided.select(F.transform(at, lambda k: F.get("all", k * F.col("stride"))).alias("splitters")).scalar()


def _bisected(splitters: Column, here: Column, ranges: int) -> Column:
    """How many splitters lie at or before a place, in log2(ranges) comparisons."""
    steps = [1 << k for k in reversed(range((2 * ranges + PER_RANGE).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(k) for k in steps]), F.lit(0),
        lambda at, step: F.when(F.get(splitters, at + step - 1) <= here, at + step).otherwise(at),
    )


def rejoin(rows: DataFrame, per_range: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring values per (key, range) back to the rows; equal nulls meet, so no row is lost."""
    on = [*keys, RANGE]
    side = per_range.withColumnsRenamed({c: f"_r_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return rows.join(side, met).drop(*[f"_r_{c}" for c in on])


def _before(keys: Sequence[str]):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _local(keys: Sequence[str], order: Sequence[str | Column]):  # noqa: ANN202
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def _added(df: DataFrame) -> list[str]:
    return [] if RANGE in df.columns else [RANGE]


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sum of every entry of ``sums`` in the order of ``order`` (its first column is ranged)."""
    ranged = with_ranges(df, keys, order, width).withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        *keys, RANGE, *[F.coalesce(F.sum(f"_t_{n}").over(_before(keys)), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    local = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rejoin(ranged, offsets, keys)
    return joined.withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(local) for n in sums}).drop(
        *_added(df), *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums]
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None, out: str = "rn") -> DataFrame:
    """1-based position within the key."""
    return running_sums(df, keys, order, width, {out: F.lit(1).cast("long")})


def assign_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None, reverse: bool = False, out: str = "index"
) -> DataFrame:
    """0-based position within the key, from the end when ``reverse``."""
    numbered = row_numbers(df, keys, order, width, out)
    if not reverse:
        return numbered.withColumn(out, F.col(out) - 1)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn(RANGE, F.lit(0))
    return rejoin(numbered.withColumn(RANGE, F.lit(0)), sizes, keys).withColumn(out, F.col("_n") - F.col(out)).drop("_n", RANGE)


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None, previous: dict[str, str]
) -> DataFrame:
    """Values of the row before, also across range borders (null on the first row of a key).

    ``previous`` maps new column names to source columns.
    """
    ranged = with_ranges(df, keys, order, width)
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in previous.items()]), F.struct(*order))
    ends = ranged.groupBy(*keys, RANGE).agg(last.alias("_end"))
    carried = ends.select(
        *keys, RANGE, F.lag("_end").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_carry")
    )
    here = _local(keys, order)
    here_rn = F.row_number().over(here)
    return (
        rejoin(ranged, carried, keys)
        .withColumns(
            {
                n: F.when(here_rn == 1, F.col("_carry")[n]).otherwise(F.lag(c).over(here))
                for n, c in previous.items()
            }
        )
        .drop(*_added(df), "_carry")
    )
