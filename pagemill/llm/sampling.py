"""Bounded hash samples of labelled rows, and the remainder that separates folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARES = 1 << 30


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text, that is remainder 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds))


def share(doc_id: str) -> Column:
    """A place in [0, SHARES) that depends on the id alone; null ids share one place."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(SHARES))


def bound_share(rows: int, most: int) -> int:
    """Rows whose place lies below this are about ``most`` of ``rows``, or all of them."""
    return SHARES if rows <= most else int(SHARES * (most / rows))
