"""Joins with tables that are expected to be small, broadcast only when a size check says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """Upper estimate the optimizer gives for a plan; no job is run."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:  # noqa: ANN001
    """Broadcast ``small`` when its planned size is bounded; beyond that the join is left to the adaptive planner,
    which shuffles both sides and splits the keys that turn out to be hot."""
    side = F.broadcast(small) if planned_bytes(small) <= BROADCAST_BYTES else small
    return big.join(side, on, how)
