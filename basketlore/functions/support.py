"""Support ratios as basket counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORT_MODES = ("floor", "exact", "ceil")


def min_count(baskets: Column, ratio: Column | float, mode: str) -> Column:
    """Smallest count that reaches ``ratio`` of ``baskets``, as a double.

    ``floor`` rounds down but never below 1, ``exact`` keeps the fraction and
    ``ceil`` rounds up. Doubles throughout, so that 18338 * 0.025 is the same
    number everywhere.
    """
    if mode not in SUPPORT_MODES:
        raise ValueError(f"support_mode must be one of {SUPPORT_MODES}, got {mode!r}")
    share = baskets.cast("double") * (ratio if isinstance(ratio, Column) else F.lit(float(ratio)))
    if mode == "floor":
        return F.greatest(F.lit(1.0), F.floor(share).cast("double"))
    if mode == "ceil":
        return F.ceil(share).cast("double")
    return share
