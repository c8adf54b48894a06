"""Numbers as the other engine's SQL rounds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str) -> Column:
    """Six places, halves away from zero. Spark's own ``round`` of a double goes
    by its decimal digits and loses the sign of what becomes zero; SQL elsewhere
    scales, rounds and scales back, so that -1e-9 becomes -0.0."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(x * 1e6) / 1e6
    return F.when(near == 0, x * 0.0).when(F.abs(near) < float("inf"), near).otherwise(x)
