"""Array expressions on embedding columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataprobe.functions.draws import as_column

# Distances are compared at this many decimals, so that a ranking does not depend on summation order.
DISTANCE_DIGITS = 9


def array_distance(a, b) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    squares = F.zip_with(
        as_column(a), as_column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
    return F.round(F.sqrt(total), DISTANCE_DIGITS)
