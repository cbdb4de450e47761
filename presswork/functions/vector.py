"""Vector arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double; null where a vector is null or the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def score(distance: Column) -> Column:
    """1 for distance 0, falling towards 0."""
    return 1.0 / (1.0 + distance)


def parse_vector(s: Column) -> Column:
    """'[1,2.5]' as an array of float; null if it can't be read."""
    return F.from_json(s, "array<float>")
