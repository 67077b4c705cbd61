"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column, rank: int | None = None) -> Column:
    """Dot product in double precision.

    With ``rank`` the sum is unrolled, which keeps it inside generated code;
    without it the arrays are zipped and folded.
    """
    if rank is not None:
        terms = [
            F.get(left, F.lit(i)).cast("double") * F.get(right, F.lit(i)).cast("double")
            for i in range(rank)
        ]
        return reduce(lambda total, term: total + term, terms)
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")
        )
    )
