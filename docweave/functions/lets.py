"""Small helpers over Spark's higher-order array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as needed inside ``body``.

    A plain alias is not enough: the optimizer may inline it into a lambda, where it
    would be recomputed for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


