"""A local name inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often the body names it.

    It also keeps a long body out of the stage's one generated method: the JVM does not compile methods above 8000
    bytes, and a stage that crosses that line runs several times slower.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
