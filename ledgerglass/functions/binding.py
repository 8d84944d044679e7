"""Values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x worked out once for each row.

    A column stands for its expression in every place where it is used, and inside the
    functions of arrays Spark does not see that two of them are the same.
    """
    return F.get(F.transform(F.array(x), body), 0)
