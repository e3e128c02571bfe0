"""Columns by Python functions on single values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def mapped(column: Column, kind: DataType, f: Callable) -> Column:
    """``f`` of each value that is not null; null stays.

    Only the argument goes to the Python worker, a hundred rows at a time whatever the length of the texts, and columns
    of one select share a worker. (Of mapInPandas each takes whole rows and a worker of its own.)
    """
    return F.udf(lambda x: None if x is None else f(x), kind, useArrow=False)(column)
