"""Arrow-batched Python functions that are made at their first use, so that modules load without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        return lambda *columns: F.pandas_udf(f, ddl)(*columns)

    return wrap
