"""Operators whose columns of their own never meet a caller's."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def own_names(*roles: str) -> Callable:
    """An operator over ``docs`` that sees every column under a neutral name and gives the names back afterwards.

    ``roles`` are the arguments that name a column. A caller's column that is named like a new one is replaced.
    """

    def around(operator: Callable) -> Callable:
        told = inspect.signature(operator)

        @functools.wraps(operator)
        def call(docs: DataFrame, *args, **how) -> DataFrame:
            bound = told.bind(docs, *args, **how)
            bound.apply_defaults()
            place = {c.lower(): k for k, c in reversed(list(enumerate(docs.columns)))} | {c: k for k, c in enumerate(docs.columns)}
            for role in roles:
                name = bound.arguments[role]
                bound.arguments[role] = f"given_{place[name] if name in place else place[name.lower()]}"
            bound.arguments["docs"] = docs.toDF(*[f"given_{k}" for k in range(len(docs.columns))])
            out = operator(*bound.args, **bound.kwargs)
            given = {f"given_{k}": c for k, c in enumerate(docs.columns)}
            new = {c.lower() for c in out.columns if c not in given}
            return out.select(*[F.col(c).alias(given.get(c, c)) for c in out.columns if c not in given or given[c].lower() not in new])

        return call

    return around
