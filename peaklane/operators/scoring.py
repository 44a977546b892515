"""Batch scoring of rows by a caller's model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scorers that this worker has loaded, by the token of their ``score_batches``.
_LOADED: dict[str, Callable] = {}


def _loaded(token: str, factory: Callable) -> Callable:
    """The factory's scorer, made once for each worker process however many partitions it serves."""
    if token not in _LOADED:
        _LOADED.clear()  # a worker keeps one model
        _LOADED[token] = factory()
    return _LOADED[token]


def score_batches(df: DataFrame, score: Callable | None, out: str | dict[str, str], length: str, batch_size: int = 1024, *, factory: Callable | None = None) -> DataFrame:
    """``df`` with the outputs of ``score(pandas frame)``, in batches of rows of equal ``length``.

    ``out``: the name of one column of doubles, or the type of each output by name, arrays included (``{"score": "double",
    "ions": "array<double>"}``). One output is given as a sequence of a value for each row, several as a mapping of such
    sequences; arrays may differ in length from row to row. ``factory``: makes the scorer in place of ``score``, once a worker,
    for models that are dear to load.

    Rows stay in their partitions and are sorted there, so nothing is shuffled. Rows with a null length are a batch, too.
    """
    kinds = {out: "double"} if isinstance(out, str) else out
    if clash := set(kinds) & set(df.columns):
        raise ValueError(f"the table has columns named like outputs: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DataType.fromDDL(k)) for c, k in kinds.items()]])
    token = uuid.uuid4().hex

    def run(frames):
        scorer = score if factory is None else _loaded(token, factory)
        for frame in frames:
            for _, same in frame.groupby(length, sort=False, dropna=False):
                for a in range(0, len(same), batch_size):
                    part = same.iloc[a : a + batch_size]
                    found = scorer(part)
                    found = {next(iter(kinds)): found} if len(kinds) == 1 and not isinstance(found, dict) else found
                    for c in kinds:
                        if len(found[c]) != len(part):
                            raise ValueError(f"{c}: {len(found[c])} values for {len(part)} rows")
                    yield part.assign(**{c: list(found[c]) for c in kinds})

    return df.sortWithinPartitions(length).mapInPandas(run, schema)


def linear_score(df: DataFrame, values: str, weight: float, bias: float) -> DataFrame:
    """The mean of an array column, scaled: a scorer that needs no Python."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return df.withColumn("score", mean * weight + bias)
