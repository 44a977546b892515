"""Points in intervals by multi-level bins.

An interval lies in bins of its own level: a power of two between a quarter and a half of its length, so it touches five
at most, however long it is. A point stands in one bin of each level that the intervals have. Intervals of no length meet
points by value. Bounds beyond the points are cut to them, so open intervals are intervals too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of intervals without length and of infinite points; powers of two end before them.
_EXACT, _BEYOND = 5000, 5001
_LOWEST = -1074


def fixed_level(length: float) -> int:
    """The level of intervals of a known length."""
    import math

    return max(math.floor(math.log2(length)) - 1, _LOWEST)


def _level(low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(_EXACT)).otherwise(F.greatest(F.coalesce(F.floor(F.log2(high / 2 - low / 2)), F.lit(_LOWEST)), F.lit(_LOWEST))).cast("int")


def _bin(value: Column, level: Column | int) -> Column:
    width = F.lit(2.0**level) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(value / width)


def range_join(points: DataFrame, ranges: DataFrame, value: str | Column, lower: str | Column, upper: str | Column, by: list[str] | None = None, *, level: int | None = None) -> DataFrame:
    """Points and ranges with ``lower <= value <= upper`` and equal ``by``: all columns of both, ``by`` once.

    Bounds may be infinite. Null and NaN match nothing, nor does a range whose bounds are out of order. ``level``: of the bins,
    where all ranges have about the same length (``fixed_level``); else the ranges are read once for theirs.
    """
    by = by or []
    as_column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    placed = points.withColumn("_value", as_column(value)).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    given = ranges.withColumns({"_lower": as_column(lower), "_upper": as_column(upper)}).filter((F.col("_lower") <= F.col("_upper")) & ~F.isnan("_lower") & ~F.isnan("_upper"))
    low, high = F.col("_lower"), F.col("_upper")
    beyond = False
    if level is None:
        infinite = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
        if given.filter(infinite).limit(1).count():
            beyond = True
            finite = placed.filter(F.abs("_value") < float("inf")).agg(F.min("_value").alias("a"), F.max("_value").alias("b")).first()
            low, high = (F.greatest(low, F.lit(finite["a"])), F.least(high, F.lit(finite["b"]))) if finite["a"] is not None else (F.lit(1.0), F.lit(0.0))
        kinds = given.select(_level(low, high).alias("k")).distinct().filter("k IS NOT NULL").collect()  # some two thousand powers of two at most
        levels = sorted({r.k for r in kinds} - {_EXACT})
        exact = any(r.k == _EXACT for r in kinds)
        own = _level(low, high)
    else:
        levels, exact, own = [level], False, F.lit(level)
    node = lambda k, b: F.struct(k.cast("int").alias("k"), b.cast("long").alias("b"))
    spans = F.transform(F.sequence(_bin(low, own), _bin(high, own)), lambda b: node(own, b))
    spans = F.when(low > high, F.array().cast("array<struct<k:int,b:bigint>>")).when(own == _EXACT, F.array(node(F.lit(_EXACT), F.xxhash64(low + 0.0)))).otherwise(spans)
    stands = [node(F.lit(k), _bin(F.col("_value"), k)) for k in levels]
    if exact:
        stands.append(node(F.lit(_EXACT), F.xxhash64(F.col("_value") + 0.0)))
    if beyond:
        sign = F.when(F.col("_value") == float("inf"), 1).when(F.col("_value") == float("-inf"), -1)
        stands.append(node(F.lit(_BEYOND), F.coalesce(sign, F.lit(0))))
        ends = F.array_compact(F.array(F.when(F.col("_upper") == float("inf"), node(F.lit(_BEYOND), F.lit(1))), F.when(F.col("_lower") == float("-inf"), node(F.lit(_BEYOND), F.lit(-1)))))
        spans = F.concat(spans, ends)
    if not stands:
        placed, stands = placed.filter(F.lit(False)), [node(F.lit(0), F.lit(0))]
    left = placed.withColumn("_node", F.explode(F.array(*stands)) if len(stands) > 1 else stands[0])
    if beyond:  # finite points meet no end
        left = left.filter((F.col("_node.k") != _BEYOND) | (F.col("_node.b") != 0))
        # an infinite point stands at its end alone
        left = left.filter((F.abs("_value") < float("inf")) | (F.col("_node.k") == _BEYOND))
    right = given.withColumn("_node", F.explode(spans))
    # both sides hold a row for each bin, many times what their columns' size lets Spark expect, so none is broadcast
    met = left.hint("merge").join(right, [*by, "_node"]).filter(F.col("_value").between(F.col("_lower"), F.col("_upper")))
    return met.drop("_node", "_value", "_lower", "_upper")
