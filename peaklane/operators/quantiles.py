"""Exact quantiles of groups of any size.

Groups of up to ``gather`` rows are sorted as arrays. Values of larger groups become 64-bit integers in the same order, and
the wanted ranks are found by radix selection: each pass counts the values by their next 16 bits within the few ranges
that still hold a wanted rank. Only counts are shuffled. A range of ``gather`` values or fewer is sorted; equal values,
however many, are told apart from others by the fourth pass at the latest and never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peaklane.operators.stored import FEW, stored

#: Rows that are sorted in one array at most.
GATHER = 1 << 16
#: Bits of a pass, and of a double's fraction.
_STEP, _FRACTION = 16, 52
_INFINITE, _NAN = 0x7FF << 52, 0x7FF8 << 48


def order_key(value: Column) -> Column:
    """A long for a double, in the same order: equal for equal values, NaN above all others, as Spark sorts them."""
    size = F.abs(value)
    power = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole exponents
    near = F.greatest(F.floor(F.log2(size)), F.lit(-1022))  # the logarithm may be off by one next to a power of two
    part = size / power(near)
    place = F.when((part < 1) & (near > -1022), near - 1).when(part >= 2, near + 1).otherwise(near)
    bits = ((place + 1022) * (1 << _FRACTION) + (size / power(place) * float(1 << _FRACTION)).cast("long")).cast("long")
    bits = F.when(F.isnan(value), F.lit(_NAN)).when(size == float("inf"), F.lit(_INFINITE)).when(size == 0, F.lit(0)).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)


def from_order_key(key: Column) -> Column:
    """The double of a key."""
    size = F.abs(key)
    place, rest = F.shiftright(size, _FRACTION), size.bitwiseAND((1 << _FRACTION) - 1)
    whole = (1 + rest / float(1 << _FRACTION)) * F.pow(F.lit(2.0), place - 1023)
    least = rest.cast("double") * F.pow(F.lit(2.0), F.lit(-1074.0))
    value = F.when(size == _NAN, float("nan")).when(size == _INFINITE, float("inf")).when(place == 0, least).otherwise(whole)
    return F.when(key < 0, -value).otherwise(value)


def _ranks(n: Column, share: float) -> tuple[Column, Column, Column]:
    """The position of a quantile among ``n`` sorted values, and the ranks below and above it, from 0."""
    place = (n - 1) * F.lit(float(share))
    return place, F.floor(place), F.ceil(place)


def _between(place: Column, low: Column, high: Column, below: Column, above: Column) -> Column:
    return F.when((low == high) | (below == above), below).otherwise((high - place) * below + (place - low) * above)


def exact_quantiles(df: DataFrame, keys: list[str], columns: dict[str, Column], at: list[float], *, gather: int = GATHER) -> DataFrame:
    """(_key, and of each column an array with its quantiles ``at``), a row for each group; ``_key`` is a struct of the keys.

    Quantiles interpolate between neighbours, as ``percentile`` does. Null values don't count; a column of nulls has null
    quantiles. NaN is above all other values. Null keys are a group. Groups are counted first; if all have ``gather`` rows or
    fewer one aggregate serves them.
    """
    names = list(columns)
    rows = df.select(group_key(keys), *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(columns.values())])
    values = [f"_v{i}" for i in range(len(names))]
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"), *[F.count(v).alias(f"_n{i}") for i, v in enumerate(values)]).filter(F.col("_n") > gather)
    if not counts.limit(1).count():
        return _sorted(rows, values, names, at)
    large = stored(counts)
    one = F.broadcast(large) if large.count() <= FEW else large
    few = _sorted(rows.join(one.select("_key"), "_key", "left_anti"), values, names, at)
    return few.unionByName(_selected(rows, one, values, names, at, gather))


def group_key(keys: list[str]) -> Column:
    return F.struct(F.lit(0).alias("_"), *keys).alias("_key")


def _sorted(rows: DataFrame, values: list[str], names: list[str], at: list[float]) -> DataFrame:
    lists = rows.groupBy("_key").agg(*[F.sort_array(F.collect_list(v)).alias(v) for v in values])

    def pick(v: str, share: float) -> Column:
        place, low, high = _ranks(F.size(v), share)
        return _between(place, low, high, F.get(v, low.cast("int")), F.get(v, high.cast("int")))

    return lists.select("_key", *[F.array(*[pick(v, p) for p in at]).alias(n) for v, n in zip(values, names, strict=True)])


def _prefix(bits: str, level: int) -> Column:
    """The first ``level`` steps of a key's bits, sign included."""
    return F.shiftright(bits, 64 - _STEP * level) if level else F.lit(0).cast("long")


def _selected(rows: DataFrame, large: DataFrame, values: list[str], names: list[str], at: list[float], gather: int) -> DataFrame:
    long = rows.join(large.select("_key"), "_key", "left_semi").select("_key", F.posexplode(F.array(*values)).alias("_m", "_v")).filter("_v IS NOT NULL")
    long = stored(long.select("_key", "_m", order_key(F.col("_v")).alias("_bits")))
    wanted = [F.struct(F.lit(i).alias("_m"), F.col(f"_n{i}").alias("_size"), r.cast("long").alias("_rank")) for i in range(len(values)) for p in at for r in _ranks(F.col(f"_n{i}"), p)[1:]]
    targets = large.select("_key", F.explode(F.array(*wanted)).alias("_t")).select("_key", "_t.*").filter("_size > 0").distinct()
    range_ = ["_key", "_m", "_prefix"]
    open_ = stored(targets.select("_key", "_m", "_rank", F.col("_rank").alias("_left"), F.lit(0).cast("long").alias("_prefix"), "_size"))
    found = []
    for level in range(1, 64 // _STEP + 1):
        here = long.select("_key", "_m", _prefix("_bits", level - 1).alias("_prefix"), _prefix("_bits", level).alias("_next"))
        counted = here.join(_ranges(open_), range_).groupBy(*range_, "_next").agg(F.count("*").alias("_c"))
        before = F.sum("_c").over(Window.partitionBy(*range_).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1))  # 65,536 rows at most
        counted = counted.withColumn("_b", F.coalesce(before, F.lit(0)))
        inside = open_.join(counted, range_).filter((F.col("_left") >= F.col("_b")) & (F.col("_left") < F.col("_b") + F.col("_c")))
        moved = stored(inside.select("_key", "_m", "_rank", (F.col("_left") - F.col("_b")).alias("_left"), F.col("_next").alias("_prefix"), F.col("_c").alias("_size")))
        if level * _STEP == 64:
            found.append(moved.select("_key", "_m", "_rank", F.col("_prefix").alias("_bits")))
            break
        done = moved.filter(F.col("_size") <= gather)
        held = long.withColumn("_prefix", _prefix("_bits", level)).join(_ranges(done), range_).groupBy(*range_).agg(F.sort_array(F.collect_list("_bits")).alias("_l"))
        found.append(done.join(held, range_).select("_key", "_m", "_rank", F.element_at("_l", (F.col("_left") + 1).cast("int")).alias("_bits")))
        open_ = moved.filter(F.col("_size") > gather)
        if not open_.limit(1).count():
            break
    every = reduce(DataFrame.unionByName, found).select("_key", F.struct("_m", "_rank").alias("_at"), from_order_key(F.col("_bits")).alias("_v"))
    maps = every.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_all"))

    def pick(i: int, share: float) -> Column:
        place, low, high = _ranks(F.col(f"_n{i}"), share)
        value = lambda r: F.col("_all")[F.struct(F.lit(i).alias("_m"), r.cast("long").alias("_rank"))]
        return _between(place, low, high, value(low), value(high))

    joined = large.join(maps, "_key", "left")
    return joined.select("_key", *[F.array(*[pick(i, p) for p in at]).alias(n) for i, n in enumerate(names)])


def _ranges(targets: DataFrame) -> DataFrame:
    """The distinct ranges of the targets: a few for each group, broadcast if they are few in all."""
    ranges = targets.select("_key", "_m", "_prefix").distinct()
    return F.broadcast(ranges) if ranges.count() <= FEW else ranges
