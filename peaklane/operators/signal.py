"""Ordered series: scan indexes, smoothing, peak boundaries and the best ion of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from peaklane.operators.quantiles import group_key
from peaklane.operators.similarity import pearson
from peaklane.operators.slices import SLICE, large_groups, number_rows, with_halo

#: Smoothing weights by width, from the first to the last point. Fixed values.
KERNELS = {
    5: ([-3, 12, 17, 12, -3], 35),
    7: ([-2, 3, 6, 7, 6, 3, -2], 21),
    9: ([-21, 14, 39, 54, 59, 54, 39, 14, -21], 231),
}


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_index(scans: DataFrame, window: list[str], scan: str, *, most: int = SLICE) -> DataFrame:
    """``scan_index``: the place of a scan in its window, from 0. A window of more than ``most`` scans is numbered in ranges."""
    return number_rows(scans, window, [scan], "scan_index", most)


def scan_by_index(indexed: DataFrame, window: list[str], scan: str, index: int) -> DataFrame:
    return indexed.filter(F.col("scan_index") == index).select(*window, scan)


def top_n(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def smooth(df: DataFrame, key: list[str], order: str, value: str, n: int, out: str = "smoothed", *, most: int = SLICE) -> DataFrame:
    """Savitzky-Golay over 5, 7 or 9 points, zeros beyond the ends; 3 points: 1/4, 1/2, 1/4, with 2/3, 1/3 at the ends. A series
    of more than ``most`` points is smoothed in slices that hold the points next to their borders, too."""
    if large_groups(df.select(group_key(key)), most) is None:
        return df.withColumn(out, _smooth_rows(Window.partitionBy(*key).orderBy(order), value, n))
    cut = with_halo(number_rows(df, key, [order], "_i", most), "_i", n // 2, most)
    done = cut.withColumn(out, _smooth_rows(Window.partitionBy(*key, "_slice").orderBy("_i"), value, n))
    return done.filter("_own").drop("_i", "_slice", "_own")


def _smooth_rows(w: WindowSpec, value: str, n: int) -> Column:
    if n == 3:
        before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        both = F.when(before.isNull() & after.isNull(), v).when(before.isNull(), v * 2 / 3 + after / 3).when(after.isNull(), v * 2 / 3 + before / 3)
        return both.otherwise(before / 4 + v / 2 + after / 4)
    weights, norm = KERNELS[n]
    total = F.lit(0.0)
    for k, c in enumerate(weights):
        total = total + F.coalesce(F.lag(value, n // 2 - k).over(w) if k != n // 2 else F.col(value), F.lit(0.0)) * c
    return total / norm


def smooth_array(values: str, n: int) -> Column:
    """The same on an array column."""
    return _let(F.col(values), lambda v: _smoothed(v, n))


def _smoothed(v: Column, n: int) -> Column:
    at = lambda i: F.get(v, i)
    if n == 3:
        three = lambda x, i: F.when(at(i - 1).isNull() & at(i + 1).isNull(), x).when(at(i - 1).isNull(), x * 2 / 3 + at(i + 1) / 3).when(at(i + 1).isNull(), x * 2 / 3 + at(i - 1) / 3).otherwise(at(i - 1) / 4 + x / 2 + at(i + 1) / 4)
        return F.transform(v, three)
    weights, norm = KERNELS[n]

    def point(x: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, c in enumerate(weights):
            total = total + F.coalesce(at(i + (k - n // 2)), F.lit(0.0)) * c
        return total / norm

    return F.transform(v, point)


def middle_series(series: Column) -> Column:
    """The medians, place by place, of an array of series of one length, none of which holds a null."""

    def middle(v: Column) -> Column:
        low, high = F.get(v, F.floor((F.size(v) - 1) / 2)), F.get(v, F.floor(F.size(v) / 2))
        return F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)

    at = lambda a, i: F.sort_array(F.transform(a, lambda s: F.get(s, i)))
    return _let(series, lambda a: F.transform(F.get(a, F.lit(0)), lambda _, i: _let(at(a, i), middle)))


def _outward(side: Column, top: Column) -> Column:
    """How many steps the boundary lies from the apex, on one side in outward order: walk while values fall; above a
    tenth of the apex one rise is tolerated, the second ends the peak; then the least value walked over, if it is
    below the apex, else the end of the walk."""
    start = F.struct(top.alias("last"), F.lit(0).alias("rises"), F.lit(0).alias("steps"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        ends = (x >= a["last"]) & ((a["last"] <= 0.1 * top) | (a.rises >= 1))
        moved = F.struct(x.alias("last"), F.when(x < a["last"], a.rises).otherwise(a.rises + 1).alias("rises"), (a.steps + 1).alias("steps"), F.lit(False).alias("done"))
        stopped = F.struct(a["last"].alias("last"), a.rises.alias("rises"), a.steps.alias("steps"), F.lit(True).alias("done"))
        return F.when(a.done | ends, stopped).otherwise(moved)

    walked = F.aggregate(side, start, step, lambda a: a.steps)
    least = lambda s, k: F.when((F.size(s) > 0) & (F.array_min(s) < top), F.array_position(s, F.array_min(s)).cast("int")).otherwise(k)
    return _let(walked, lambda k: _let(F.slice(side, F.lit(1), k), lambda s: least(s, k)))


def _bounds(v: Column, apex: Column) -> Column:
    top = lambda a: F.get(v, a)
    left = lambda a: a - _outward(F.reverse(F.slice(v, F.lit(1), a)), top(a))
    right = lambda a: a + _outward(F.slice(v, a + 2, F.size(v)), top(a))
    shape = lambda a, lo, hi: F.struct(a.alias("apex"), lo.alias("left"), hi.alias("right"), F.greatest(F.array_min(F.slice(v, lo + 1, hi - lo + 1)), F.lit(0.0)).alias("min_smoothed"))
    return _let(apex, lambda a: _let(left(a), lambda lo: _let(right(a), lambda hi: shape(a, lo, hi))))


def _climbed(v: Column, apex: Column) -> Column:
    """The apex after walking up to the left, then to the right of the first place, while values rise."""

    def up(side: Column, top: Column) -> Column:
        start = F.struct(top.alias("top"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        go = lambda a, x: F.when(a.done | (x <= a.top), F.struct(a.top.alias("top"), a.n.alias("n"), F.lit(True).alias("done"))).otherwise(F.struct(x.alias("top"), (a.n + 1).alias("n"), F.lit(False).alias("done")))
        return F.aggregate(side, start, go, lambda a: F.struct(a.n.alias("n"), a.top.alias("top")))

    to_left = lambda a: up(F.reverse(F.slice(v, F.lit(1), a)), F.get(v, a))
    to_right = lambda a, top: up(F.slice(v, a + 2, F.size(v)), top)
    return _let(apex, lambda a: _let(to_left(a), lambda l: _let(to_right(a, l.top), lambda r: F.when(r.n > 0, a + r.n).otherwise(a - l.n))))


def find_peak(values: str | Column, apex: str | Column | None = None, *, climb: bool = False) -> Column:
    """struct(apex, left, right, min_smoothed), places from 0: at the greatest value (the first), at a given apex, or
    after climbing from it. Null for an empty array."""
    v = F.col(values) if isinstance(values, str) else values
    v = F.transform(v, lambda x: x.cast("double"))

    def found(a: Column) -> Column:
        if apex is None:
            return _bounds(a, F.when(F.array_max(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1).otherwise(0))
        given = (F.col(apex) if isinstance(apex, str) else apex).cast("int")
        return _bounds(a, _climbed(a, given) if climb else given)

    return F.when(F.size(v) > 0, _let(v, found))


def _correlations(ions: DataFrame, match: list[str], ion: str, values: str, start: str, end: str, apex: str) -> DataFrame:
    """(match, i, j, cor, weight of j): correlations of the ions of a match between the bounds; not above 0 counts as 0."""
    inside = F.slice(F.transform(values, lambda x: x.cast("double")), F.col(start) + 1, F.col(end) - F.col(start) + 1)
    cut = ions.select(*match, F.col(ion).alias("i"), inside.alias("x"), F.get(values, F.col(apex)).cast("double").alias("w"))
    pairs = cut.drop("w").join(cut.select(*match, F.col("i").alias("j"), F.col("x").alias("y"), "w"), match)
    return pairs.select(*match, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.coalesce(F.nanvl(pearson(F.col("x"), F.col("y")), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("cor"), "w")


def skew_classes(ions: DataFrame, match: list[str], ion: str, values: str, start: str, end: str, apex: str) -> DataFrame:
    """(match, ion, skew): on how many sides an ion is still high at the peak's bound: above 1.5 medians of all ions
    there, and above 10 % of its own apex (25 % if that is less than half of the greatest apex)."""
    at = lambda c: F.get(values, F.col(c)).cast("double")
    by = Window.partitionBy(*match)
    e = ions.select(*match, ion, at(start).alias("s"), at(end).alias("e"), at(apex).alias("a"))
    e = e.withColumns({"ms": F.median("s").over(by) * 1.5, "me": F.median("e").over(by) * 1.5, "top": F.max("a").over(by)})
    share = F.when(F.col("a") >= 0.5 * F.col("top"), 0.10).otherwise(0.25)
    high = lambda v, m: ((F.col(v) > F.col(m)) & (F.col(v) > share * F.col("a"))).cast("int")
    return e.select(*match, ion, (high("s", "ms") + high("e", "me")).alias("skew"))


def best_ion(ions: DataFrame, match: list[str], ion: str, values: str, start: str, end: str, apex: str, *, skew: bool = False, chosen: str | None = None) -> DataFrame:
    """(match, ion, best_ion, cor): every ion's correlation with the match's best ion. The best has the greatest mean
    correlation weighted by apex intensities, of equal ones the least ion; with ``skew`` skewed ions are passed over
    (ion 0 if all are); ``chosen`` names a column that gives the ion instead."""
    cor = _correlations(ions, match, ion, values, start, end, apex)
    if chosen:
        best = ions.groupBy(*match).agg(F.min(chosen).alias("best_ion"))
    else:
        score = cor.groupBy(*match, "i").agg(F.try_divide(F.sum(F.col("cor") * F.col("w")), F.sum("w")).alias("score"))
        if skew:
            score = score.join(skew_classes(ions, match, ion, values, start, end, apex).withColumnRenamed(ion, "i"), [*match, "i"])
            score = score.withColumn("score", F.when(F.col("skew") == 0, F.round("score", 12)))
        else:
            score = score.withColumn("score", F.round("score", 12))
        lowest = F.min("i")
        best = score.groupBy(*match).agg(F.coalesce(F.min_by("i", F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("i").alias("i")))), lowest).alias("best_ion"))
    return cor.join(best, match).filter(F.col("j") == F.col("best_ion")).select(*match, F.col("i").alias(ion), "best_ion", F.when(F.col("i") == F.col("best_ion"), 1.0).otherwise(F.col("cor")).alias("cor"))


def refine_peak(ions: DataFrame, match: list[str], values: str, start: str, end: str, cor: str, apex: str = "apex", low: str = "min_smoothed", min_cor: float = 0.75) -> DataFrame:
    """(match, apex, left, right, min_smoothed, refined) for every match: from the median over well correlated ions, in
    the place of the whole series. A peak of fewer than 5 scans or 3 such ions, or whose refined one is a single scan, stays
    as it is."""
    old = ions.groupBy(*match).agg(*[F.first(c, True).alias(k) for k, c in (("_apex", apex), ("_left", start), ("_right", end), ("_low", low))])
    good = ions.filter((F.col(cor) >= min_cor) & (F.col(end) - F.col(start) + 1 >= 5))
    enough = good.withColumn("_n", F.count("*").over(Window.partitionBy(*match))).filter("_n >= 3")
    points = enough.select(*match, F.col(start).alias("_s"), F.posexplode(F.slice(values, F.col(start) + 1, F.col(end) - F.col(start) + 1)).alias("_i", "_v"))
    series = points.groupBy(*match, "_s", "_i").agg(F.median("_v").alias("_m")).groupBy(*match, "_s").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"))
    peak = series.withColumn("p", find_peak(F.transform("_l", lambda x: x["_m"]))).filter("p.right - p.left >= 1")
    new = {"apex": F.col("_s") + F.col("p.apex"), "left": F.col("_s") + F.col("p.left"), "right": F.col("_s") + F.col("p.right"), "min_smoothed": F.col("p.min_smoothed")}
    both = old.join(peak.select(*match, *[c.alias(k) for k, c in new.items()], F.lit(True).alias("refined")), match, "left")
    kept = {"apex": "_apex", "left": "_left", "right": "_right", "min_smoothed": "_low"}
    return both.select(*match, *[F.when(F.col("refined"), F.col(k)).otherwise(F.col(o)).alias(k) for k, o in kept.items()], F.coalesce("refined", F.lit(False)).alias("refined"))


def sort_peaks(df: DataFrame, window: list[str], peaks: str) -> DataFrame:
    """An array of struct peaks in the order of its fields, scan first."""
    return df.withColumn(peaks, F.array_sort(peaks))
