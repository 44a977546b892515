"""Similarity of two spectra that lie in array columns; row by row, without a shuffle."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def pearson(a: Column, b: Column) -> Column:
    """0 where a spectrum has no variance."""
    center = lambda x: _let(_sum(F.transform(x, lambda v: v.cast("double"))) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    return _let(center(a), lambda p: _let(center(b), lambda q: dot(p, q) / (F.greatest(F.sqrt(dot(p, p)), F.lit(1e-8)) * F.greatest(F.sqrt(dot(q, q)), F.lit(1e-8)))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-8)))


def spectral_angle(a: Column, b: Column) -> Column:
    return 1 - 2 * F.acos(F.least(cosine(a, b), F.lit(1.0))) / pi


def ranks(a: Column) -> Column:
    """The place of each value in ascending order, from 0, ties by position; zeros have rank 0."""
    order = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    back = lambda s: F.transform(F.array_sort(F.transform(s, lambda e, r: F.struct(e["i"].alias("i"), e["x"].alias("x"), r.alias("r")))), lambda e: F.when(e["x"] == 0, 0).otherwise(e["r"]))
    return _let(order, back)


def spc(a: Column, b: Column) -> Column:
    n = F.size(a).cast("double")
    return _let(ranks(a), lambda p: _let(ranks(b), lambda q: 1 - 6 * _sum(F.zip_with(p, q, lambda x, y: ((x - y) * (x - y)).cast("double"))) / (n * (n * n - 1))))


def masked(a: Column, mask: Column) -> Column:
    """The positions whose validity is 0 or below."""
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda z: z["m"] <= 0), lambda z: z["v"])


def top_k(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Both spectra at the ``k`` positions at which the first is greatest (ties: the earlier)."""
    kept = lambda z: F.slice(F.array_sort(z, lambda x, y: F.when(x["v"] > y["v"], -1).when(x["v"] < y["v"], 1).otherwise(x["i"] - y["i"])), 1, k)
    zipped = F.transform(F.arrays_zip(a.alias("v"), b.alias("w")), lambda z, i: F.struct(z["v"].alias("v"), z["w"].alias("w"), i.alias("i")))
    best = kept(zipped)
    return F.transform(best, lambda z: z["v"]), F.transform(best, lambda z: z["w"])


_METRICS = {"pcc": pearson, "cos": cosine, "sa": spectral_angle, "spc": spc}


def spectrum_similarity(df: DataFrame, a: str, b: str, metrics: tuple = ("pcc", "cos", "sa", "spc"), *, mask: str | None = None, k: int | None = None) -> DataFrame:
    """``df`` with one column a metric. With a mask only its positions of 0 or below count, and ``spc`` is the Pearson
    correlation of ranks; ``k`` restricts ``spc`` to the positions of the greatest values of ``a``."""
    x, y = F.col(a), F.col(b)
    if mask:
        x, y = masked(x, F.col(mask)), masked(y, F.col(mask))
    out = {}
    for name in metrics:
        p, q = top_k(x, y, k) if k and name == "spc" else (x, y)
        out[name] = pearson(ranks(p), ranks(q)) if mask and name == "spc" else _METRICS[name](p, q)
    return df.withColumns(out)


def normalize_spectrum(df: DataFrame, column: str, floor: float | None = None) -> DataFrame:
    """Divide by the greatest value if that is above 0; values below ``floor`` become 0."""
    top = F.array_max(column)
    scaled = F.transform(column, lambda v: F.when(top > 0, v / top).otherwise(v.cast("double")))
    return df.withColumn(column, F.transform(scaled, lambda v: F.when(v < floor, 0.0).otherwise(v)) if floor else scaled)
