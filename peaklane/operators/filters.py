"""Filters. Each names its columns; thresholds are inclusive unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exceeds(column: str, limit: float) -> Column:
    """Whether a value is above the limit; missing values (null or NaN) are not."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0)) > limit


def confidence_filter(df: DataFrame, columns: list[str], limit: float = 0.01, observe: str | None = None) -> DataFrame:
    """Rows of which no column is above the limit. ``observe`` names an observation that counts the dropped rows."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | exceeds(c, limit)
    if observe:
        df = df.observe(observe, F.count_if(bad).alias("dropped"))
    return df.filter(~bad)


def fdr_filter(df: DataFrame, column: str, cutoff: float) -> DataFrame:
    return df.filter(F.col(column) <= cutoff)


def conditional_filter(df: DataFrame, when: Column, keep: Column, observe: str | None = None) -> DataFrame:
    """Rows for which ``keep`` holds, or ``when`` doesn't. ``observe`` names an observation that counts the dropped rows."""
    good = ~F.coalesce(when, F.lit(False)) | F.coalesce(keep, F.lit(False))
    if observe:
        df = df.observe(observe, F.count_if(~good).alias("dropped"))
    return df.filter(good)


def drop_unmapped(df: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    return df.join(registry.select(on).distinct(), on, "left_semi")


def drop_containing(df: DataFrame, column: str, text: str = "X") -> DataFrame:
    return df.filter(~F.col(column).contains(text))


def range_filter(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def relative_threshold(df: DataFrame, values: str, intensities: str, fraction: float) -> DataFrame:
    """The spectrum's peaks whose intensity is at least ``fraction`` of its maximum; empty spectra go."""
    # the maximum is bound once; within the filter it would be looked for again at every peak
    high = lambda top: F.filter(F.arrays_zip(values, intensities), lambda p: p[intensities] >= top * fraction)
    peaks = F.element_at(F.transform(F.array(F.array_max(intensities)), high), 1)
    cut = df.withColumn("_p", peaks).filter(F.size("_p") > 0)
    return cut.withColumns({c: F.col(f"_p.{c}") for c in (values, intensities)}).drop("_p")


def max_width(df: DataFrame, width: str, limit: float) -> DataFrame:
    return df.filter(F.col(width) <= limit)


def target_windows(df: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the named windows; Spark broadcasts the windows if they are few."""
    return df.join(windows.select(on).distinct(), on, "left_semi")


def drop_zero_peaks(df: DataFrame, values: str, intensities: str, least: float = 1e-12) -> DataFrame:
    peaks = F.filter(F.arrays_zip(values, intensities), lambda p: p[intensities] > least)
    return df.withColumn("_p", peaks).withColumns({c: F.col(f"_p.{c}") for c in (values, intensities)}).drop("_p")


def library_filter(df: DataFrame, key: list[str], mz: str, number: str, mz_min: float, mz_max: float, min_number: int, min_n: int) -> DataFrame:
    """Fragments in range; precursors that keep fewer than ``min_n`` of them go."""
    kept = df.filter(F.col(mz).between(mz_min, mz_max) & (F.col(number) >= min_number))
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).filter(F.col("_n") >= min_n).drop("_n")


def ion_quality_flags(df: DataFrame, kind: str, number: str, correlation: str, mz: str, *, min_b: int = 3, min_y: int = 3, min_correlation: float = 0.75, min_mz: float = 200.0) -> DataFrame:
    """``flag``: 0 for a valid ion, else the first rule that it breaks (1 ion number, 2 m/z, 3 correlation)."""
    low = F.when(F.col(kind).startswith("b"), F.col(number) < min_b).otherwise(F.col(number) < min_y)
    return df.withColumn("flag", F.when(low, 1).when(F.col(mz) < min_mz, 2).when(F.coalesce(F.col(correlation), F.lit(0.0)) < min_correlation, 3).otherwise(0))


def drop_y1(df: DataFrame, kind: str, number: str) -> DataFrame:
    """Without the y ions of number 1."""
    return df.filter(~(F.coalesce(F.col(kind).startswith("y"), F.lit(False)) & F.coalesce(F.col(number) == 1, F.lit(False))))


def min_matched_ions(df: DataFrame, key: list[str], intensity: str, n: int) -> DataFrame:
    """Matches of which ``n`` ions or more have an intensity above zero."""
    found = F.count_if(F.col(intensity) > 0).over(Window.partitionBy(*key))
    return df.withColumn("_n", found).filter(F.col("_n") >= n).drop("_n")


def base_peak_valid(df: DataFrame, key: list[str], intensity: str, flag: str) -> DataFrame:
    """For each match: whether its most intense ion (of equal ones the better flag) is valid and above zero."""
    top = F.max(F.struct(F.col(intensity).alias("i"), (-F.col(flag)).alias("f")))
    return df.groupBy(*key).agg(top.alias("t")).select(*key, ((F.col("t.f") == 0) & (F.col("t.i") > 0)).alias("valid"))


def ion_types(df: DataFrame, column: str, mode: str) -> DataFrame:
    """``general``: plain b and y ions at charge 1 and 2; ``phosphorylation``: those with losses too."""
    plain = ["b_z1", "b_z2", "y_z1", "y_z2"]
    more = ["b_modloss_z1", "b_modloss_z2", "y_modloss_z1", "y_modloss_z2"]
    return df.filter(F.col(column).isin(plain if mode == "general" else plain + more))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)
