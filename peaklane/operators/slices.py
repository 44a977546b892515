"""Ordered groups of any size: groups of many rows are cut into slices along their order, which tasks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peaklane.operators.quantiles import group_key
from peaklane.operators.stored import FEW, stored

#: Rows that one task orders at most.
SLICE = 2_000_000
#: Ranges into which rows are cut that would fit fewer.
_RANGES = 256


def large_groups(df: DataFrame, most: int) -> DataFrame | None:
    """(_key, _n): the groups of ``_key`` with more than ``most`` rows, at most one for every ``most`` rows; None if there are
    none."""
    found = df.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return stored(found) if found.limit(1).count() else None


def split_groups(df: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the other groups and of the large ones."""
    keys = F.broadcast(large.select("_key")) if large.count() <= FEW else large.select("_key")
    return df.join(keys, "_key", "left_anti"), df.join(keys, "_key", "left_semi")


def ranged(df: DataFrame, large: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """Rows of large groups with ``_part``, a range of (_key, order), and ``_at``, their place in it from 0. Rows of equal order
    are dealt by a hash of their columns, so only rows that are equal throughout stay together."""
    total = large.agg(F.sum("_n").alias("n")).first()["n"]
    # each range costs the driver a sample of rows and results of tasks, so a small ``most`` gives no more than some _RANGES
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-total // most), _RANGES + -(-total // SLICE)))
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    along = ["_key", *order, F.xxhash64(*[F.col(f"`{c}`") for c in plain])]
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *along).sortWithinPartitions(*along)
    return stored(dealt.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}))


def number_rows(df: DataFrame, key: list[str], order: list[Column | str], out: str, most: int = SLICE) -> DataFrame:
    """``out``: the place of a row in its group by the order, from 0. Groups are counted first; one of more than ``most`` rows is
    numbered in ranges of its order, to which the counts of the ranges before are added."""
    rows = df.withColumn("_key", group_key(key))
    number = lambda k: F.row_number().over(Window.partitionBy(k).orderBy(*order)) - 1
    large = large_groups(rows, most)
    if large is None:
        return rows.withColumn(out, number("_key")).drop("_key")
    few, many = split_groups(rows, large)
    placed = ranged(many, large, order, most)
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    bases = placed.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    placed = placed.join(F.broadcast(bases), "_part").withColumn("_at", F.col("_at") + F.col("_base"))
    firsts = placed.groupBy("_key").agg(F.min("_at").alias("_first"))  # one row a large group
    numbered = placed.join(firsts, "_key").withColumn(out, (F.col("_at") - F.col("_first")).cast("int"))
    return few.withColumn(out, number("_key")).drop("_key").unionByName(numbered.select(*df.columns, out))


def with_halo(df: DataFrame, index: str, reach: int, most: int = SLICE) -> DataFrame:
    """Rows numbered by ``index`` in their ``_slice`` of ``most`` rows; those within ``reach`` of a border also in the neighbouring
    slice, there with ``_own`` false."""
    at = lambda shift: F.floor((F.col(index) + shift) / most)
    copies = F.array_distinct(F.array(at(0), F.greatest(at(-reach), F.lit(0)), at(reach)))
    return df.withColumn("_slice", F.explode(copies)).withColumn("_own", F.col("_slice") == at(0))
