"""Upkeep of the modification dimension: (mod_id, mod_name, site, mass, accession)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build_registry(df: DataFrame, name: str, mass: str, kind: str, accession: str, *, limit: float = 250.0, same: float = 0.001) -> DataFrame:
    """The site is what follows `` of ``, `` on ``, `` to `` or `` from `` in the name. Substitutions and masses beyond the
    limit go; of one accession and site, entries whose mass is within ``same`` of the entry before are one (TMT apart)."""
    site = F.regexp_extract(name, r" (?:of|on|to|from) (.+)$", 1)
    kept = df.withColumn("site", site).filter((F.abs(F.col(mass)) <= limit) & (F.col(kind) != "substitution") & (F.col("site") != ""))
    w = Window.partitionBy(accession, "site").orderBy(mass, name)
    near = (F.col(mass) - F.lag(mass).over(w) <= same) & ~F.upper(name).contains("TMT")
    kept = kept.withColumn("_same", F.coalesce(near, F.lit(False))).filter("NOT _same").drop("_same")
    order = F.row_number().over(Window.orderBy(accession, "site", mass, name))  # a dimension of some thousand rows
    return kept.withColumn("mod_id", order)


def add_user_mods(registry: DataFrame, spec: str) -> DataFrame:
    """Append entries ``name,residue,mass[,composition]`` that are separated by ``;``."""
    rows = [e.split(",") for e in spec.split(";") if e.strip()]
    spark = registry.sparkSession
    own = spark.createDataFrame([(r[0].strip(), r[1].strip(), float(r[2])) for r in rows], "mod_name string, site string, mass double")
    first = registry.agg(F.coalesce(F.max("mod_id"), F.lit(0)).alias("_m"))
    number = F.row_number().over(Window.orderBy("mod_name", "site"))
    return registry.select("mod_id", "mod_name", "site", "mass").unionByName(own.withColumn("_i", number).crossJoin(first).select((F.col("_m") + F.col("_i")).alias("mod_id"), "mod_name", "site", "mass"))


def override_mass(registry: DataFrame, spec: str) -> DataFrame:
    """``id@mass`` entries, separated by ``,``, in place of the registry's masses."""
    pairs = [e.split("@") for e in spec.split(",") if e.strip()]
    new = registry.sparkSession.createDataFrame([(int(i), float(m)) for i, m in pairs], "mod_id int, _mass double")
    return registry.join(F.broadcast(new), "mod_id", "left").withColumn("mass", F.coalesce("_mass", "mass")).drop("_mass")  # a literal list


def list_registry(registry: DataFrame, k: int) -> DataFrame:
    return registry.orderBy("mod_id").limit(k)
