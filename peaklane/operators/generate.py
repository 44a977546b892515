"""Generators: digestion, charges, modification isoforms, fragments and flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklane.functions.constants import AMMONIA, ENZYMES, PHOSPHORIC, PROTON, RESIDUE_MASS, WATER
from peaklane.functions.scalars import residues


def cut_pattern(enzyme: str | int) -> str:
    """A pattern for the places at which an enzyme cuts."""
    name, before, after, forbid = ENZYMES[enzyme] if isinstance(enzyme, int) else next(e for e in ENZYMES if e[0] == enzyme)
    look = (f"(?<=[{before}])" if before else "") + (f"(?=[{after}])" if after else "")
    return look + (f"(?!{forbid})" if forbid else "")


def clean_sequence(sequence: Column, i2l: bool = False) -> Column:
    """Upper case, without ``*`` at either end, with L for I if asked."""
    s = F.regexp_replace(F.upper(sequence), r"^\*+|\*+$", "")
    return F.replace(s, F.lit("I"), F.lit("L")) if i2l else s


def digest(proteins: DataFrame, key: list[str], sequence: str, enzyme: str | int = "Trypsin", missed: int = 0, min_len: int = 7, max_len: int = 35, *, clip_m: bool = False, i2l: bool = False, drop_x: bool = False) -> DataFrame:
    """(key, peptide, n_term): the distinct peptides of each protein, and whether they begin at its start. With
    ``clip_m`` a first peptide with a leading M also gives the one without it."""
    s = clean_sequence(F.col(sequence), i2l)
    index = enzyme if isinstance(enzyme, int) else [e[0] for e in ENZYMES].index(enzyme)
    if index == 0:
        starts = F.sequence(F.lit(1), F.length("_s") - min_len + 1)
        sizes = lambda a: F.sequence(F.lit(min_len), F.least(F.lit(max_len), F.length("_s") - a + 1))
        found = F.flatten(F.transform(starts, lambda a: F.transform(sizes(a), lambda n: F.struct(F.col("_s").substr(a, n).alias("peptide"), (a == 1).alias("n_term")))))
        found = F.when(F.length("_s") >= min_len, found)
        cut = proteins.select(*key, s.alias("_s")).select(*key, found.alias("_p"))
    else:
        pieces = F.filter(F.split("_s", cut_pattern(index)), lambda x: x != "")

        def runs(x: Column) -> Column:  # of 1 to missed + 1 neighbours, by place, so that the cost is linear
            grown = [lambda i, n=n: F.when(i + n < F.size(x), F.concat(*[F.get(x, i + k) for k in range(n + 1)])) for n in range(missed + 1)]
            every = F.flatten(F.transform(x, lambda _, i: F.array(*[F.struct(g(i).alias("peptide"), (i == 0).alias("n_term")) for g in grown])))
            return F.filter(every, lambda q: F.length(q["peptide"]).between(min_len - (1 if clip_m else 0), max_len + (1 if clip_m else 0)))

        # bound once: the pieces must not be cut again for each of them
        cut = proteins.select(*key, s.alias("_s")).select(*key, F.element_at(F.transform(F.array(pieces), runs), 1).alias("_p"))
    # the outer form: before a plain explode Spark would test the list for rows, which cuts the sequence again
    rows = cut.select(*key, F.explode_outer("_p").alias("_q")).select(*key, "_q.peptide", "_q.n_term")
    if clip_m:
        both = F.when(F.col("n_term") & F.col("peptide").startswith("M") & (F.length("peptide") >= min_len + 1), F.array("peptide", F.col("peptide").substr(F.lit(2), F.length("peptide")))).otherwise(F.array("peptide"))
        rows = rows.select(*key, "n_term", F.explode(F.array_distinct(both)).alias("peptide"))
    rows = rows.filter(F.length("peptide").between(min_len, max_len))
    rows = rows.filter(~F.col("peptide").contains("X")) if drop_x else rows
    return rows.groupBy(*key, "peptide").agg(F.bool_or("n_term").alias("n_term"))


def digest_totals(proteins: DataFrame, key: list[str], sequence: str, enzymes: list[str], min_len: int = 7, max_len: int = 35) -> DataFrame:
    """(enzyme, key, n, residues): how many distinct peptides ``digest`` gives by each rule without missed cuts, and their
    residues. Sequences are cleaned once for all rules; keys of one row are counted in it, the peptides of others meet."""
    cleaned = proteins.select(*key, clean_sequence(F.col(sequence)).alias("_s"))

    def peptides(name: str) -> Column:
        return F.array_distinct(F.filter(F.split("_s", cut_pattern(name)), lambda p: F.length(p).between(min_len, max_len)))

    def lists(rows: DataFrame) -> DataFrame:
        every = F.array(*[F.struct(F.lit(e).alias("enzyme"), peptides(e).alias("_p")) for e in enzymes])
        return rows.select(*key, F.explode_outer(every).alias("_e")).select("_e.enzyme", *key, "_e._p")

    told = [F.size("_p").cast("long").alias("n"), F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + F.length(p)).alias("residues")]
    again = proteins.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key)
    if not again.limit(1).count():
        return lists(cleaned).select("enzyme", *key, *told).filter("n > 0")
    same = reduce(lambda a, b: a & b, [cleaned[k].eqNullSafe(again[k]) for k in key])
    one, many = (cleaned.join(again, same, how) for how in ("left_anti", "left_semi"))
    met = lists(many).select("enzyme", *key, F.explode("_p").alias("_p")).distinct()
    met = met.groupBy("enzyme", *key).agg(F.count("*").alias("n"), F.sum(F.length("_p")).alias("residues"))
    return lists(one).select("enzyme", *key, *told).filter("n > 0").unionByName(met)


def expand_charges(df: DataFrame, peptide: str, low: int, high: int) -> DataFrame:
    return df.withColumn("charge", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("form", F.concat_ws("|", peptide, F.col("charge").cast("string")))


def candidate_sites(sequence: Column, n_term: Column, target: str) -> Column:
    """Sites of a rule: those of a residue (from 1), or 0 for ``n-term`` and, on first peptides only, ``protein-n-term``."""
    none = F.array().cast("array<int>")
    if target == "n-term":
        return F.array(F.lit(0))
    if target == "protein-n-term":
        return F.when(n_term, F.array(F.lit(0))).otherwise(none)
    return F.filter(F.transform(residues(sequence), lambda r, i: F.when(r == target, i + 1)), lambda i: i.isNotNull())


#: Isoforms of a peptide whose numbers are listed in one array.
_BLOCK = 4096


def _ways(options: Column, k: int) -> Column:
    """For each place and the end: in how many ways 0 to ``k`` modifications go on it and the places after it."""
    end = F.array(F.array(*[F.lit(1 if j == 0 else 0).cast("long") for j in range(k + 1)]))

    def before(found: Column, n: Column) -> Column:
        here = F.element_at(found, 1)
        at = lambda j: F.element_at(here, j + 1)
        return F.concat(F.array(F.array(*[at(j) + n * at(j - 1) if j else at(0) for j in range(k + 1)])), found)

    return F.aggregate(F.reverse(options), end, before)


def expand_isoforms(df: DataFrame, sequence: str, n_term: str, variable: list[tuple[str, str]], fixed: list[tuple[str, str]], k: int) -> DataFrame:
    """One row for each way to put 0 to ``k`` variable modifications (name, target) on different sites, with fixed ones
    on the sites that stay free; ``mods``: sorted array of struct(site, name).

    Isoforms are numbered, and each row works out its own from its number: from the ways that the places after a place leave
    follows whether it is modified, and how. So no row holds the isoforms of its peptide, whatever ``k`` is.
    """
    none = F.array().cast("array<struct<site:int,name:string>>")

    def at(name: str, target: str) -> Column:
        return F.transform(candidate_sites(F.col(sequence), F.col(n_term), target), lambda s: F.struct(s.alias("site"), F.lit(name).alias("name")))

    def sites(rules: list[tuple[str, str]]) -> Column:
        return F.array_sort(F.flatten(F.array(*[at(*rule) for rule in rules]))) if rules else none

    rows = df.withColumns({"_all": sites(variable), "_fixed": sites(fixed)})
    places = F.transform(F.array_distinct(F.transform("_all", lambda x: x["site"])), lambda s: F.struct(s.alias("site"), F.transform(F.filter("_all", lambda x: x["site"] == s), lambda x: x["name"]).alias("names")))
    rows = rows.withColumn("_places", places).withColumn("_ways", _ways(F.transform("_places", lambda p: F.size(p["names"]).cast("long")), k))
    whole = [F.element_at(F.element_at("_ways", 1), j + 1) for j in range(k + 1)]
    sums = [F.lit(0).cast("long")]
    for n in whole:
        sums.append(sums[-1] + n)
    rows = rows.withColumn("_before", F.array(*sums))  # of 0, 1, ... modifications; the last is the number of all
    total = F.element_at("_before", -1)
    rows = rows.withColumn("_block", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / _BLOCK))))
    rows = rows.withColumn("_number", F.explode_outer(F.sequence(F.col("_block") * _BLOCK, F.least(F.col("_block") * _BLOCK + _BLOCK, total) - 1)))
    many = F.size(F.filter("_before", lambda b: b <= F.col("_number"))) - 1
    start = F.struct(F.lit(1).alias("g"), many.alias("j"), (F.col("_number") - F.get("_before", many)).alias("r"), none.alias("m"))

    def step(a: Column, place: Column) -> Column:
        after = F.element_at("_ways", a.g + 1)
        left, each = a.r - F.get(after, a.j), F.get(after, a.j - 1)
        taken = F.struct(place["site"].alias("site"), F.get(place["names"], F.floor(left / each).cast("int")).alias("name"))
        skip = F.struct((a.g + 1).alias("g"), a.j.alias("j"), a.r.alias("r"), a.m.alias("m"))
        take = F.struct((a.g + 1).alias("g"), (a.j - 1).alias("j"), (left % each).alias("r"), F.concat(a.m, F.array(taken)).alias("m"))
        return F.when((a.j > 0) & (left >= 0), take).otherwise(skip)

    rows = rows.withColumn("_set", F.aggregate("_places", start, step, lambda a: a.m))
    free = F.filter("_fixed", lambda f: ~F.exists("_set", lambda v: v["site"] == f["site"]))
    return rows.withColumn("mods", F.array_sort(F.concat("_set", free))).drop("_all", "_fixed", "_places", "_ways", "_before", "_block", "_number", "_set")


#: Neutral losses by name. Fixed values.
LOSSES = {"H2O": WATER, "NH3": AMMONIA, "H3PO4": PHOSPHORIC}


def fragments(df: DataFrame, sequence: str, charge: str, losses: tuple = (), *, max_charge: int = 2, below: bool = False) -> DataFrame:
    """Expected b and y ions: ``ion``, ``number``, ``frag_charge`` (1 to min(charge, max_charge), or one less than the
    precursor's with ``below``), ``loss`` and ``frag_mz``. Unknown residues weigh nothing."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUE_MASS.items() for x in pair])
    weights = F.transform(residues(F.col(sequence)), lambda r: F.coalesce(table[r], F.lit(0.0)))
    # one running sum a sequence; an ion's mass is the difference of two of its places
    sums = F.aggregate(weights, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    rows = df.withColumn("_w", sums).withColumn("_n", F.size("_w") - 1)
    sides = F.array(*[F.struct(F.lit(ion).alias("ion"), F.lit(extra).alias("extra")) for ion, extra in (("b", 0.0), ("y", WATER))])
    rows = rows.withColumn("_side", F.explode(sides)).withColumn("number", F.explode_outer(F.when(F.col("_n") > 1, F.sequence(F.lit(1), F.col("_n") - 1)))).filter("number IS NOT NULL")
    part = F.when(F.col("_side.ion") == "b", F.get("_w", "number")).otherwise(F.get("_w", "_n") - F.get("_w", F.col("_n") - F.col("number")))
    top = F.least(F.col(charge) - (1 if below else 0), F.lit(max_charge))
    rows = rows.withColumn("_m", part + F.col("_side.extra")).filter(top >= 1).withColumn("frag_charge", F.explode(F.sequence(F.lit(1), top)))
    lost = F.array(*[F.struct(F.lit(n).alias("loss"), F.lit(m).alias("mass")) for n, m in (("", 0.0), *[(n, LOSSES[n]) for n in losses])])
    rows = rows.withColumn("_l", F.explode(lost))
    return rows.select(*df.columns, F.col("_side.ion").alias("ion"), "number", "frag_charge", F.col("_l.loss").alias("loss"), ((F.col("_m") - F.col("_l.mass")) / F.col("frag_charge") + PROTON).alias("frag_mz"))


def explode_peaks(scans: DataFrame, values: str, intensities: str) -> DataFrame:
    """One row a peak: ``mz`` and ``intensity`` beside the scan's other columns."""
    rest = [c for c in scans.columns if c not in (values, intensities)]
    return scans.select(*rest, F.explode(F.arrays_zip(F.col(values).alias("mz"), F.col(intensities).alias("intensity"))).alias("_p")).select(*rest, "_p.mz", "_p.intensity")


def melt_fragments(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns named like ``b_z1`` or ``y_modloss_z2`` as rows (ion, frag_charge, loss, intensity); another name is an error."""
    import re

    for c in columns:
        if not re.fullmatch(r"[by](_modloss)?_z[1-9]", c):
            raise ValueError(f"no ion type is named {c}")
    long = df.unpivot(key, columns, "_name", "intensity")
    return long.select(*key, F.substring("_name", 1, 1).alias("ion"), F.substring("_name", -1, 1).cast("int").alias("frag_charge"), F.when(F.col("_name").contains("modloss"), "modloss").otherwise("").alias("loss"), "intensity")


def with_decoys(df: DataFrame, peptide: str = "peptide") -> DataFrame:
    """Targets and their reversed decoys, told apart by ``decoy``."""
    from peaklane.functions.scalars import reverse_inner

    return df.withColumn("decoy", F.lit(0)).unionByName(df.withColumn(peptide, reverse_inner(F.col(peptide))).withColumn("decoy", F.lit(1)))


def target_groups(spark, wanted: str | None, database: DataFrame, group: str) -> DataFrame:
    """The groups of an explicit list separated by ``,`` or ``;``, or else all of the database."""
    if not wanted:
        return database.select(group).distinct()
    return spark.range(1).select(F.explode(F.array_distinct(F.split(F.lit(wanted), "[,;]"))).alias(group))
