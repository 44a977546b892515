"""Scalar functions: columns in, column out, inside generated code wherever Spark allows it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from peaklane.functions.constants import CCS_FACTOR, ELEMENTS, GAS_MASS, PROTON


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def mz(mass, charge) -> Column:
    """Mass over charge of a protonated molecule."""
    return (_c(mass) + _c(charge) * PROTON) / _c(charge)


def mass_error(observed, theoretical, ppm: bool = True) -> Column:
    delta = _c(observed) - _c(theoretical)
    return delta / _c(theoretical) * 1e6 if ppm else delta


def tolerance_range(mass, tolerance, ppm: bool = True) -> Column:
    """struct(lower, upper) around a mass."""
    m, t = _c(mass), _c(tolerance)
    lower, upper = (m / (1 + t / 1e6), m / (1 - t / 1e6)) if ppm else (m - t, m + t)
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def half_up(x) -> Column:
    """Rounding in which a half goes up, for negative numbers too."""
    return F.floor(_c(x) + 0.5)


def window_bounds(center, width) -> Column:
    half = _c(width) / 2
    return F.struct((_c(center) - half).alias("lower"), (_c(center) + half).alias("upper"))


def window_id(center, width) -> Column:
    half = _c(width) / 2
    return F.concat_ws("_", half_up((_c(center) - half) * 10).cast("string"), half_up((_c(center) + half) * 10).cast("string"))


def mz_bin(value, low, width: float = 0.05) -> Column:
    return half_up((_c(value) - _c(low)) / width)


def to_minutes(time, unit: str) -> Column:
    return _c(time) / 60 if unit == "second" else _c(time)


def auto_rt_window(low, high) -> Column:
    span = _c(high) - _c(low)
    return F.when(span <= 30, 0.5).when(span <= 60, 1.0).otherwise(1.5)


def reverse_inner(sequence) -> Column:
    """The sequence with all but its two ends reversed."""
    s = _c(sequence)
    n = F.length(s)
    return F.when(n <= 3, s).otherwise(F.concat(s.substr(F.lit(1), F.lit(1)), F.reverse(s.substr(F.lit(2), n - 2)), s.substr(n, F.lit(1))))


def primary_accession(group) -> Column:
    """The first accession of a list separated by ``;`` or `` / ``."""
    return F.trim(F.element_at(F.split(_c(group), r";| / "), 1))


def accession_token(accession) -> Column:
    """The second token of ``db|token|name``, or the whole accession."""
    parts = F.split(_c(accession), r"\|")
    return F.coalesce(F.get(parts, F.lit(1)), _c(accession))


def form_key(sequence, charge) -> Column:
    return F.concat_ws("|", _c(sequence), _c(charge).cast("string"))


def pair_key(a, b) -> Column:
    return F.concat_ws(":", _c(a), _c(b))


def split_pair(pair) -> Column:
    return F.struct(F.split_part(_c(pair), F.lit(":"), F.lit(1)).alias("a"), F.split_part(_c(pair), F.lit(":"), F.lit(2)).alias("b"))


def parse_title(title) -> Column:
    """``file:scan:charge``; the file may hold colons itself."""
    parts = F.split(_c(title), ":")
    return F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), ":").alias("file"), F.element_at(parts, -2).cast("int").alias("scan"), F.element_at(parts, -1).cast("int").alias("charge"))


def residues(sequence) -> Column:
    s = _c(sequence)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def mod_string(mods) -> Column:
    """``name@site[mass]`` joined by ``;`` for an array of struct(name, site, mass)."""
    return F.array_join(F.transform(_c(mods), lambda m: F.concat(m["name"], F.lit("@"), m["site"].cast("string"), F.lit("["), m["mass"].cast("string"), F.lit("]"))), ";")


def _plain(decimal: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(decimal.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def bracket_sequence(sequence, mods) -> Column:
    """The sequence with the summed decimal mass of a residue's modifications in brackets; site 0 counts to residue 1."""
    zero = F.lit(Decimal(0)).cast("decimal(20,14)")

    def shown(residue: Column, i: Column) -> Column:
        here = F.filter(_c(mods), lambda m: F.greatest(m["site"], F.lit(1)) == i + 1)
        total = F.aggregate(here, zero, lambda a, m: (a + m["mass"]).cast("decimal(20,14)"))
        return F.when(F.size(here) > 0, F.concat(residue, F.lit("["), _plain(total), F.lit("]"))).otherwise(residue)

    return F.array_join(F.transform(residues(sequence), shown), "")


_MARKER = r"\((?:unimod|UniMod):\d+\)"


def strip_unimod(sequence) -> Column:
    return F.regexp_replace(_c(sequence), _MARKER, "")


def parse_unimod(sequence) -> Column:
    """Map from the place in the stripped sequence (0: before it) to residue and marker."""
    parts = F.regexp_extract_all(_c(sequence), F.lit(rf"{_MARKER}|[^()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("last"), F.array().cast("array<struct<site:int,text:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        mark = F.length(part) > 1
        text = F.when(acc.n == 0, F.regexp_replace(part, r"[()]", "")).otherwise(F.concat(acc["last"], part))
        found = F.concat(acc.out, F.array(F.struct(acc.n.alias("site"), text.alias("text"))))
        return F.struct(F.when(mark, acc.n).otherwise(acc.n + 1).alias("n"), F.when(mark, acc["last"]).otherwise(part).alias("last"), F.when(mark, found).otherwise(acc.out).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: F.map_from_entries(acc.out))


def render_modified(sequence, mods, names: dict[str, str], dialect: str) -> Column:
    """The sequence with modifications after their residues. ``mods``: array of struct(name, site); ``names``: text of
    each name. Dialects: ``unimod`` and ``name`` show each text in parentheses or brackets, ``mass`` their decimal sum."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    left, right = ("(", ")") if dialect == "unimod" else ("[", "]")
    if dialect == "mass":
        return bracket_sequence(sequence, F.transform(_c(mods), lambda m: F.struct(m["name"].alias("name"), m["site"].alias("site"), table[m["name"]].cast("decimal(20,14)").alias("mass"))))

    def shown(residue: Column, i: Column) -> Column:
        here = F.filter(_c(mods), lambda m: F.greatest(m["site"], F.lit(1)) == i + 1)
        return F.concat(residue, F.array_join(F.transform(here, lambda m: F.concat(F.lit(left), table[m["name"]], F.lit(right))), ""))

    return F.array_join(F.transform(residues(sequence), shown), "")


def encode_modified(sequence, mods, codes: dict[str, str]) -> Column:
    """A code before the sequence (``-`` for none), codes in place of modified residues, ``-`` at the end. A name
    without a code leaves the residue as it is."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    coded = F.filter(F.transform(_c(mods), lambda m: F.struct(m["site"].alias("site"), table[m["name"]].alias("code"))), lambda m: m["code"].isNotNull())

    def shown(found: Column) -> Column:
        at = lambda i: F.get(F.filter(found, lambda m: m["site"] == i), F.lit(0))["code"]
        body = F.array_join(F.transform(residues(sequence), lambda r, i: F.coalesce(at(i + 1), r)), "")
        some = F.exists(found, lambda m: m["site"] > 0)
        return F.concat(F.coalesce(at(F.lit(0)), F.lit("-")), F.when(some, body).otherwise(_c(sequence)), F.lit("-"))

    # bound once: the list of modifications must not be made again for each residue
    return F.element_at(F.transform(F.array(coded), shown), 1)


def residue_codes(sequence) -> Column:
    """A to Z as 1 to 26, with 0 at both ends."""
    zero = F.array(F.lit(0))
    return F.concat(zero, F.transform(residues(sequence), lambda r: F.ascii(r) - 64), zero)


def formula_counts(formula) -> Column:
    """``H(2)C(1)`` as a map from element to count; elements that aren't known add up under ``?``."""
    names = F.regexp_extract_all(_c(formula), F.lit(r"([^()]+)\((-?\d+)\)"), F.lit(1))
    counts = F.regexp_extract_all(_c(formula), F.lit(r"([^()]+)\((-?\d+)\)"), F.lit(2))
    pairs = F.arrays_zip(F.transform(names, lambda e: F.when(e.isin(ELEMENTS), e).otherwise("?")).alias("e"), counts.alias("n"))
    total = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + p["n"].cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["e"])), lambda e: F.struct(e.alias("e"), total(e).alias("n"))))


def instrument_index(name, families: dict[str, str], order: list[str], default: str) -> Column:
    """The place of the instrument's family in ``order``; an unknown instrument counts as ``default``."""
    table = F.create_map(*[F.lit(x) for k, v in families.items() for x in (k.upper(), order.index(v))])
    return F.coalesce(table[F.upper(_c(name))], F.lit(order.index(default)))


def log2p1(x) -> Column:
    return F.log2(_c(x) + 1)


def inv_log2p1(x) -> Column:
    return F.pow(F.lit(2.0), _c(x)) - 1


def normalize_rt(rt, low, high) -> Column:
    return (_c(rt) - _c(low)) / (_c(high) - _c(low))


def denormalize_rt(x, low, high) -> Column:
    return _c(x) * (_c(high) - _c(low)) + _c(low)


def _reduced(charge, mass_to_charge) -> Column:
    mass = _c(charge) * _c(mass_to_charge)
    return mass * GAS_MASS / (mass + GAS_MASS)


def mobility_to_ccs(mobility, charge, mass_to_charge) -> Column:
    """Collision cross section by the Mason-Schamp equation."""
    return _c(mobility) * _c(charge) * CCS_FACTOR / F.sqrt(_reduced(charge, mass_to_charge))


def ccs_to_mobility(ccs, charge, mass_to_charge) -> Column:
    return _c(ccs) * F.sqrt(_reduced(charge, mass_to_charge)) / CCS_FACTOR / _c(charge)


def fill_text(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def clip_floor(x, floor: float) -> Column:
    return F.greatest(_c(x), F.lit(floor))
