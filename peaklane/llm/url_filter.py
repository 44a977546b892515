"""URL allow and block lists by cascades of Bloom filters, in DataFrame operations only.

A rule is a host and the beginning of a path (``example.net/en/``); its text is its key. The keys that a URL could be
listed by are the ends of its host joined with the beginnings of its path, in the shapes (labels of the host, length of
the path) that the list has. The corpus's own keys are the universe of the cascade: the first filter encodes the listed
keys, the second the keys of the universe that pass the first without being listed, the third the listed keys that pass
the second, and so on until no key passes wrongly. The first filter that says no then gives the exact answer for every
key of the corpus, so rows are judged where they stand, without a join.

The keys that pass the first filter are gathered once, without repeats, so a host of any number of pages is one row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklane.llm.scratch import written

#: Bytes of filters that a task is given at once; a longer list is taken in slices.
FILTER_BYTES = 16 << 20
#: Share of unlisted keys that pass the first filter, and those after it.
FIRST_RATE, NEXT_RATE = 1 / 1024, 1 / 2
#: Bits of one bitmap of ``bitmap_construct_agg``.
_BITMAP = 32768
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for others and null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and texts without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``bits`` in ``blob``, ``hashes`` places for each key; ``number`` seeds its hashes."""

    number: int
    bits: int
    hashes: int
    blob: bytes

    def places(self, key: Column) -> list[Column]:
        return _places(key, self.number, self.bits, self.hashes)

    def passes(self, key: Column) -> Column:
        return reduce(lambda a, b: a & b, [_bit(self.blob, p) for p in self.places(key)])


def _places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(k)), F.lit(bits)) for k in range(hashes)]


def _bit(blob: bytes, place: Column) -> Column:
    at = F.call_function("substring", F.lit(blob), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(at), 16, 10).cast("int"), (place % 8).cast("int")) == 1


def filter_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter of ``n`` keys that passes the share ``rate`` of others."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return -(-bits // 8) * 8, max(1, round(-math.log2(rate)))


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """The filter of the column ``key``: bitmaps are made where the keys are and merged; the driver gets the filter alone,
    whose size is set beforehand by ``n``."""
    bits, hashes = filter_size(n, rate)
    place = keys.select(F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("p")).select((F.col("p") + 1).alias("p"))
    maps = place.groupBy(F.call_function("bitmap_bucket_number", "p").alias("k")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias("m"))
    held = {r.k: bytes(r.m) for r in maps.collect()}
    whole = b"".join(held.get(k + 1, bytes(_BITMAP // 8)) for k in range(-(-bits // _BITMAP)))
    return Level(number, bits, hashes, whole[: bits // 8])


def build_cascade(first: Level, listed: DataFrame, passed: DataFrame, rate: float = NEXT_RATE) -> list[Level]:
    """The filters after ``first`` (made of ``listed``), for a universe whose keys that pass it are ``passed``."""
    levels = [first]
    known = listed.select("key").distinct()
    sets = [written(passed.join(known, "key", how), "sets") for how in ("left_anti", "left_semi")]  # without and with listing
    while n := sets[0].count():
        level = build_level(sets[0], n, rate, first.number + len(levels))
        levels.append(level)
        sets = [written(sets[1].filter(level.passes(F.col("key"))), "sets"), sets[0]]
    return levels


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first filter that it fails decides."""
    if not levels:
        return F.lit(False)
    return levels[0].passes(key) & ~in_cascade(levels[1:], key)


def _rules(rules: DataFrame, rule: str, action: str) -> DataFrame:
    """(key, action, labels, size): distinct rules with a host; a rule listed in both ways blocks."""
    host, path = F.regexp_extract(rule, r"(?s)^[^/]*", 0), F.regexp_extract(rule, r"(?s)/.*$", 0)
    host = F.translate(host, _UPPER, _LOWER)
    cut = rules.select(F.concat(host, path).alias("key"), F.col(action).alias("action"), _labels(host).alias("labels"), F.length(path).alias("size"), host.alias("host"))
    kept = cut.filter((F.col("host") != "") & F.col("action").isin("allow", "block"))
    return kept.groupBy("key").agg(F.max("action").alias("action"), F.first("labels").alias("labels"), F.first("size").alias("size"))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of the given shapes (labels, path length) that fit a URL, the longest first."""
    if not shapes:
        return F.array().cast("array<string>")
    listed = F.from_json(F.lit(json.dumps([{"d": d, "n": n} for d, n in shapes])), "array<struct<d:int,n:int>>")
    fits = F.filter(listed, lambda s: (s.d <= _labels(host)) & (s.n <= F.length(path)))
    keys = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s.d), F.substr(path, F.lit(1), s.n)))
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(F.array_distinct(keys), order)


def url_filter(pages: DataFrame, rules: DataFrame, *, ids: str = "page_id", url: str = "url", rule: str = "rule", action: str = "action", default: str = "allow", rate: float = FIRST_RATE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(ids, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains if the path begins with the rule's path; the longest rule that fits decides
    (of equally long ones the first by text), and its ``action`` ("allow" or "block") is the verdict. Without a rule that
    fits, ``rule`` is null and the verdict ``default``.

    Null URLs, and those without ``://``, have an empty host and path, which no rule fits. Rules of null, without a host or
    with another action never fit; repeated rules are one, and a rule listed in both ways blocks. Repeated rows, null ids
    and ids of any type give a row each; other columns are left out, whatever their names. A host or path of any length
    gives as many keys as the list has shapes. An empty list gives the default, an empty table no rows. Lists whose filters
    would exceed ``filter_bytes`` are taken in slices by a hash of the key, one pass over the rows for each.
    """
    spark = pages.sparkSession
    held = written(_rules(rules, rule, action), "rules")
    told = held.groupBy("action").count().collect()  # two rows at most
    counts = {r["action"]: r["count"] for r in told}
    # as many rows as there are pairs of a label count and a path length
    shapes = sorted((r.labels, r.size) for r in held.select("labels", "size").distinct().collect())
    need = sum(filter_size(n, rate)[0] // 8 for n in counts.values())
    slices = max(1, -(-need // filter_bytes))
    rows = pages.select(F.col(ids).alias("_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.select("*", candidate_keys(F.col("host"), F.col("path"), shapes).alias("_keys"), F.lit(None).cast("struct<size:int,rule:string,action:string>").alias("_found"))
    for s in range(slices):
        listed = {a: held.filter((F.col("action") == a) & _in_slice(F.col("key"), s, slices)) for a in counts}
        cascades = _cascades(listed, rows, s, slices, rate)
        tops = {f"_{a}": F.get(F.filter("_keys", _member(c, s, slices)), F.lit(0)) for a, c in cascades.items()}
        told = [F.when(F.col(f"_{a}").isNotNull(), F.struct(F.length(f"_{a}").alias("size"), F.col(f"_{a}").alias("rule"), F.lit(a).alias("action"))) for a in cascades]
        rows = rows.withColumns(tops).select("_id", "host", "path", "_keys", _better(F.col("_found"), *told).alias("_found"))
        rows = written(rows, "found") if s + 1 < slices else rows
    return rows.select(F.col("_id").alias(ids), "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.action", F.lit(default)).alias("verdict"))


def _cascades(listed: dict[str, DataFrame], rows: DataFrame, part: int, slices: int, rate: float) -> dict[str, list[Level]]:
    """A cascade for each action; the keys that pass any of the first filters are gathered in one pass over the rows."""
    first = {}
    for k, (name, keyed) in enumerate(sorted(listed.items())):
        if n := keyed.count():
            first[name] = build_level(keyed, n, rate, 1000 * k)
    if not first:
        return {}
    passes = lambda key: reduce(lambda a, b: a | b, [f.passes(key) for f in first.values()])
    some = F.filter("_keys", lambda k: _in_slice(k, part, slices) & passes(k))
    passed = written(rows.select(F.explode(some).alias("key")).distinct(), "passed")
    return {name: build_cascade(level, listed[name], passed.filter(level.passes(F.col("key")))) for name, level in first.items()}


def _in_slice(key: Column, part: int, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices)) == part if slices > 1 else F.lit(True)


def _member(levels: list[Level], part: int, slices: int) -> Callable[[Column], Column]:
    return lambda key: _in_slice(key, part, slices) & in_cascade(levels, key)


def _better(*found: Column) -> Column:
    """Of structs (size, rule, action) the longest, then the first by rule."""
    def pick(a: Column, b: Column) -> Column:
        first = (a["size"] > b["size"]) | ((a["size"] == b["size"]) & (a["rule"] <= b["rule"]))
        return F.when(a.isNull(), b).when(b.isNull() | first, a).otherwise(b)

    return reduce(pick, found)
