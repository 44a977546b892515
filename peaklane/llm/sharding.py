"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to one of ``ring`` places; each shard owns the arcs that end at its virtual nodes. A shard takes the keys
of its own arcs up to its capacity, in ring order; the keys beyond that continue clockwise to the next virtual node
of a shard with room. Capacities add up to the number of rows and differ by one at most, so balance is exact, and a
key leaves its home only if that is full.

Only counts reach the driver: one a ring place, and ``SALTS`` for each key of more than ``4 / ring`` of all rows (``ring / 4``
keys at most), whatever the size of the table. The plan that comes back is a table of row ranges of the same order and is
broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from peaklane.llm.names import own_names
from peaklane.llm.scratch import written

#: Parts into which the rows of a frequent key are dealt for numbering, so that they don't stay in one task.
SALTS = 64


def ring_owners(shards: int, nodes: int, ring: int) -> list[int]:
    """The shard that owns each place: that of the first virtual node at the place or clockwise of it."""
    spots = sorted((int.from_bytes(hashlib.sha256(f"{s}:{k}".encode()).digest()[:8], "big") * ring >> 64, s) for s in range(shards) for k in range(nodes))
    owners, at = [], 0
    for place in range(ring):
        while at < len(spots) and spots[at][0] < place:
            at += 1
        owners.append(spots[at % len(spots)][1])
    return owners


def bounded_plan(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first row, end row, shard, slot of the first row): how the rows of each place are assigned."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot, plan, over = [0] * shards, [], []

    def take(place: int, first: int, n: int, shard: int) -> int:
        if n := min(n, room[shard]):
            plan.append((place, first, first + n, shard, slot[shard]))
            room[shard] -= n
            slot[shard] += n
        return n

    for place, n in enumerate(counts):
        if n and (got := take(place, 0, n, owners[place])) < n:
            over.append((place, got, n))
    for place, first, n in over:
        at = place
        while first < n:
            at = (at + 1) % len(owners)
            first += take(place, first, n - first, owners[at])
    return plan


def _hashable(field: T.StructField) -> Column:
    """A column that can be hashed: maps and variants can only as text."""
    odd = any(kind in field.dataType.json() for kind in ('"map"', '"variant"'))
    return F.to_json(F.struct(field.name)) if odd else F.col(field.name)


def _parts(keyed: DataFrame, ring: int) -> DataFrame:
    """``keyed`` with ``_part``: 0, or for a row of a frequent key one of that key's parts."""
    spark = keyed.sparkSession
    counts = {r["_place"]: r["count"] for r in keyed.groupBy("_place").count().collect()}  # ring rows at most
    limit = max(1000, 4 * sum(counts.values()) // ring)
    full = spark.createDataFrame([(p,) for p, n in counts.items() if n > limit], "_place int")
    often = keyed.join(F.broadcast(full), "_place", "left_semi").groupBy("_hash").count().filter(F.col("count") > limit)
    hot = [r["_hash"] for r in often.collect()]  # ring / 4 rows at most, since each has more than 4 / ring of all
    if not hot:
        return keyed.withColumn("_part", F.lit(0))
    numbered = spark.createDataFrame([(h, 1 + k * SALTS) for k, h in enumerate(sorted(hot))], "_hash long, _base int")
    part = F.coalesce(F.col("_base") + F.pmod("_row", F.lit(SALTS)).cast("int"), F.lit(0))
    return keyed.join(F.broadcast(numbered), "_hash", "left").withColumn("_part", part).drop("_base")


@own_names("key")
def assign_shards(docs: DataFrame, *, key: str = "doc_id", shards: int = 8, nodes: int = 128, ring: int = 16384) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (its number within the shard, without gaps) and ``home_shard``.

    Shards hold equal numbers of rows, give or take one. Every row counts, repeated rows and repeated keys too; a
    null key is a key of its own. Which row goes where depends on the rows alone and not on how they are partitioned, but
    for the rows of one frequent key, which may trade places. An empty table stays empty. Columns named like a new one
    are replaced, others pass through whatever their names and types.

    From 8 to 9 shards about an eighth of the rows move (a ninth must).
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "home_shard")
    owners = ring_owners(shards, nodes, ring)
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull())
    keyed = docs.withColumns({"_hash": hashed, "_body": F.xxhash64(*map(_hashable, docs.schema.fields)), "_row": F.monotonically_increasing_id()})
    keyed = written(keyed.withColumn("_place", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(ring)).cast("int")), "keyed")
    keyed = _parts(keyed, ring)
    counts: list[dict[int, int]] = [{} for _ in range(ring)]
    for r in keyed.groupBy("_place", "_part").count().collect():
        counts[r["_place"]][r["_part"]] = r["count"]
    ranges = []
    for place, first, end, shard, slot in bounded_plan([sum(c.values()) for c in counts], owners, shards):
        base = 0
        for part, n in sorted(counts[place].items()):
            lo, hi = max(first, base), min(end, base + n)
            if lo < hi:
                ranges.append((place, part, lo - base, hi - base, shard, slot + lo - first, owners[place]))
            base += n
    plan = spark.createDataFrame(ranges, "_place int, _part int, _lo long, _hi long, shard int, _slot long, home_shard int")
    number = F.row_number().over(Window.partitionBy("_place", "_part").orderBy("_hash", "_body", "_row")) - 1
    rows = keyed.withColumn("_n", number).join(F.broadcast(plan), ["_place", "_part"]).filter((F.col("_n") >= F.col("_lo")) & (F.col("_n") < F.col("_hi")))
    return rows.select(*docs.columns, "shard", (F.col("_slot") + F.col("_n") - F.col("_lo")).alias("slot"), "home_shard")
