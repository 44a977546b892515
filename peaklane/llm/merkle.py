"""A Merkle manifest of a dataset, kept as a postorder append log.

Each group of rows (a language) has a tree over its leaves in the order of their ids, ``arity`` children a node; a last
node may have fewer. The trees' roots are the leaves of one more tree. A node's digest hashes the digests of its children
as hex text.

Trees are built by aligned builders: a builder takes ``arity ** levels`` neighbouring nodes, whose place in the tree is a
multiple of that, and appends nodes in the order in which they are complete (postorder), so its part of the log needs no
other builder. The roots of a round's builders are the leaves of the next round, which has ``arity ** levels`` times
fewer. In postorder the place of every node follows from the sizes of the subtrees before it (``postorder``), so the
siblings that a proof needs are addressed and never searched.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from peaklane.llm.scratch import written

ARITY, LEVELS = 8, 3
#: Rows up to which a table of groups is broadcast.
FEW = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_bytes(*columns: Column) -> Column:
    """The text that a leaf hashes: of each column ``-`` if null, else its UTF-8 length, ``:`` and its value."""
    value = [c.cast("string") for c in columns]
    return F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in value])


def widths(n: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level over ``n`` leaves, leaves first, up to the single root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def postorder(level: int, index: int, n: int, arity: int = ARITY) -> int:
    """The place of a node in the postorder log of a tree of ``n`` leaves, from 0: the nodes of lower levels that are complete
    with it, those of its level before it, and those of higher levels that were complete before its first leaf."""
    last = min((index + 1) * arity**level, n)
    below = sum(-(-last // arity**k) for k in range(level))
    above = sum(index // arity ** (k - level) for k in range(level + 1, len(widths(n, arity))))
    return below + index + above


def subtree_size(level: int, index: int, n: int, arity: int = ARITY) -> int:
    """Nodes of the subtree: its log entries end with the node itself."""
    first, last = index * arity**level, min((index + 1) * arity**level, n)
    return sum(-(-last // arity**k) - first // arity**k for k in range(level + 1))


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def built_levels(n: int, levels: int, arity: int = ARITY) -> int:
    """How far a builder of a tree of ``n`` leaves climbs: up to the root, or ``levels`` if others take part. So a last builder
    of few leaves ends with runs of one node."""
    return levels if n > arity**levels else len(widths(n, arity)) - 1


def append_log(leaves: list[str], top: int, arity: int = ARITY) -> list[str]:
    """What one builder writes: the nodes up to ``top`` levels above its leaves, each as soon as its children are complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(top + 1)]

    def done(digest: str, level: int) -> None:
        log.append(digest)
        waiting[level].append(digest)
        if level < top and len(waiting[level]) == arity:
            closed(level)

    def closed(level: int) -> None:
        children, waiting[level] = waiting[level], []
        done(node(children), level + 1)

    for leaf in leaves:
        done(leaf, 0)
    for level in range(top):
        if waiting[level]:
            closed(level)
    return log


def siblings(log: list[str], index: int, n: int, top: int, arity: int = ARITY) -> list[tuple[int, list[str]]]:
    """For each level of a builder from its leaf on: the place of the node in its run and the others of the run, read from
    the log of its ``n`` leaves by their postorder places."""
    out = []
    for level in range(top):
        start = index // arity * arity
        run = range(start, min(start + arity, -(-n // arity**level)))
        out.append((index - start, [log[postorder(level, k, n, arity)] for k in run if k != index]))
        index //= arity
    return out


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for place, others in path:
        leaf = node([*others[:place], leaf, *others[place:]])
    return leaf


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``index`` from 0 within the group and ``n``, the group's rows. Rows are dealt by ranges of the whole order
    and numbered within them; the counts of the ranges, one row each, give what comes before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    at = F.monotonically_increasing_id()
    placed = written(dealt.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "placed")
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    bases = placed.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    based = placed.join(F.broadcast(bases), "_part").withColumn("_at", F.col("_at") + F.col("_base"))
    groups = written(based.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("_at").alias("_first"), F.count("*").alias("n")), "groups")
    few = groups.count() <= FEW
    joined = based.join(F.broadcast(groups) if few else groups, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    return joined.withColumn("index", F.col("_at") - F.col("_first")).drop("_part", "_at", "_base", "_first", *[f"_{g}" for g in group])


def build_round(leaves: DataFrame, depth: int, levels: int = LEVELS, arity: int = ARITY, carried: list[str] | None = None) -> DataFrame:
    """One round of builders over ``leaves(tree, index, n, total, digest)``: (tree, segment, n, total, depth, digest, log, root
    and the lists ``carried``). ``digest``: the builder's own leaves; ``log``: its nodes in postorder, the last one its
    ``root``; ``depth``: the level of its leaves in the tree; ``total``: the tree's leaves."""
    segment = F.floor(F.col("index") / arity**levels).cast("long").alias("segment")
    lists = ["digest", *(carried or [])]
    made = leaves.groupBy("tree", segment).agg(F.first("n").alias("n"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("index", *lists))).alias("items"))
    made = made.select("tree", "segment", "n", "total", F.lit(depth).alias("depth"), *[F.col(f"items.{c}").alias(c) for c in lists])
    schema = T.StructType([*made.schema.fields, T.StructField("log", T.ArrayType(T.StringType())), T.StructField("root", T.StringType())])

    def build(batches):
        for batch in batches:
            logs = [append_log(d.as_py(), built_levels(n.as_py(), levels, arity), arity) for d, n in zip(batch.column("digest"), batch.column("n"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.list_(pa.string())), pa.array([x[-1] for x in logs], pa.string())], names=schema.names)

    return written(made.mapInArrow(build, schema), "segments")


def build_trees(leaves: DataFrame, levels: int = LEVELS, arity: int = ARITY, carried: list[str] | None = None) -> list[DataFrame]:
    """The rounds of builders over ``leaves(tree, index, n, digest)`` until each tree has one segment. A tree that is done
    takes no part in further rounds."""
    rounds, span, leaves = [], arity**levels, leaves.withColumn("total", F.col("n"))
    while True:
        rounds.append(build_round(leaves, len(rounds) * levels, levels, arity, carried if not rounds else None))
        open_ = rounds[-1].filter(F.col("n") > span)
        if not open_.limit(1).count():
            return rounds
        leaves = open_.select("tree", F.col("segment").alias("index"), F.ceil(F.col("n") / span).cast("long").alias("n"), "total", F.col("root").alias("digest"))


def roots(rounds: list[DataFrame], levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """(tree, root) of all trees."""
    return reduce(DataFrame.unionByName, [r.filter(F.col("n") <= arity**levels).select("tree", "root") for r in rounds])


def node_log(rounds: list[DataFrame], levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """(tree, position, level, index, digest): the log of whole trees, every node at its postorder place."""
    kind = T.StructType([rounds[0].schema["tree"], *[T.StructField(c, T.LongType()) for c in ("position", "level", "index")], T.StructField("digest", T.StringType())])

    def place(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("segment", "n", "total", "depth", "held", "log")}
                found = []
                for level in range(built_levels(row["n"], levels, arity) + 1):
                    wide = -(-row["held"] // arity**level)
                    for i in range(wide if level or not row["depth"] else 0):  # a later round's leaves are roots of the round before
                        at = (row["depth"] + level, row["segment"] * arity ** (levels - level) + i)
                        found.append((postorder(*at, row["total"], arity), *at, row["log"][postorder(level, i, row["held"], arity)]))
                tree = batch.column("tree").take(pa.array([k] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([tree, *[pa.array(c) for c in zip(*found, strict=True)]], names=kind.names)

    parts = [r.select("tree", "segment", "n", "total", "depth", F.size("digest").alias("held"), "log").mapInArrow(place, kind) for r in rounds]
    return reduce(DataFrame.unionByName, parts)


def read_proofs(log: DataFrame, wanted: DataFrame, arity: int = ARITY) -> DataFrame:
    """(tree, index, proof) for ``wanted(tree, index, n)``: the siblings of some leaves, read from ``node_log`` at their
    computed places only."""

    def places(index, n):
        out = []
        for level, wide in enumerate(widths(n, arity)[:-1]):
            start = index // arity * arity
            out += [postorder(level, k, n, arity) for k in range(start, min(start + arity, wide)) if k != index]
            index //= arity
        return list(enumerate(out))

    listed = F.udf(places, "array<struct<step:int,position:bigint>>")("index", "n")
    steps = wanted.select("tree", "index", F.explode_outer(listed).alias("s")).select("tree", "index", "s.*")
    found = steps.join(log.select("tree", "position", "digest"), ["tree", "position"], "left")
    lists = found.groupBy("tree", "index").agg(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "digest")))).alias("s"))
    return lists.select("tree", "index", F.col("s.digest").alias("proof"))


_PATH = "array<struct<place:int,others:array<string>>>"
_ARROW_PATH = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def _paths(segments: DataFrame, levels: int, arity: int) -> DataFrame:
    """(tree, segment, index, path): for each leaf of a round's builders its siblings up to the builder's root."""

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, held, log, segment = (batch.column(c)[k].as_py() for c in ("n", "held", "log", "segment"))
                top, first = built_levels(n, levels, arity), segment * arity**levels
                paths = [[{"place": p, "others": o} for p, o in siblings(log, i, held, top, arity)] for i in range(held)]
                same = pa.array([k] * held, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("tree").take(same), batch.column("segment").take(same), pa.array(range(first, first + held), pa.int64()), pa.array(paths, _ARROW_PATH)], names=["tree", "segment", "index", "path"])

    schema = T.StructType([segments.schema["tree"], T.StructField("segment", T.LongType()), T.StructField("index", T.LongType()), T.StructField("path", T.DataType.fromDDL(_PATH))])
    return segments.select("tree", "segment", "n", F.size("digest").alias("held"), "log").mapInArrow(read, schema)


def leaf_paths(rounds: list[DataFrame], levels: int = LEVELS, arity: int = ARITY) -> DataFrame | None:
    """(tree, index, path): for each leaf of the first of the rounds its siblings up to the tree's root; none: no round."""
    above = None
    for segments in reversed(rounds):
        own = _paths(segments, levels, arity)
        if above is not None:
            higher = above.select("tree", F.col("index").alias("segment"), F.col("path").alias("more"))
            own = own.join(higher, ["tree", "segment"], "left").withColumn("path", F.concat("path", F.coalesce("more", F.array().cast(_PATH))))
        above = written(own.select("tree", "index", "path"), "paths")
    return above


def merkle_manifest(docs: DataFrame, *, ids: str = "doc_id", group: str = "lang", fields: list[str] | None = None, text: str = "text", changed: Column | None = None, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """(ids, leaf, subroot, root, proof_sha256, n_siblings, folded_root, verified) for every row of ``docs``.

    A leaf hashes ``fields`` (default: doc_id, source, lang, n_chars, text) in ``field_bytes`` form. Within a group leaves stand
    in ascending order of id (null first), rows of the same id in the order of their leaf; equal rows are leaves of their own.
    Groups in ascending order (null first) give the root over their subroots. ``proof_sha256`` hashes the siblings from the
    leaf up to the root, left to right within a level (none: of the empty text). ``changed`` is verified in place of ``text``
    (default: the text itself): ``folded_root`` is recomputed from the leaf with it and the siblings, and ``verified`` says
    that it is the root.

    Null fields hash as ``-``, empty texts as ``0:``. A text of any length is hashed whole where it is read, and only its
    digests travel. An empty table gives no rows. Other columns are left out, whatever their names; ``ids`` and ``group`` may
    be of any type that has an order.
    """
    fields = fields or ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = F.sha2(field_bytes(*[F.col(f) for f in fields]), 256)
    told = F.lit(None).cast("string") if changed is None else F.sha2(field_bytes(*[changed if f == text else F.col(f) for f in fields]), 256)
    # equal rows are dealt over ranges by their row number, which is written with them
    rows = docs.select(F.struct(F.col(group).alias("of")).alias("tree"), F.col(ids).alias("id"), leaf.alias("digest"), F.when(told != leaf, told).alias("told"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "leaves")
    leaves = numbered(rows, ["tree"], ["id", "digest", "told", "row"])
    rounds = build_trees(leaves.select("tree", "index", "n", "digest", "id", "told"), levels, arity, ["id", "told"])

    subroots = roots(rounds, levels, arity).select(F.struct(F.lit(0).alias("all")).alias("top"), "tree", F.col("root").alias("digest"))
    tops = written(numbered(subroots, ["top"], ["tree"]), "tops")
    last = build_trees(tops.select(F.col("top").alias("tree"), "index", "n", "digest"), levels, arity)
    outer = leaf_paths(last, levels, arity).select("index", F.col("path").alias("outer"))
    across = tops.select("tree", "index", F.col("digest").alias("subroot")).join(outer, "index").drop("index")
    across = written(across.crossJoin(F.broadcast(roots(last, levels, arity).select(F.col("root").alias("all_root")))), "across")  # one row
    across = F.broadcast(across) if across.count() <= FEW else across

    upper = leaf_paths(rounds[1:], levels, arity)
    segments = rounds[0].select("tree", "segment", "n", "id", "digest", "told", "log")
    if upper is None:
        segments = segments.withColumn("upper", F.array().cast(_PATH))
    else:
        segments = segments.join(upper.select("tree", F.col("index").alias("segment"), F.col("path").alias("upper")), ["tree", "segment"], "left").withColumn("upper", F.coalesce("upper", F.array().cast(_PATH)))
    whole = segments.join(across, "tree").select("n", "id", "digest", "told", "log", F.concat("upper", "outer").alias("above"), "subroot", "all_root")
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "n_siblings", "folded_root"]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(c, T.LongType() if c == "n_siblings" else T.StringType()) for c in names[1:]]])

    def prove(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("n", "digest", "told", "log", "above", "subroot", "all_root")}
                above = [(p["place"], p["others"]) for p in row["above"]]
                rest = [x for _, others in above for x in others]
                held, top, proofs = len(row["digest"]), built_levels(row["n"], levels, arity), []
                for i, (digest, other) in enumerate(zip(row["digest"], row["told"], strict=True)):
                    own = siblings(row["log"], i, held, top, arity)
                    proof = [*(x for _, others in own for x in others), *rest]
                    proofs.append((node(proof), len(proof), fold(other or digest, [*own, *above])))
                sums, sizes, folded = zip(*proofs, strict=True)
                same = [pa.array([row[c]] * held) for c in ("subroot", "all_root")]
                yield pa.RecordBatch.from_arrays([batch.column("id")[k].values, pa.array(row["digest"]), *same, pa.array(sums), pa.array(sizes, pa.int64()), pa.array(folded)], names=names)

    proved = whole.mapInArrow(prove, schema)
    return proved.select(F.col("id").alias(ids), *names[1:], (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_where(text: Column, test: Column) -> Column:
    """The text with A-Z lower-cased where the test holds."""
    return F.when(test, F.translate(text, _UPPER, _LOWER)).otherwise(text)
