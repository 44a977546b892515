"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``keys`` small keys are computed for a document, each key from ``rows`` minima. A table's key is a
pair of one small key of either collection, so ``keys ** 2`` tables cost ``2 * keys`` small keys: the minima grow as
the root of the number of tables. Documents of a table's bucket are candidates and are confirmed on their full sets.

At similarity s two documents miss each other with a probability of about ``2 * (1 - s ** rows) ** keys``: 1.4e-4
for the defaults at 0.85, 1e-6 at 0.9.

Sets that are equal collapse into classes first. Within a bucket, classes first meet one pivot (the class with most
bucket mates). Classes of buckets that are not connected after that meet those of other components by a prefix
filter, which loses no similar pair. So a large group costs a star, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from peaklane.llm.components import components
from peaklane.llm.scratch import written
from peaklane.llm.words import Words, _draw, _slices, mixed, words

#: Distinct shingles whose minima are taken at once.
_CHUNK = 1 << 15


def _parts(batches, texts: list[int]):
    """The rows of ``batches`` in slices whose texts span about 1 MB together, which bounds the arrays made of them (a longer
    row is a slice of its own)."""
    for batch in batches:
        sizes = [pc.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False) for k in texts]
        for a, b in _slices(np.concatenate([[0], np.cumsum(sum(sizes), dtype=np.int64)])):
            yield batch.slice(a, b - a)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents one after the other, and the offsets of each document.

    A document of fewer than ``size`` words, but not none, has one shingle: all of its words.
    """
    at, code = w.windows(size, 67)
    first = np.searchsorted(at, w.first)
    short = np.diff(w.first)
    sets = []
    factor = _draw(71, size)
    for d in range(len(short)):
        if short[d] >= size:
            sets.append(np.unique(code[first[d] : first[d + 1]]))
        elif short[d]:
            own = w.code[w.first[d] : w.first[d + 1]]
            sets.append(mixed(np.array([(own * factor[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def _signatures(codes: np.ndarray, offsets: np.ndarray, keys: int, rows: int) -> np.ndarray:
    """For each document (without empty ones) its ``2 * keys`` small keys."""
    factors, out, a, n = _draw(73, 2 * keys * rows), [], 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1))
        part, cut = codes[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        small = np.zeros((b - a, 2 * keys), np.uint64)
        for k, f in enumerate(factors):
            x = part * f
            small[:, k // rows] = mixed(small[:, k // rows] + np.minimum.reduceat(x ^ (x >> np.uint64(29)), cut))
        out.append(small)
        a = b
    return np.concatenate(out) if out else np.zeros((0, 2 * keys), np.uint64)


def _sketch(docs: DataFrame, ids: str, text: str, size: int, keys: int, rows: int) -> DataFrame:
    schema = T.StructType([docs.schema[ids], T.StructField("told", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("small", T.ArrayType(T.LongType()))])

    def sketch(batches):
        for batch in _parts(batches, [2]):
            codes, offsets = shingles(words(batch.column(2), seed=61, lower=True), size)
            n = np.diff(offsets)
            full = n > 0
            at = offsets[:-1][full]
            sums = [np.add.reduceat(mixed(codes ^ np.uint64(s)), at).view(np.int64) if len(at) else np.zeros(0, np.int64) for s in (0x9E37, 0xC2B2)]
            small = _signatures(codes, np.concatenate([at, offsets[-1:]]), keys, rows).view(np.int64)
            place = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * 2 * keys, pa.int32()), pa.array(small.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(s).take(place) for s in sums], lists.take(place)], names=schema.names)

    return docs.select(ids, F.xxhash64(text).alias("told"), text).mapInArrow(sketch, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def confirm(batches):
        for batch in _parts(batches, [2, 3]):
            (a, x), (b, y) = (shingles(words(batch.column(k), seed=61, lower=True), size) for k in (2, 3))
            keep = []
            for d in range(batch.num_rows):
                p, q = a[x[d] : x[d + 1]], b[y[d] : y[d + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    u, v = (texts.select(F.col("rep").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v").mapInArrow(confirm, pairs.select("u", "v").schema)


def _across(docs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) of ``docs(rep, component, n)`` in different components that may be similar enough; none is missed.

    With shingles in the order of rarity, two similar sets share one at places ``i`` and ``j`` that leave room for the
    overlap they need: at the first that they share, the overlap is ``min(n - i, m - j)`` at most.
    """

    def cut(batches):
        for batch in _parts(batches, [1]):
            codes, offsets = shingles(words(batch.column(1), seed=61, lower=True), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes.view(np.int64)))], names=["rep", "codes"])

    lists = texts.join(docs.select("rep"), "rep", "left_semi").select("rep", "text").mapInArrow(cut, f"rep {docs.schema['rep'].dataType.simpleString()}, codes array<long>")
    held = written(lists.select("rep", F.explode("codes").alias("code")), "codes")
    often = held.groupBy("code").count()
    place = F.row_number().over(Window.partitionBy("rep").orderBy("count", "code")) - 1
    first = held.join(often, "code").withColumn("i", place).join(docs, "rep").filter(100 * (F.col("n") - F.col("i")) >= percent * F.col("n"))
    first = written(first.filter("count > 1").select("code", "rep", "component", "n", "i"), "first")
    a, b = first.alias("a"), first.select("code", *[F.col(c).alias(f"{c}_") for c in ("rep", "component", "n", "i")]).alias("b")
    room = F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_")) * (100 + percent) >= (F.col("n") + F.col("n_")) * percent
    pairs = a.join(b, "code").filter((F.col("rep") < F.col("rep_")) & (F.col("component") != F.col("component_")) & _alike(F.col("n"), F.col("n_"), percent) & room)
    return pairs.select(F.col("rep").alias("u"), F.col("rep_").alias("v")).distinct()


def _alike(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_duplicates(docs: DataFrame, *, ids: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, keys: int = 13, rows: int = 4) -> DataFrame:
    """(ids, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased). Documents are linked if
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id that links reach, ``kept`` says
    that it is the row's own. Null and empty texts have no set and no link. A null id is no member of a component
    (null, not kept, unless a non-null id has the same set). Rows with the same id and text are one document; an id that
    stands with different texts takes part in the links of each of them, and so joins them. Ids may be of any type that has
    an order. Other columns don't matter, whatever their names. An empty table gives an empty result.
    """
    name, ids, docs = ids, "id", docs.select(F.col(ids).alias("id"), F.col(text).alias("text"))
    text = "text"
    sketch = written(_sketch(docs, ids, text, size, keys, rows), "sketch")
    classes = written(sketch.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min(ids).alias("rep"), F.min_by("told", ids).alias("told"), F.count("*").alias("copies")), "classes")
    own_rows = sketch.filter(F.col(ids).isNotNull() & (F.col("n_shingles") > 0)).select(ids, "s1", "s2")
    doubled = own_rows.groupBy(ids).agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).filter("lo <> hi").select(ids)
    several = bool(doubled.limit(1).count())
    # a class is named by its smallest id; where ids have several classes, by that id and the class, in the same order
    node = F.struct("rep", "s1", "s2") if several else F.col("rep")
    classes = classes.withColumn("node", F.when(F.col("rep").isNotNull(), node))
    lead = classes.filter("rep IS NOT NULL").select(F.col("rep").alias(ids), "told", "s1", "s2", "node")
    reps = sketch.join(lead, [ids, "told", "s1", "s2"]).dropDuplicates(["node"]).select(F.col("node").alias("rep"), ids, "told", F.col("n_shingles").alias("n"), "small")
    reps = written(reps, "reps")
    single = reps.select("rep", F.posexplode("small").alias("pos", "key"))
    shared = single.groupBy("pos", "key").agg(F.count_distinct("rep").alias("m")).filter("m > 1").drop("m")
    held = single.join(shared, ["pos", "key"], "left_semi").groupBy("rep").agg(F.collect_set(F.struct("pos", "key")).alias("held"))
    one, two = F.filter("held", lambda x: x.pos < keys), F.filter("held", lambda x: x.pos >= keys)
    tables = held.select("rep", F.explode(one).alias("x"), two.alias("held")).select("rep", "x", F.explode("held").alias("y")).select("rep", F.col("x.pos").alias("p"), F.col("y.pos").alias("q"), F.col("x.key").alias("x"), F.col("y.key").alias("y"))
    tables = written(tables, "tables")
    bucket = ["p", "q", "x", "y"]
    counted = tables.groupBy(bucket).agg(F.count("*").alias("m")).filter("m > 1")
    mates = written(tables.join(counted, bucket), "mates")
    met = reps.select("rep", ids, "told").join(mates.select("rep").distinct(), "rep", "left_semi")
    texts = docs.select(ids, F.xxhash64(text).alias("told"), "text").join(met, [ids, "told"])
    texts = written(texts.select("rep", "text").dropDuplicates(["rep"]), "texts")

    weight = mates.groupBy("rep").agg(F.sum("m").alias("weight"))
    sized = written(reps.select("rep", "n").join(weight, "rep"), "sized")
    pivot = mates.join(sized.select("rep", "weight"), "rep").groupBy(bucket).agg(F.min(F.struct((-F.col("weight")).alias("weight"), "rep")).alias("top")).select(*bucket, F.col("top.rep").alias("pivot"))
    star = mates.join(pivot, bucket).filter("rep <> pivot").select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v")).distinct()
    n = sized.select("rep", "n")
    for k in "uv":
        star = star.join(n.withColumnsRenamed({"rep": k, "n": f"n_{k}"}), k)
    tried = written(star.filter(_alike(F.col("n_u"), F.col("n_v"), percent)).select("u", "v"), "tried")
    links = written(_confirmed(tried, texts, size, percent), "links")
    part = written(components(links), "part")

    own = mates.join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = own.groupBy(bucket).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(bucket)
    unsettled = written(own.join(open_, bucket, "left_semi").select("rep", "component").distinct().join(n, "rep"), "unsettled")
    rest = written(_across(unsettled, texts, size, percent).join(tried, ["u", "v"], "left_anti"), "rest")
    more = written(_confirmed(rest, texts, size, percent), "links")
    if several:
        more = more.unionByName(_same_id(own_rows.join(doubled, ids, "left_semi"), classes, ids))
    for k in "uv":
        more = more.join(part.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))
    joined = components(more.select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))
    named = classes.join(part.withColumnsRenamed({"component": "c1"}), "node", "left").withColumn("c1", F.coalesce("c1", "node"))
    named = named.join(joined.withColumnsRenamed({"node": "c1", "component": "c2"}), "c1", "left").select("s1", "s2", "copies", F.coalesce("c2", "c1").alias("_found"))
    whole = _with_class(sketch.select(ids, "n_shingles", "s1", "s2"), written(named, "named"))
    component = F.when(F.col("n_shingles") > 0, F.col("_found.rep") if several else F.col("_found")).otherwise(F.col(ids))
    return whole.select(F.col(ids).alias(name), "n_shingles", component.alias("component_id"), F.coalesce(F.col(ids) == component, F.lit(False)).alias("kept"))


def _same_id(rows: DataFrame, classes: DataFrame, ids: str) -> DataFrame:
    """Links (u, v) between the classes of each id: a star around the first."""
    held = written(rows.distinct().join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select(ids, "node"), "same-id")
    first = held.groupBy(ids).agg(F.min("node").alias("u"))
    return held.join(first, ids).filter("u <> node").select("u", F.col("node").alias("v")).distinct()


def _with_class(rows: DataFrame, named: DataFrame, parts: int = 1000) -> DataFrame:
    """``rows`` with the ``_found`` of their class. Classes of more than a share of ``1 / parts`` of all rows, so fewer than
    ``parts``, are broadcast: the copies of one text meet their class where they stand."""
    on, limit = ["s1", "s2"], rows.count() // parts
    large = F.broadcast(named.filter(F.col("copies") > limit).drop("copies"))
    small = named.filter(F.col("copies") <= limit).drop("copies")
    return rows.join(large, on).unionByName(rows.join(large, on, "left_anti").join(small, on, "left"), allowMissingColumns=True)


def keep_one(docs: DataFrame, *, ids: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates, with the same columns and values.

    Rows that repeat an id stay or go with it. Rows with a null id and rows without words stay.
    """
    gone = near_duplicates(docs, ids=ids, text=text, **how)
    return docs.join(gone.filter(~F.col("kept") & F.col(ids).isNotNull()).select(ids).distinct(), ids, "left_anti")
