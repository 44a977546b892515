"""Ranked lexical search by NRA: impact-sorted lists are read in order and never probed.

The index holds blocks of documents. Of each block every term has one list of (impact, document) in falling order of
impact, so a reader needs the front of a list only, and no list of a frequent term is longer than its block.

A search reads the lists of an item's terms down to a common impact, the frontier, which falls step by step. Each
document has a score interval: the lower end sums what was read; the upper end adds, for every term that was not met in
the document, the most that an unread entry can bring. That is below the frontier, and nothing where even a single
occurrence would have been read (an entry's impact grows with occurrences and falls with the document's length, which
the block knows). Reading stops when the best ``k`` have closed intervals and no other document, seen or not, can reach
the last of them; equal ends count as reaching, so ties are resolved too.

Blocks are searched in two waves. The first takes about the root of their number; its ``k``-th scores are the least that
a document of the second wave must reach, so most of its lists are read to a high frontier only and few rows leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from peaklane.llm.scratch import written
from peaklane.llm.words import LOWER, PLAIN_BLANK, _buffers

#: Bytes of text and documents of a block at most (a longer document is a block of its own).
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 15
#: Bytes of items that a task is given at once; more items are searched in several passes.
ITEM_BYTES = 16 << 20
#: The frontier falls to this share of itself in a step.
FALL = 0.8
#: Impacts are below this.
TOP = 1_000_000
#: Maps A-Z to a-z and every byte that parts terms to a blank.
_TERMS = LOWER.copy()
_TERMS[PLAIN_BLANK[LOWER]] = 0x20


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Ranges of documents of about ``BLOCK_BYTES``."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
        b = min(b, a + BLOCK_DOCS, n)
        yield a, b
        a = b


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some documents one after the other, and how many each has."""
    blank = np.frombuffer(_TERMS[data[offsets[0] : offsets[-1]]].tobytes() or b" ", np.uint8)
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer((offsets - offsets[0]).astype(np.int64)), pa.py_buffer(blank))
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    found = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy()
    full = np.array([t != "" for t in found], bool)[codes] if len(found) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return pa.DictionaryArray.from_arrays(codes[full], flat.dictionary), np.bincount(doc[full], minlength=len(texts))


def count_terms(docs: DataFrame, text: str) -> tuple[int, int]:
    """(N, L): documents with a term, and all terms with repeats."""

    def count(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            held = total = 0
            for a, b in _slices(data, offsets):
                word = ~PLAIN_BLANK[LOWER[data[offsets[a] : offsets[b]]]]
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                edge = (offsets[a:b] - offsets[a])[np.diff(offsets[a : b + 1]) > 0]
                begins[edge] = word[edge]
                each = np.add.reduceat(begins, edge, dtype=np.int64) if len(edge) else np.zeros(0, np.int64)
                held, total = held + int((each > 0).sum()), total + int(each.sum())
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total], pa.int64())], names=["n", "l"])

    row = docs.select(text).mapInArrow(count, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    return row["n"], row["l"]


def length_norm(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """``100 - 25 + (25 * length * n) div total``, exactly."""
    kinds, back = np.unique(lengths, return_inverse=True)
    return np.array([75 + 25 * int(x) * n // max(total, 1) for x in kinds], np.int64)[back]


def build_index(docs: DataFrame, *, ids: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The index and N: rows (block, term, n, impacts, places) of all terms of all documents, and for each block a row with the
    term null that has the documents' ids (``ids``) in ascending order and their length norms (``impacts``); places count
    the documents of the block in that order. Repeated rows are documents of their own; null texts have no terms."""
    docs = docs.select(F.col(ids).alias("id"), F.col(text).alias("text"))
    n, total = count_terms(docs, "text")
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("impacts", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType))])

    def invert(batches):
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            order = pc.sort_indices(batch.column(0), null_placement="at_end")  # by id, so that places of equal scores are in order
            keys, (data, offsets) = batch.column(0).take(order), _buffers(batch.column(1).take(order))
            for a, b in _slices(data, offsets):
                yield from _lists(block, keys.slice(a, b - a), data, offsets[a : b + 1])
                block += 1

    def _lists(block: int, keys, data: np.ndarray, offsets: np.ndarray):
        terms, lengths = _terms(data, offsets)
        size, wide = len(lengths), len(terms.dictionary)
        norm = length_norm(lengths, n, total)
        doc = np.repeat(np.arange(size), lengths)
        pair, tf = np.unique(doc * wide + terms.indices.to_numpy(), return_counts=True)
        doc, term = pair // max(wide, 1), pair % max(wide, 1)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm[doc])
        order = np.lexsort((doc, -impact, term))
        term, impact, doc = term[order], impact[order], doc[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(first, len(term)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (impact, doc)]
        held, of = len(first), pa.list_(pa.int32())
        one = pa.array([0, size], pa.int32())
        own = pa.ListArray.from_arrays(one, keys)
        shape = pa.schema(list(zip(kind.names, [pa.int64(), pa.string(), pa.int64(), of, of, own.type], strict=True)))
        terms_ = terms.dictionary.take(pa.array(term[first])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([block] * held, pa.int64()), terms_, pa.array(np.diff(np.append(first, len(term))), pa.int64()), *[x.cast(of) for x in lists], pa.nulls(held, own.type)], schema=shape)
        norms = pa.ListArray.from_arrays(one, pa.array(np.minimum(norm, 2**31 - 1), pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.array([size], pa.int64()), norms.cast(of), pa.nulls(1, of), own], schema=shape)

    return written(docs.mapInArrow(invert, kind), "index"), n


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, times): the terms of all distinct texts of an item."""
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    cut = items.select(F.struct(F.col(item).alias("id")).alias("item"), F.col(text).alias("text")).distinct()
    return cut.select("item", F.explode(terms.alias("t")).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def read_block(lists: dict[str, tuple[np.ndarray, np.ndarray]], norms: np.ndarray, terms: list[tuple[str, int]], k: int, floor: int, counter: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places and exact scores of a block's documents of score above 0 that may be among the best ``k``, those that reach
    ``floor``. ``lists``: impacts (falling) and places of each term; ``terms``: with their weights. ``counter`` gets the
    entries that were read and those there are."""
    held = [(*lists[t], w) for t, w in terms if t in lists and w > 0]
    size = len(norms)
    lower, met = np.zeros(size, np.int64), np.zeros(size, np.int64)
    least = 1_000_000_000 // (1000 + 12 * norms)  # what one occurrence brings
    whole, at = sum(w for *_, w in held), [0] * len(held)
    frontier = max((int(i[0]) for i, _, _ in held), default=0) + 1
    while True:
        frontier = min(int(frontier * FALL), frontier - 1)  # every entry of at least that impact is read now
        for j, (impacts, places, w) in enumerate(held):
            if at[j] < len(impacts) and impacts[at[j]] >= frontier:
                to = len(impacts) - int(np.searchsorted(impacts[::-1], frontier, "left")) if frontier > 0 else len(impacts)
                here = places[at[j] : to]
                lower[here] += w * impacts[at[j] : to]  # a document stands once in a list
                met[here] += w
                at[j] = to
        done = all(a == len(i) for a, (i, _, _) in zip(at, held, strict=True))
        closed = least >= frontier
        rest = np.where(closed, 0, (whole - met) * (frontier - 1)) if not done else np.zeros(size, np.int64)
        kth = max(floor, 1, int(np.partition(lower, size - k)[size - k]) if size > k else 0)
        # whatever can still reach the k-th score has a final score
        if done or not ((lower + rest >= kth) & (rest > 0)).any():
            break
    if counter is not None:
        counter["read"] = counter.get("read", 0) + sum(at)
        counter["there"] = counter.get("there", 0) + sum(len(i) for i, _, _ in held)
    found = np.flatnonzero(lower >= kth)
    best = found[np.lexsort((found, -lower[found]))][:k]
    return best, lower[best]


def _search(index: DataFrame, weights: DataFrame, k: int, floors: DataFrame | None, wave) -> DataFrame:
    """(item, id, score): of each block of a wave the best of each item that reach its floor."""
    rows = weights.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    rows = rows.withColumn("floor", F.lit(0).cast("long")) if floors is None else rows.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    queries = [([(t["term"], t["w"]) for t in r["terms"]], r["floor"], r["item"]) for r in rows.collect()]  # of ITEM_BYTES at most
    shared = index.sparkSession.sparkContext.broadcast([(t, f) for t, f, _ in queries])
    id_type = index.schema["ids"].dataType.elementType
    kind = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        terms, impacts, places = table.column("term"), table.column("impacts"), table.column("places")
        lists, norms, keys = {}, np.zeros(0, np.int64), None
        for r, term in enumerate(terms.to_pylist()):
            values = impacts[r].values.to_numpy().astype(np.int64)
            if term is None:
                norms, keys = values, table.column("ids")[r].values
            else:
                lists[term] = values, places[r].values.to_numpy()
        out = [(q, *read_block(lists, norms, t, k, floor)) for q, (t, floor) in enumerate(shared.value)] if keys is not None and len(lists) else []
        out = [(q, at, s) for q, at, s in out if len(at)]
        joined = lambda parts, of: np.concatenate(parts) if parts else np.zeros(0, of)
        own = pa.array(joined([at for _, at, _ in out], np.int64), pa.int64())
        found = keys.take(own) if keys is not None else pa.nulls(0, table.schema.field("ids").type.value_type)
        q = joined([np.full(len(at), q) for q, at, _ in out], np.int64)
        return pa.Table.from_arrays([pa.array(q, pa.int64()), found, pa.array(joined([s for *_, s in out], np.int64), pa.int64())], names=kind.names)

    vocabulary = weights.select("term").distinct()
    mine = index.filter(wave(F.col("block")))
    lists = mine.join(vocabulary, "term", "left_semi").unionByName(mine.filter("term IS NULL"))
    found = lists.select("block", "term", "impacts", "places", "ids").groupBy("block").applyInArrow(search, kind)
    # the positions of the items stand for them in the tasks
    names = index.sparkSession.createDataFrame([(q, item) for q, (*_, item) in enumerate(queries)], T.StructType([T.StructField("q", T.LongType()), T.StructField("item", weights.schema["item"].dataType)]))
    return found.join(F.broadcast(names), "q").select("item", "id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, *, ids: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 20, item_bytes: int = ITEM_BYTES, index: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(item, rank, ids, score): of each item its ``k`` documents of the highest score above 0, equal scores by ascending id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term's weight is ``floor(1000 * ln((2N +
    2) / (2df + 1)))``, its impact in a document ``1e9 * tf div (1000 * tf + 12 * m)`` with ``m = 75 + 25 * n * N div L``; a
    score sums weight times impact over the item's terms, repeats included.

    Null and empty texts have no terms: such documents are in no ranking, such items have none. Rows that repeat an id are
    documents of their own (a null id ranks last among equals). The distinct texts of a repeated item id make one item, a
    null item id too. A text of any length is indexed whole. Empty tables give no rows. Other columns are left out, whatever
    their names. ``index``: of ``build_index``, to search it again. Items of more than ``item_bytes`` are searched in passes.
    """
    held, n = index or build_index(docs, ids=ids, text=text)
    wanted = written(item_terms(items, item, item_text), "items")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0)).alias("n")).first()["n"]
    df = held.filter("term IS NOT NULL").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    ratio = F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1)
    weights = wanted.join(df, "term").select("item", "term", (F.floor(1000 * F.log(ratio)) * F.col("times")).alias("w"))
    weights = written(weights, "weights")
    blocks = held.filter("term IS NULL").count()
    every = max(1, math.isqrt(max(blocks, 1)))
    first_wave = lambda b: F.pmod(F.xxhash64(b), F.lit(every)) == 0
    out, passes = None, max(1, -(-size // item_bytes))
    for p in range(passes):
        mine = weights if passes == 1 else weights.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        one = written(_best(_search(held, mine, k, None, first_wave), k), "first-wave")
        floors = one.filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))
        two = _search(held, mine, k, floors, lambda b: ~first_wave(b))
        both = written(_best(one.drop("rank").unionByName(two), k), "found")
        out = both if out is None else out.unionByName(both)
    return out.select(F.col("item.id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(ids), "score")
