"""Substring deduplication with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words, which are indexed by hash. Every
rolling window of ``block`` words probes that index. A repeat of ``min_words >= 2 * block - 1`` words holds a whole
reference block of its earlier copy, wherever it starts, so each repeat has a hit; around the hits the repeat is
extended word by word, by comparing all ``min_words`` windows that touch a hit, and neighbouring windows merge into
maximal spans. Hits may be false (their hashes are short); windows are compared by 128 bits made of two independent hashes of
each word, so that the chance of one false match among 1e13 windows (some 100 TB) is below 1e-12.

Documents are dealt into small batches by a hash of their id and text. A batch sends each distinct hash once to the bucket of
that hash and gets back one bit for it, so a passage that a third of all documents holds costs one entry for each
batch, never a pair of documents. The exchange that deals out the batches is used three times by the one plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peaklane.llm.names import own_names
from peaklane.llm.words import _draw, mixed, words

#: Bytes of text in a batch and bytes of text whose hashes share a bucket: the least and the most. In between both grow with
#: the root of the input, so the messages between them grow in proportion to it.
BATCH, BUCKET = (3 << 19, 8 << 20), (16 << 20, 64 << 20)
#: Bytes of text in a task, and the most tasks of a stage (tasks work through their batches one by one).
TASK, TASKS = 5 << 19, 100_000
_LAST = np.iinfo(np.int64).max
_BITS = pa.schema([("_bucket", pa.int64()), ("_batch", pa.int64()), ("_kind", pa.int32()), ("_bits", pa.binary())])
_BITS_DDL = "_bucket long, _batch long, _kind int, _bits binary"
_SENT = pa.schema([("_bucket", pa.int64()), ("_batch", pa.int64()), ("_kind", pa.int32()), ("_hash", pa.binary()), ("_doc", pa.binary())])
_SENT_DDL = "_bucket long, _batch long, _kind int, _hash binary, _doc binary"


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class _Batch:
    """The windows of one batch of documents; the same rows give the same arrays, in whatever order they come."""

    def __init__(self, table: pa.Table, ids: str, text: str, block: int, size: int, buckets: int):
        id_column = table[ids].combine_chunks()
        key = id_column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.order = np.lexsort((table["_text"].to_numpy(), key))  # rows with the same id and text are alike
        self.table = table.take(pa.array(self.order))
        self.key, self.block, self.size, self.buckets = key[self.order], block, size, buckets
        self.words = words(self.table[text], seed=31)

    def blocks(self):
        """Distinct block hashes with the flag of a reference block, those that repeat here, and the bucket of each."""
        w = self.words
        at, code = w.windows(self.block, 41)
        doc = w.doc[at]
        aligned = (at - w.first[doc]) % self.block == 0
        code = code & ~np.uint64(1)
        distinct, self.which = np.unique(code, return_inverse=True)
        self.block_at = at
        n = len(distinct)
        held = np.zeros(n, bool)
        held[self.which[aligned]] = True
        low, high = np.full(n, _LAST), np.full(n, -1)
        np.minimum.at(low, self.which, doc)
        np.maximum.at(high, self.which, doc)
        return distinct | held.astype(np.uint64), held & (low < high), self._bucket(distinct)

    def _bucket(self, code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(40)) % np.uint64(self.buckets)

    def candidates(self, active: np.ndarray) -> np.ndarray:
        """Starts of the windows of ``size`` words that hold an active block."""
        w = self.words
        hits = np.zeros(len(w.code) + 1, np.int64)
        hits[1:][self.block_at] = active[self.which]
        total = np.cumsum(hits)
        at, code = w.windows(self.size, 53)
        near = total[at + self.size - self.block + 1] > total[at]
        return np.flatnonzero(near), at, code

    def long(self, near: np.ndarray, at: np.ndarray, code: np.ndarray):
        """The distinct candidate windows in the order (first document, hash): both hashes, first document, bucket, place of each candidate."""
        doc = self.words.doc[at[near]]
        one, two = code[near], self._second(at[near])
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)]
        which = np.empty(len(one), np.int64)
        which[order] = np.cumsum(new) - 1
        one, two = one[new], two[new]
        low = np.full(len(one), _LAST)
        np.minimum.at(low, which, doc)
        order = np.lexsort((two, one, low))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = self.key[low[order]] if len(order) else np.zeros(0, np.int64)
        return np.stack([one[order], two[order]], 1), first, self._bucket(one[order]), place[which], doc

    def _second(self, at: np.ndarray) -> np.ndarray:
        """A second hash of the windows at these places."""
        inside = np.zeros(len(self.words.code) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.size, -1)
        code = self.words.recoded(np.cumsum(inside)[:-1] > 0, 83)
        total = np.zeros(len(at), np.uint64)
        for k, c in enumerate(_draw(89, self.size)):
            total += code[at + k] * c
        return mixed(total)


def _by_bucket(bucket: np.ndarray):
    """Each bucket with the places of its entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(bucket[part[0]]), part


def _answers(table: pa.Table, kind: int):
    for row in table.select(["_bucket", "_kind", "_bits"]).to_pylist():
        if row["_kind"] == kind:
            yield row["_bucket"], row["_bits"]


def _set(target: np.ndarray, bucket: np.ndarray, answers) -> np.ndarray:
    places = dict(_by_bucket(bucket))
    for k, bits in answers:
        target[places[k]] |= _unpacked(bits, len(places[k]))
    return target


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blobs(table: pa.Table, name: str, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all rows, and the number of entries of each row."""
    raw = table[name].to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) // width for x in raw], np.int64)


def _match_blocks(table: pa.Table) -> pa.Table:
    """Of one bucket: which hashes stand in two batches or more and are a reference block in one of them."""
    raw, sizes = _blobs(table, "_hash", "u1", 5)
    code = np.zeros((len(raw) // 5, 8), np.uint8)
    code[:, :5] = raw.reshape(-1, 5)
    code = code.view("<u8").ravel()
    order = np.argsort(code, kind="stable")
    value = code[order] >> np.uint64(1)
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
    group = np.cumsum(new) - 1
    held = np.zeros(int(new.sum()), bool)
    held[group[(code[order] & np.uint64(1)).astype(bool)]] = True
    found = np.empty(len(code), bool)
    found[order] = ((np.bincount(group, minlength=len(held)) > 1) & held)[group]
    return _replies(table, found, sizes, 0)


def _match_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: which windows start in a document before those of the batch that sent them."""
    if table["_kind"][0].as_py():  # a batch's note to itself
        return table.select(["_bucket", "_batch", "_kind"]).append_column("_bits", table["_hash"])
    raw, sizes = _blobs(table, "_hash", "<u8", 16)
    one, two = raw.reshape(-1, 2).T
    doc, _ = _blobs(table, "_doc", "<i8", 8)
    order = np.lexsort((doc, two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])[: len(one)]
    first = doc[order][new][np.cumsum(new) - 1]
    found = np.empty(len(one), bool)
    found[order] = doc[order] > first
    return _replies(table, found, sizes, 0)


def _replies(table: pa.Table, found: np.ndarray, sizes: np.ndarray, kind: int) -> pa.Table:
    rows, at = [], 0
    for bucket, batch, n in zip(table["_bucket"].to_pylist(), table["_batch"].to_pylist(), sizes, strict=True):
        if (bits := found[at : at + n]).any():
            rows.append((bucket, batch, kind, _packed(bits)))
        at += n
    return _table(rows, _BITS)


@own_names("ids", "text")
def substring_dedup(docs: DataFrame, *, ids: str = "doc_id", text: str = "text", min_words: int = 13, block: int = 7) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed_spans`` (word ranges, end excluded) and ``kept_text``.

    A word is removed if a window of ``min_words`` words covers it whose words also start in a document with a
    smaller id. Windows are judged on the input.

    Ids must be integers. Null text: no words. A null id stands after all others: it loses repeats and takes none from
    others. Rows with equal ids don't count as earlier for each other, so repeated rows stay whole unless a smaller id
    holds them. Fewer than ``min_words`` words, empty text: nothing is removed. An empty table gives an empty result. Other
    columns pass through; columns named like a new one are replaced.

    A batch is handled in one piece: a document longer than a batch, or the copies of one row (same id and same text), must
    fit the memory of a Python worker.
    """
    if min_words < 2 * block - 1:
        raise ValueError("a repeat of min_words must hold a whole block: min_words >= 2 * block - 1")
    if not isinstance(docs.schema[ids].dataType, T.IntegralType):
        raise ValueError(f"{ids}: the order of documents goes by integer ids")
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "removed_spans", "kept_text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    batch, bucket = (min(most, max(least, int(share * total**0.5))) for (least, most), share in ((BATCH, 48), (BUCKET, 512)))
    batches, buckets = total // batch + 1, max(64, total // bucket)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(total // TASK), TASKS))
    dealt = docs.withColumn("_text", F.xxhash64(text)).withColumn("_batch", F.pmod(F.xxhash64(ids, "_text"), F.lit(batches))).repartition(tasks, "_batch")
    make = lambda table: _Batch(table, ids, text, block, min_words, int(buckets))

    def send_blocks(table: pa.Table) -> pa.Table:
        code, _, bucket = make(table).blocks()
        raw, batch = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], table["_batch"][0].as_py()
        return _table([(k, batch, 0, raw[part].tobytes(), b"") for k, part in _by_bucket(bucket)], _SENT)

    def send_windows(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _table([], _SENT)
        batch = make(table)
        _, here, bucket = batch.blocks()
        near, at, code = batch.candidates(_set(here, bucket, _answers(replies, 0)))
        if not len(near):
            return _table([], _SENT)
        distinct, first, bucket, _, _ = batch.long(near, at, code)
        b = key[0].as_py()
        mask = np.zeros(len(at), bool)
        mask[near] = True
        rows = [(k, b, 0, distinct[part].astype("<u8").tobytes(), first[part].astype("<i8").tobytes()) for k, part in _by_bucket(bucket)]
        return _table([*rows, (int(buckets) + b, b, 1, _packed(mask), b"")], _SENT)

    kept_fields = [f for f in docs.schema.fields]
    out_type = T.StructType([*kept_fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("kept_text", T.StringType())])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = make(table)
        w = batch.words
        gone = np.zeros(len(w.code) + 1, np.int64)
        at, code = w.windows(min_words, 53)
        for _, bits in _answers(replies, 1):
            near = np.flatnonzero(_unpacked(bits, len(at)))
            _, first, bucket, place, doc = batch.long(near, at, code)
            elsewhere = _set(np.zeros(len(first), bool), bucket, _answers(replies, 0))
            hit = at[near][elsewhere[place] | (batch.key[doc] > first[place])]
            gone[hit] += 1
            gone[hit + min_words] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        inner = np.zeros(len(w.code), bool)
        inner[w.first[:-1][w.first[:-1] < len(inner)]] = True
        start = np.flatnonzero(gone & (inner | ~np.concatenate([[False], gone[:-1]])))
        last = np.concatenate([inner[1:], [True]])
        end = np.flatnonzero(gone & (last | ~np.concatenate([gone[1:], [False]]))) + 1
        doc = w.doc[start]
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(w.first))), pa.int32()), pa.StructArray.from_arrays([pa.array(start - w.first[doc], pa.int32()), pa.array(end - w.first[doc], pa.int32())], ["start", "end"]))
        new = {"n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(np.diff(total[w.first]), pa.int64()), "removed_spans": spans.cast(span_type), "kept_text": pa.array(w.joined(~gone), pa.binary()).cast(pa.string())}
        out = batch.table.drop_columns(["_batch", "_text"])
        return pa.table([*[out[f.name] for f in kept_fields], *new.values()], names=[*[f.name for f in kept_fields], *new])

    blocks = dealt.groupBy("_batch").applyInArrow(send_blocks, _SENT_DDL)
    hits = blocks.repartition(tasks, "_bucket").groupBy("_bucket").applyInArrow(_match_blocks, _BITS_DDL)
    windows = dealt.groupBy("_batch").cogroup(hits.groupBy("_batch")).applyInArrow(send_windows, _SENT_DDL)
    repeats = windows.repartition(tasks, "_bucket").groupBy("_bucket").applyInArrow(_match_windows, _BITS_DDL)
    return dealt.groupBy("_batch").cogroup(repeats.groupBy("_batch")).applyInArrow(remove, out_type)
