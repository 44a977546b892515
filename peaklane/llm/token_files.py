"""Token ids as flat binary files.

Documents are dealt by ranges of their id and sorted, so part k holds the documents before those of part k + 1. Each
task writes ``part-k.bin`` (the ids, little-endian unsigned integers of the narrowest width that holds the vocabulary),
``part-k.idx`` (one 64-bit offset more than documents, in ids) and ``part-k.doc`` (64-bit document ids) under another
name and renames them when they are whole; a task that runs again writes the same bytes. Prefix sums over the parts
give the position of each part in the whole; readers map the files into memory.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peaklane.llm.byte_pieces import encoder
from peaklane.llm.scratch import shared_dir, written

#: Bytes of text for a part, and documents read back at once.
PART, TEXTS = 32 << 20, 256


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _mapped(uri: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is local, read otherwise."""
    from pyarrow import fs

    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, ids: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write the token files of ``docs`` to ``folder``; returns (part, n_docs, n_null, n_tokens, width, base).

    Null text counts as empty: it has only the end id. Null ids come first (``n_null`` of a part) and are read back as
    null. Documents with the same id, repeated rows too, follow each other in the order of a hash of their text. An empty
    table gives parts without documents. Other columns are left out. A text of any length is encoded whole, in slices.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART + 1)
    order = [ids, F.xxhash64(text)]
    dealt = docs.select(F.col(ids).cast("long").alias(ids), text).repartitionByRange(int(parts), *order).sortWithinPartitions(*order)

    def write(batches):
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        own = uuid.uuid4().hex
        counts, keys, nulls = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0
        with store.open_output_stream(f"{path}/{own}.bin") as out:
            for batch in batches:
                nulls += batch.column(0).null_count
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                for found, n in code.encode(batch.column(1), end_id):
                    out.write(found.tobytes())
                    counts.append(n)
        offsets = np.cumsum(np.concatenate(counts))
        for name, array in (("idx", offsets.astype("<i8")), ("doc", np.concatenate(keys).astype("<i8"))):
            with store.open_output_stream(f"{path}/{own}.{name}") as out:
                out.write(array.tobytes())
        for name in ("bin", "idx", "doc"):
            store.move(f"{path}/{own}.{name}", f"{path}/part-{part:06d}.{name}")
        row = [pa.array([part], pa.int32()), *[pa.array([x], pa.int64()) for x in (len(offsets) - 1, nulls, int(offsets[-1]))], pa.array([code.width])]
        yield pa.RecordBatch.from_arrays(row, names=["part", "n_docs", "n_null", "n_tokens", "width"])

    told = written(dealt.mapInArrow(write, "part int, n_docs long, n_null long, n_tokens long, width string"), "parts")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    return told.withColumn("base", F.coalesce(before, F.lit(0)))


def read_token_files(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, ``start`` in the numbering of all of them."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{folder}/part-{row['part']:06d}"
                data, offsets, keys = _mapped(f"{at}.bin", row["width"]), _mapped(f"{at}.idx", "<i8"), _mapped(f"{at}.doc", "<i8")
                for a in range(0, len(keys), TEXTS):
                    b = min(a + TEXTS, len(keys))
                    piece = np.asarray(data[offsets[a] : offsets[b]])
                    lists = pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a], pa.int32()), pa.array(piece.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(keys[a:b]), mask=np.arange(a, b) < row["n_null"]), pa.array(offsets[a:b] + row["base"], pa.int64()), pa.array(np.diff(offsets[a : b + 1]), pa.int64()), lists], names=["doc_id", "start", "n_tokens", "ids"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.filter("n_docs > 0").repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<int>")


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by the crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    def digest(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens"
