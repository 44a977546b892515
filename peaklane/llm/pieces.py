"""SentencePiece encoding and decoding by a max-plus scan, for unigram and for BPE models.

A text's encoding is the path of greatest score through the lattice of vocabulary pieces. In max-plus algebra a chunk of text
is a matrix: entry ``[s, e]`` is the best score of entering in state ``s`` and leaving in state ``e``. Matrices combine
associatively: chunks of a giant document are evaluated in any task, runs of chunks are multiplied in any task, prefix
products over the runs give the best state at each run's end and then at each chunk's, and every chunk is traced back on its
own. No piece holds a word mark after another character, so words within a chunk are independent and recurring words are
solved once.

For a unigram model a state is the number of characters that a piece of the chunk before has taken.

A BPE model joins, again and again, the neighbours whose joint piece has the greatest score, the leftmost of equal ones. Its
scores can't be added up, but its encoding is the one path on which every piece, and every two neighbours, encode to
themselves: until a first join crosses a border of that path, the joins inside two neighbours are those of the two alone,
and their next best join is not across; the other way round, joins that don't cross a piece's ends don't depend on what is
outside. So pairs of pieces weigh 0 or minus infinity, and a state is the last piece with its place.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peaklane.llm.names import own_names
from peaklane.llm.scratch import written

#: Characters of a chunk, texts encoded between two batches, remembered words and their greatest length, remembered pairs of
#: pieces, and chunks of a run.
CHUNK, TEXTS, WORDS, WORD, PAIRS, RUN = 1 << 16, 128, 150_000, 64, 300_000, 64
_MARK = "▁"
_LEAST = -np.inf


class _Solved(dict):
    """Ids by word; a word that isn't there is solved."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > WORDS:  # words met lately are kept for as long again
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.model.traced(word, self.model.path(word), 0, len(word))).tobytes()
        if len(word) <= WORD:
            self[word] = ids
        return ids


class _Beside(dict):
    """Whether a BPE model leaves two pieces side by side as they are (after no piece: whether it makes the second one)."""

    def __init__(self, model: Merges):
        super().__init__()
        self.model = model

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) > PAIRS:
            self.clear()
        left, right = pair
        found = self[pair] = self.model.merged(left + right) == ([len(left)] if left else []) + [len(left) + len(right)]
        return found


class Model:
    """The pieces of a SentencePiece model file and their scores, read as a unigram lattice; characters without a piece
    are spelled in bytes."""

    #: The type of a transfer matrix's entries.
    kind = "<f8"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        told = SentencePieceProcessor(model_file=path)
        size = told.vocab_size()
        plain = [i for i in range(size) if not (told.is_control(i) or told.is_unknown(i) or told.is_byte(i) or told.is_unused(i))]
        self.id = {told.id_to_piece(i): i for i in plain}
        self.score = {told.id_to_piece(i): told.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        self.unknown = min(self.score.values()) - 10
        self.byte = {int(told.id_to_piece(i)[1:-1], 16): i for i in range(size) if told.is_byte(i)}
        spelled = {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [spelled.get(i, told.id_to_piece(i).encode() if not told.is_control(i) else b"") for i in range(size)]
        self.root: dict = {}
        for piece, score in self.score.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        # a word ends before a mark, around controls that no longer piece holds, and between a letter and a sign of
        # punctuation that follows a letter in no piece: no path can cross there
        alone = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.id))
        signs = "".join(c for c in ".,;:!?" if not any(x.isalpha() and y == c for p in self.id for x, y in zip(p, p[1:], strict=False)))
        more = f"[^{_MARK}{alone}{signs}]*"
        tail = f"(?:(?<![^\\W\\d_])[{signs}]{more})*" if signs else ""
        self.cut = re.compile((f"[{alone}]|" if alone else "") + f"(?:{_MARK}+|[^{_MARK}{alone}]){more}{tail}").findall
        self.words = _Solved(self)

    def best(self, text: str, start: int, stop: int) -> tuple[list[float], list[int]]:
        """The best score of each place from ``start`` to ``stop`` and the place before it; of equal ones the earliest."""
        score, back = [_LEAST] * (len(text) + 1), [-1] * (len(text) + 1)
        score[start] = 0.0
        root, longest = self.root, self.longest
        for a in range(start, stop):
            base, node, end = score[a], root, a
            for c in text[a : min(a + longest, stop)]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                s = node.get("")
                if s is not None and base + s > score[end]:
                    score[end], back[end] = base + s, a
            if text[a] not in self.id and base + self.unknown > score[a + 1]:
                score[a + 1], back[a + 1] = base + self.unknown, a
        return score, back

    def path(self, word: str) -> list[int]:
        """The place before each place of a word's best path."""
        return self.best(word, 0, len(word))[1]

    def traced(self, text: str, back: list[int], start: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            out.append(self.spelled(text[back[end] : end]))
            end = back[end]
        return [i for ids in reversed(out) for i in ids]

    def spelled(self, piece: str) -> list[int]:
        own = self.id.get(piece)
        return [own] if own is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(marked(text))))

    def _cuts(self, chunk: str, n: int) -> tuple[int, int] | None:
        """The first place, past any overhang, and the last place within the chunk at which a word begins."""
        begins = [m.start() for m in re.finditer(f"(?<!{_MARK}){_MARK}", chunk) if self.longest - 1 <= m.start() <= n]
        return (begins[0], begins[-1]) if begins else None

    def matrix(self, text: str, at: int, n: int) -> np.ndarray:
        """The transfer matrix of the ``n`` characters from ``at``; around them stand the ends of the chunks next to it."""
        chunk, size = text[at:], self.longest
        out = np.full((size, size), _LEAST)
        reach = min(len(chunk), n + size - 1)
        if cuts := self._cuts(chunk, n):
            first, last = cuts
            head = [self.best(chunk[:first], s, first)[0][first] for s in range(size)]
            middle = sum(self.best(w, 0, len(w))[0][-1] for w in self.cut(chunk[first:last]))
            tail = self._ends(chunk[last:], 0, n - last, reach - last)
            return np.add.outer(np.array(head) + middle, tail)
        for s in range(min(size, n + 1)):
            out[s] = self._ends(chunk, s, n, reach)
        return out

    def _ends(self, text: str, start: int, n: int, reach: int) -> np.ndarray:
        """For each overhang, the best score of a path from ``start`` whose last piece begins before ``n``."""
        out = np.full(self.longest, _LEAST)
        if start >= n:
            out[start - n] = 0.0
            return out
        score, _ = self.best(text, start, n)
        out[0] = score[n]
        for end in range(n + 1, reach + 1):
            known = [score[a] + self.score[text[a:end]] for a in range(max(start, end - self.longest), n) if text[a:end] in self.score]
            out[end - n] = max(known, default=_LEAST)
        return out

    def trace(self, text: str, at: int, n: int, enter: int, leave: int) -> bytes:
        """The ids of the pieces that begin in the ``n`` characters from ``at`` on the best path between two states."""
        chunk = text[at:]
        if enter >= n:
            return b""
        cuts = self._cuts(chunk, n)
        first, last = cuts if cuts else (enter, enter)
        parts = []
        if cuts:
            _, back = self.best(chunk[:first], enter, first)
            parts = [np.array(self.traced(chunk[:first], back, enter, first), np.int32).tobytes(), *map(self.words.__getitem__, self.cut(chunk[first:last]))]
        score, back = self.best(chunk, last, n)
        end = n + leave
        if leave:
            known = [(score[a] + self.score[chunk[a:end]], -a) for a in range(max(last, end - self.longest), n) if chunk[a:end] in self.score]
            top = -max(known)[1]
            parts.append(np.array([*self.traced(chunk, back, last, top), self.id[chunk[top:end]]], np.int32).tobytes())
        else:
            parts.append(np.array(self.traced(chunk, back, last, n), np.int32).tobytes())
        return b"".join(parts)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(_MARK, " ")
        return text[1:] if text[:1] == " " else text


class Merges(Model):
    """A BPE model, read as a lattice in which pairs of neighbours weigh 0 or minus infinity."""

    kind = "<f2"

    def __init__(self, path: str):
        super().__init__(path)
        self.price = {piece: -score for piece, score in self.score.items()}
        self.beside = _Beside(self)

    def merged(self, word: str) -> list[int]:
        """Where the pieces of a piece or of two end, by the merges themselves."""
        n, price = len(word), self.price
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins here; ends are 0 once it is merged away
        heap = [(c, a, a + 1, a + 2) for a in range(n - 1) if (c := price.get(word[a : a + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, m, e = heapq.heappop(heap)
            if end[a] != m or end[m] != e:
                continue
            end[a], end[m] = e, 0
            if e < n:
                before[e] = a
                if (c := price.get(word[a : end[e]])) is not None:
                    heapq.heappush(heap, (c, a, e, end[e]))
            if (b := before[a]) >= 0 and (c := price.get(word[b:e])) is not None:
                heapq.heappush(heap, (c, b, a, e))
        return [e for e in end if e]

    def best(self, text: str, start: int, stop: int, last: str = "") -> tuple[list[float], list[int]]:
        """No scores, and for each place that a path from ``start``, after the piece ``last``, reaches, the place before it
        (else -1). There is one at most, as the text up to there has one encoding."""
        back = [-1] * (len(text) + 1)
        root, longest, beside, known = self.root, self.longest, self.beside, self.id
        for a in range(start, stop):
            if a > start:
                if back[a] < 0:
                    continue
                last = text[back[a] : a]
            node, end = root, a
            for c in text[a : min(a + longest, stop)]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                if "" in node and back[end] < 0 and beside[last, text[a:end]]:
                    back[end] = a
            if text[a] not in known and back[a + 1] < 0 and beside[last, text[a]]:
                back[a + 1] = a
        return [], back

    def path(self, word: str) -> list[int]:
        """As ``best``, by the longest pieces first and no farther than the path takes."""
        n, root, longest, beside, known = len(word), self.root, self.longest, self.beside, self.id
        back, steps, a, last = [-1] * (n + 1), [], 0, ""
        while a < n:
            node, end = root, a
            if word[a] not in known:
                steps.append((a, a + 1, last))
            for c in word[a : a + longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                if "" in node:
                    steps.append((a, end, last))
            while True:
                a, end, last = steps.pop()
                if back[end] < 0 and beside[last, word[a:end]]:
                    break
            back[end], last, a = a, word[a:end], end
        return back

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Where the pieces begin and end that a path may hold last when it reaches ``at``; nothing before the text."""
        if at == 0:
            return [(0, 0)]
        ends = range(at, min(at + self.longest, len(text) + 1))
        return [(a, e) for e in ends for a in range(max(e - self.longest, 0), at) if (e - a == 1 or text[a:e] in self.id) and self.beside["", text[a:e]]]

    def matrix(self, text: str, at: int, n: int) -> np.ndarray:
        stop = at + n
        enter, leave = self.states(text, at), self.states(text, stop)
        if cuts := self._cuts(text[at:], n - 1):
            first, last = at + cuts[0], at + cuts[1]
            head = [e == first or self.best(text[:first], e, first, text[a:e])[1][first] >= 0 for a, e in enter]
            reached = np.logical_and.outer(head, self._left(text, last, "", stop, leave))
        else:
            reached = np.array([self._left(text, e, text[a:e], stop, leave) if e < stop else [x == (a, e) for x in leave] for a, e in enter])
        if stop == len(text):
            reached = reached.any(1, keepdims=True)
        return np.where(reached, 0.0, _LEAST)

    def _left(self, text: str, start: int, last: str, stop: int, leave: list[tuple[int, int]]) -> list[bool]:
        """For each state at ``stop``, whether a path from ``start`` after the piece ``last`` reaches it."""
        _, back = self.best(text, start, stop, last)
        return [a == start and self.beside[last, text[a:e]] or a > start and back[a] >= 0 and self.beside[text[back[a] : a], text[a:e]] for a, e in leave]

    def trace(self, text: str, at: int, n: int, enter: int, leave: int) -> bytes:
        stop = at + n
        a, start = self.states(text, at)[enter]
        if start >= stop:
            return b""
        last, parts = text[a:start], []
        if cuts := self._cuts(text[at:], n - 1):
            first, begin = at + cuts[0], at + cuts[1]
            _, back = self.best(text[:first], start, first, last)
            parts = [array("i", self.traced(text, back, start, first)).tobytes(), *map(self.words.__getitem__, self.cut(text[first:begin]))]
            start, last = begin, ""
        _, back = self.best(text, start, stop, last)
        if stop == len(text):
            ids = self.traced(text, back, start, stop)
        else:
            a, e = self.states(text, stop)[leave]
            ids = self.traced(text, back, start, a) + self.spelled(text[a:e])
        return b"".join([*parts, array("i", ids).tobytes()])


@functools.cache
def model(path: str) -> Model:
    """The model of a file. What this module doesn't do as the library does is refused."""
    from sentencepiece import sentencepiece_model_pb2 as told

    proto = told.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind, norm = proto.trainer_spec, proto.normalizer_spec
    if any(_MARK in p.piece.lstrip(_MARK) for p in proto.pieces):
        raise ValueError(f"{path}: only models without pieces over several words are supported")
    if kind.model_type == told.TrainerSpec.UNIGRAM:
        return Model(path)
    odd = {p.type for p in proto.pieces} & {told.ModelProto.SentencePiece.USER_DEFINED, told.ModelProto.SentencePiece.UNUSED}
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if kind.model_type != told.TrainerSpec.BPE or not plain or not kind.byte_fallback or kind.treat_whitespace_as_suffix or odd:
        raise ValueError(f"{path}: only BPE models with byte fallback, plain normalization and plain pieces are supported")
    return Merges(path)


def marked(text: str) -> str:
    """The text as the lattice sees it: blanks are marks, and a mark stands before it."""
    return (_MARK + text).replace(" ", _MARK) if text else ""


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices (of stacks of them), by one middle state after the other."""
    return functools.reduce(np.maximum, (a[..., :, m, None] + b[..., None, m, :] for m in range(a.shape[-1])))


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """The product of each matrix with all before it, in a logarithmic number of rounds."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combined(out[:-step], out[step:])
        step *= 2
    return out


def boundary_states(matrices: np.ndarray, enter: int = 0, leave: int = 0) -> list[int]:
    """The state on the best path before each chunk and after the last, between two states; of equal ones the first."""
    before, states = prefix_products(matrices), [leave]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(before[k - 1][enter] + matrices[k][:, states[-1]])))
    return [enter, *states[::-1]]


def _stacked(table: pa.Table, kind: str) -> np.ndarray:
    """The matrices of a table's rows, filled up to one square size."""
    found = [np.frombuffer(m, kind).reshape(rows, -1) for m, rows in zip(table["matrix"].to_pylist(), table["rows"].to_pylist(), strict=True)]
    out = np.full((len(found), *[max(max(m.shape) for m in found)] * 2), _LEAST, kind)
    for k, m in enumerate(found):
        out[k, : m.shape[0], : m.shape[1]] = m
    return out


def _scanned(giant: DataFrame, path: str, chunk: int, parts: int) -> DataFrame:
    """(_row, k, ids): the ids of each chunk of ``giant(_row, text)`` by the scan."""

    def pieces_of(batches):
        look = model(path).longest
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = marked(t)
                starts = range(0, len(seen), chunk)
                found = [[row] * len(starts), range(len(starts)), [seen[max(a - look, 0) : a + chunk + look] for a in starts], [min(a, look) for a in starts], [min(chunk, len(seen) - a) for a in starts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["_row", "k", "chunk", "at", "n"])

    cut = giant.mapInArrow(pieces_of, "_row long, k int, chunk string, at int, n int").repartition(parts, "_row", "k")

    def matrices(batches):
        known = model(path)
        for batch in batches:
            found = [known.matrix(c, at, n).astype(known.kind) for c, at, n in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["_row", "k", "rows", "matrix"])

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        whole = functools.reduce(combined, _stacked(table, model(path).kind))
        return pa.table({"_row": table["_row"][:1], "run": table["run"][:1], "rows": pa.array([len(whole)], pa.int32()), "matrix": pa.array([whole.tobytes()], pa.binary())})

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        found = boundary_states(_stacked(table, model(path).kind))
        return pa.table({"_row": table["_row"], "run": table["run"], "first": pa.array(found[:-1], pa.int32()), "last": pa.array(found[1:], pa.int32())})

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        found = boundary_states(_stacked(table, model(path).kind), table["first"][0].as_py(), table["last"][0].as_py())
        return pa.table({"_row": table["_row"], "k": table["k"], "enter": pa.array(found[:-1], pa.int32()), "leave": pa.array(found[1:], pa.int32())})

    def traces(batches):
        known = model(path)
        for batch in batches:
            ids = [np.frombuffer(known.trace(*x), np.int32) for x in zip(*[batch.column(k).to_pylist() for k in range(2, 7)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["_row", "k", "ids"])

    each = written(cut.mapInArrow(matrices, "_row long, k int, rows int, matrix binary").withColumn("run", F.expr(f"k div {RUN}")), "matrices")
    runs = each.groupBy("_row", "run").applyInArrow(product, "_row long, run long, rows int, matrix binary")
    bounds = runs.groupBy("_row").applyInArrow(ends, "_row long, run long, first int, last int")
    moved = each.join(bounds, ["_row", "run"]).groupBy("_row", "run").applyInArrow(states, "_row long, k int, enter int, leave int")
    return cut.join(moved, ["_row", "k"]).select("_row", "k", "chunk", "at", "n", "enter", "leave").mapInArrow(traces, "_row long, k int, ids array<int>")


@own_names("text")
def encode(docs: DataFrame, path: str, *, text: str = "text", chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """``docs`` with ``pieces``, the ids of the text under the model file ``path``; with ``decoded`` also the text that they
    spell, made in the same pass. A mark (``▁``) in a text reads back as a blank, as it does in the library.

    Null and empty texts have no pieces. Texts of more than ``chunk`` characters are cut and their chunks dealt out;
    they join their row again by a number that the scan gives it; a run of one letter is cut as well. Ties, repeated rows and
    an empty table need no care: rows are encoded one by one. Other columns pass through; one named ``pieces`` (or ``decoded``) is replaced.
    """
    docs = docs.drop("pieces", *["decoded"] * decoded)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])

    def whole(batches):
        known = model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                raw = [known.encode(t or "") for t in part.column(at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                shown = [pa.array([known.decode(np.frombuffer(r, np.int32).tolist()) for r in raw], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *shown], names=schema.names)

    size = F.coalesce(F.length(text), F.lit(0))
    short = docs.filter(size <= chunk).mapInArrow(whole, schema)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    giant = written(docs.filter(size > chunk).select(row, F.monotonically_increasing_id().alias("_row")), "giant")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    traced = _scanned(giant.select("_row", F.col("row").getField(text).alias("text")), path, chunk, parts)
    joined = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("pieces"))
    whole_giant = giant.join(joined, "_row").select("row.*", "pieces")
    return short.unionByName(decode(whole_giant, path) if decoded else whole_giant)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that ``pieces`` spell. Null pieces give null."""
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("pieces")

    def read(batches):
        known = model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                lists = part.column(at)
                flat, offsets = lists.values.to_numpy().tolist(), lists.offsets.to_numpy()
                shown = [known.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shown, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(read, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
