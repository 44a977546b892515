"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words and word beginnings. The machine scores
``bias + sum w_i + sum over pairs <v_i, v_j>``: the pair term learns combinations that additive weights miss, such as
an insult next to the mention of a group.

It is trained on the driver from a sample of labelled rows that ``max_rows`` bounds, whatever the size of the table. Terms
are kept if their share of toxic rows differs clearly, or if that of a pair of frequent terms differs clearly from what the
two say one by one, so terms that matter in pairs alone stay. Scores need one pass over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peaklane.llm.scratch import written
from peaklane.llm.names import own_names
from peaklane.llm.words import PLAIN_BLANK, words


def _terms(column, dims: int, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of all documents one after the other, and the offsets of each document. ``slots`` maps
    each hashed term to a smaller number, or to -1 to leave it out."""
    w = words(column, seed=11, lower=True, blank=PLAIN_BLANK)
    doc = w.doc
    parts = []
    for code in (w.code, w.stems(5, 13)):
        term = (code % np.uint64(dims)).astype(np.int64)
        if slots is not None:
            term = slots[term]
            held = term >= 0
            parts.append((doc[held], term[held]))
        else:
            parts.append((doc, term))
    width = np.int64(dims if slots is None else max(1, int(slots.max()) + 1))
    both = np.unique(np.concatenate([d * width + t for d, t in parts]))
    return both % width, np.searchsorted(both // width, np.arange(len(w.first)))


@dataclass
class Machine:
    """``slots``: of each hashed term the place of its weights, or -1."""

    slots: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])[offsets], axis=0)
        v = self.factors[terms]
        return self.bias + total(self.linear[terms]) + 0.5 * (total(v) ** 2 - total(v**2)).sum(1)

    def scores(self, column) -> np.ndarray:
        terms, offsets = _terms(column, len(self.slots), self.slots)
        return 1 / (1 + np.exp(-np.clip(self.logits(terms, offsets), -40, 40)))


def _pair_terms(rows: list[np.ndarray], y: np.ndarray, terms: int, least: int = 5, limit: float = 5.5) -> np.ndarray:
    """The terms of pairs whose joint share of toxic rows departs from what the terms say one by one: the contrast of the
    shares with both, either and none, over its standard error."""
    x = np.zeros((len(y), terms), np.float32)
    for r, t in enumerate(rows):
        x[r, t] = 1
    both, toxic = (x.T @ x).astype(float), (x.T @ (x * y[:, None].astype(np.float32))).astype(float)
    n, h = np.diag(both), np.diag(toxic)
    cells = [(both, toxic), (n[:, None] - both, h[:, None] - toxic), (n - both, h - toxic), (len(y) - n[:, None] - n + both, y.sum() - h[:, None] - h + toxic)]
    rare = np.minimum.reduce([c for c, _ in cells]) < least
    share = [hits / np.maximum(c, 1) for c, hits in cells]
    error = np.sqrt(y.mean() * (1 - y.mean()) * sum(1 / np.maximum(c, 1) for c, _ in cells) + 1e-12)
    z = np.where(rare, 0.0, np.abs(share[0] - share[1] - share[2] + share[3]) / error)
    return np.flatnonzero(z.max(1, initial=0.0) >= limit)


def _fit(rows: list[np.ndarray], y: np.ndarray, slots: np.ndarray, width: int, rank: int, steps: int, seed: int) -> Machine:
    n, pos = len(y), max(1.0, y.sum())
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    t, row = np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(n), np.diff(cut))
    rng = np.random.default_rng(seed)
    start = float(np.log(pos / max(1.0, n - pos))) if n > pos else 0.0
    model = Machine(slots, start, np.zeros(width), rng.normal(0, 0.1, (width, rank)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), model.linear, model.factors)]
    bias = np.array([model.bias])
    for step in range(1, steps + 1):
        model.bias = float(bias[0])
        v = model.factors[t]
        sums = np.diff(np.concatenate([np.zeros((1, rank)), np.cumsum(v, 0)])[cut], axis=0)
        error = 1 / (1 + np.exp(-np.clip(model.logits(t, cut), -40, 40))) - y
        g_linear = np.bincount(t, error[row], width)
        pull = error[row][:, None] * (sums[row] - v)
        g_factors = np.zeros_like(model.factors)
        for k in range(rank):
            g_factors[:, k] = np.bincount(t, pull[:, k], width)
        for p, g, (m1, m2) in zip((bias, model.linear, model.factors), (np.array([error.sum()]), g_linear + 0.05 * model.linear, g_factors + 0.1 * model.factors), moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.bias = float(bias[0])
    return model


def train(docs: DataFrame, labels: DataFrame, *, ids: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, max_rows: int = 12_000, dims: int = 1 << 18, kept: int = 4096, paired: int = 1024, rank: int = 4, steps: int = 200, seed: int = 5) -> Machine:
    """A machine fitted to at most ``max_rows`` labelled rows for which ``usable`` holds, those whose ids (then texts) hash
    lowest.

    ``kept`` bounds the terms kept for their own share of toxic rows, ``paired`` the frequent terms that are tried in pairs;
    ``rank`` 0 gives a linear model. The driver sees counts of ``dims`` hashed terms, and of the sampled rows those terms
    that are candidates.

    Labels that are null are left out; an id labelled twice counts as toxic if one label is 1. An id that stands in ``docs``
    twice counts twice, within the bound. Without any labelled row the machine scores every text alike.
    """
    named = labels.filter(F.col(label).isNotNull() & F.col(ids).isNotNull())
    named = (named.filter(usable) if usable is not None else named).groupBy(ids).agg(F.max(label).cast("double").alias("_y"))
    sample = named.orderBy(F.xxhash64(ids), ids).limit(max_rows)
    chosen = docs.select(F.col(ids).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample.withColumnRenamed(ids, "_id")), "_id")  # max_rows bounds the sample
    chosen = written(chosen.select("_y", "_text", "_id", F.monotonically_increasing_id().alias("_row")), "sample")
    if chosen.count() > max_rows:  # ids that stand several times
        kept_rows = chosen.select("_id", F.xxhash64("_text").alias("_told"), "_row").orderBy(F.xxhash64("_id"), "_id", "_told", "_row").limit(max_rows).select("_row")
        chosen = written(chosen.join(F.broadcast(kept_rows), "_row", "left_semi"), "sample")
    chosen = chosen.select("_y", "_text")

    def pairs(batches):
        for batch in batches:
            found, offsets = _terms(batch.column(1), dims)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets)))], names=["term", "y"])

    counts = chosen.mapInArrow(pairs, "term int, y double").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("hit")).filter("n >= 4").orderBy("term").toArrow()
    whole = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("y")).first()
    term, df, hit = (counts[c].to_numpy() for c in ("term", "n", "hit"))
    n, pos = max(1, whole["n"]), max(1.0, whole["y"])
    share = df / n
    z = np.abs(hit - pos * share) / np.sqrt(np.maximum(pos * share * (1 - share) * (1 - pos / max(2, n)), 1e-9))
    own = np.argsort(-z, kind="stable")[:kept]
    own = own[z[own] >= 3.5]
    often = np.argsort(-(share * (1 - share)), kind="stable")[:paired]
    candidates = np.concatenate([often, np.setdiff1d(own, often)])
    slots = np.full(dims, -1, np.int64)
    slots[term[candidates]] = np.arange(len(candidates))

    def terms(batches):
        for batch in batches:
            found, offsets = _terms(batch.column(1), dims, slots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))], names=["y", "terms"])

    told = chosen.mapInArrow(terms, "y double, terms array<int>").toArrow().sort_by("y").combine_chunks()
    y, rows = told["y"].to_numpy(), [np.sort(np.array(r, np.int64)) for r in told["terms"].to_pylist()]
    order = sorted(range(len(y)), key=lambda k: (y[k], rows[k].tolist()))  # the fit does not depend on the order of arrival
    y, rows = y[order], [rows[k] for k in order]
    tried = len(often)
    good = np.zeros(len(candidates), bool)
    good[np.isin(candidates, own)] = True
    if len(y) and tried:
        good[_pair_terms([r[r < tried] for r in rows], y, tried)] = True
    place = np.where(good, np.cumsum(good) - 1, -1)
    slots = np.where(slots >= 0, place[slots], -1) if len(candidates) else slots
    return _fit([place[r][place[r] >= 0] for r in rows], y, slots, int(good.sum()), rank, steps, seed)


@own_names("text")
def toxicity(docs: DataFrame, machine: Machine, *, text: str = "text", at_least: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is ``at_least`` or more, else 0).

    The whole text is scored, and nothing else of a row. Null and empty texts get the score of no terms. Rows are
    scored one by one, so repeated rows get the same score; an empty table stays empty. Columns named like a new one are replaced.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for batch in batches:
            p = machine.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= at_least).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(score, schema)
