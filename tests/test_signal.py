import random

import numpy as np
from pyspark.sql import functions as F

from peaklane.operators import signal as sg


def walk(side, top):
    """The boundary rule on one side, step by step."""
    last, rises, k = top, 0, 0
    for x in side:
        if x >= last:
            if last <= 0.1 * top or rises >= 1:
                break
            rises += 1
        last, k = x, k + 1
    seen = side[:k]
    return seen.index(min(seen)) + 1 if seen and min(seen) < top else k


def peak(v, apex=None, climb=False):
    if apex is None:
        apex = v.index(max(v)) if max(v) > 0 else 0
    elif climb:
        top, at = v[apex], apex
        for i in range(apex - 1, -1, -1):
            if v[i] <= top:
                break
            top, at = v[i], i
        for i in range(apex + 1, len(v)):
            if v[i] <= top:
                break
            top, at = v[i], i
        apex = at
    left = apex - walk(v[:apex][::-1], v[apex])
    right = apex + walk(v[apex + 1 :], v[apex])
    return apex, left, right, max(0.0, min(v[left : right + 1]))


def test_peaks_against_loops(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([0, 0, 1, 2, 3, 5, 8, 20])) for _ in range(rng.randint(1, 14))]) for i in range(400)]
    rows = [(i, v, rng.randrange(len(v))) for i, v in rows]
    df = spark.createDataFrame(rows, "id int, v array<double>, at int")
    got = df.select("id", sg.find_peak("v").alias("a"), sg.find_peak("v", "at").alias("b"), sg.find_peak("v", "at", climb=True).alias("c")).collect()
    for r in got:
        _, v, at = rows[r.id]
        assert tuple(r.a) == peak(v) and tuple(r.b) == peak(v, at) and tuple(r.c) == peak(v, at, True), rows[r.id]
    assert spark.createDataFrame([(0, [])], "id int, v array<double>").select(sg.find_peak("v").alias("p")).first().p is None


def test_best_ion_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = {m: rng.integers(0, 30, (5, 12)).astype(float) for m in range(20)}
    rows = [(m, i, data[m][i].tolist(), 2, 9, 5) for m in data for i in range(5)]
    ions = spark.createDataFrame(rows, "m int, ion int, v array<double>, s int, e int, a int")
    got = {(r.m, r.ion): (r.best_ion, r.cor) for r in sg.best_ion(ions, ["m"], "ion", "v", "s", "e", "a").collect()}
    for m, x in data.items():
        cor = np.nan_to_num(np.corrcoef(x[:, 2:10]))
        cor = np.where(cor < 0, 0, cor)
        np.fill_diagonal(cor, 1)
        best = int(np.argmax(np.round(cor @ x[:, 5] / max(x[:, 5].sum(), 1e-300), 12)))
        for i in range(5):
            assert got[m, i][0] == best and abs(got[m, i][1] - cor[best, i]) < 1e-9


def test_refine_keeps_the_old_peak_where_it_refuses(spark):
    v = [0.0, 1.0, 4.0, 9.0, 4.0, 1.0, 0.0]
    flat = [0.0] * 7  # its refined peak is a single scan
    rows = [(1, i, v, 0, 6, 0.9) for i in range(3)] + [(2, i, v, 0, 6, 0.9) for i in range(2)] + [(2, 3, v, 0, 6, 0.1)] + [(3, i, v, 0, 3, 0.9) for i in range(3)] + [(4, i, flat, 1, 6, 0.9) for i in range(3)]
    ions = spark.createDataFrame([(*r, 2, 0.5) for r in rows], "m int, ion int, v array<double>, s int, e int, c double, apex int, min_smoothed double")
    got = sorted(tuple(r) for r in sg.refine_peak(ions, ["m"], "v", "s", "e", "c").collect())
    _, left, right, _ = peak(flat[1:])
    assert right - left < 1 and got == [(1, 3, 0, 6, 0.0, True), (2, 2, 0, 6, 0.5, False), (3, 2, 0, 3, 0.5, False), (4, 2, 1, 6, 0.5, False)]


def test_smoothing_arrays_and_rows_agree(spark):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randint(0, 9))) for k in range(5) for i in range(11)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    lists = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("l")).select("k", F.transform("l", lambda x: x["v"]).alias("v"))
    for n in (3, 5, 7, 9):
        flat = {(r.k, r.i): r.smoothed for r in sg.smooth(df, ["k"], "i", "v", n).collect()}
        for r in lists.select("k", sg.smooth_array("v", n).alias("s")).collect():
            assert all(abs(flat[r.k, i] - s) < 1e-9 for i, s in enumerate(r.s))
