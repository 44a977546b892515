"""Groups that are too large for one task: the split paths against the plain ones and against loops."""

import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklane.operators import aggregates as ag
from peaklane.operators import intervals as iv
from peaklane.operators import joins as jn
from peaklane.operators import quantiles as qu
from peaklane.operators import signal as sg
from peaklane.operators import slices as sl

INF, NAN = float("inf"), float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_keys_keep_order_and_value(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, INF, -INF, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 2.0, 3.0]
    values += [2.0**k * x for k in range(-1074, 1024, 3) for x in (1.0, 1 + 2**-52, 1 - 2**-53)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", qu.order_key(F.col("v")).alias("k")).select("v", "k", qu.from_order_key(F.col("k")).alias("back"))
    rows = df.collect()
    assert all(r.back == r.v for r in rows)
    assert all(r.k == (struct.unpack("<q", struct.pack("<d", abs(r.v)))[0] * (-1 if r.v < 0 else 1)) for r in rows)
    nan = spark.createDataFrame([(NAN,)], "v double").select(qu.order_key(F.col("v")).alias("k")).select("k", qu.from_order_key(F.col("k")).alias("b")).first()
    assert nan.k > max(r.k for r in rows) and math.isnan(nan.b)


def quantile(values, share):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    place = (len(values) - 1) * share
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


@pytest.mark.parametrize("gather", [4, 60, 10_000])
def test_quantiles_against_sorting(spark, gather):
    rng = random.Random(gather)
    rows = [("hot", 7.5, None) for _ in range(400)] + [("hot", rng.gauss(0, 1e-3), rng.random()) for _ in range(300)]
    rows += [(None, rng.choice([1.0, -2.0, 1e300, -1e-300]), float(k)) for k in range(90)] + [("few", 1.0, 2.0), ("few", 4.0, None), ("none", None, None)]
    rows += [("close", 1 + k * 2.0**-52, -INF if k % 2 else INF) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    at = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = qu.exact_quantiles(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, at, gather=gather)
    held = {r["_key"].g: r for r in got.collect()}
    assert set(held) == {"hot", None, "few", "none", "close"}
    for g, r in held.items():
        for k, c in ((1, "a"), (2, "b")):
            want = [quantile([x[k] for x in rows if x[0] == g], p) for p in at]
            assert all(x == y or x is not None and y is not None and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(r[c], want, strict=True)), (g, c, r[c], want)
    whole = qu.exact_quantiles(df, [], {"a": F.col("a")}, [0.5], gather=gather).collect()
    assert [list(r.a) for r in whole] == [[quantile([x[1] for x in rows], 0.5)]]
    assert "percentile" not in plan(got).lower() and qu.exact_quantiles(df.limit(0), ["g"], {"a": F.col("a")}, at).count() == 0


def test_aggregates_of_one_large_group(spark):
    rng = np.random.default_rng(2)
    o, p = rng.normal(size=2000), rng.normal(size=2000)
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(o, p, strict=True)] + [(1, None, 3.0)], "k int, o double, p double").repartition(6)
    for by in (["k"], []):
        r = ag.regression_metrics(df, "o", "p", by, gather=50).first()
        assert r.n == 2000 and math.isclose(r.median_error, np.median(abs(o - p))) and math.isclose(r.error_95, np.percentile(abs(o - p), 95)) and math.isclose(r.r, np.corrcoef(o, p)[0, 1])
    assert tuple(ag.regression_metrics(df.limit(0), "o", "p").first()) == (None, None, None, None, 0)
    told = {r.metric: r for r in ag.describe_metrics(df, ["o", "p"], gather=50).collect()}
    assert math.isclose(told["o"].q25, np.percentile(o, 25)) and told["o"].n == 2000 and told["p"].n == 2001
    both = ag.median_by(df, ["k"], ["o", "p"], gather=50)
    assert both.columns == ["k", "o", "p"] and math.isclose(both.first().o, np.median(o))


def test_numbers_and_smoothing_in_slices(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.random(), {"m": 1}) for k, n in (("a", 90), ("b", 3), ("c", 41), (None, 30)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v double, m map<string,int>").repartition(5)
    number = lambda **how: {(r.k, r.i): r.scan_index for r in sg.scan_index(df, ["k"], "i", **how).collect()}
    assert number(most=7) == number() == {(k, i): i for k, i, *_ in rows}
    assert sg.scan_index(df, [], "v", most=20).agg(F.count_distinct("scan_index")).first()[0] == len(rows)
    for n in (3, 5, 7, 9):
        for most in (4, 10, 89):
            got, want = ({(r.k, r.i): r.smoothed for r in sg.smooth(df, ["k"], "i", "v", n, most=m).collect()} for m in (most, 1000))
            assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in got)


def test_a_large_group_is_numbered_in_many_tasks(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("i"))
    placed = sl.ranged(df.withColumn("_key", qu.group_key(["k"])), sl.large_groups(df.withColumn("_key", qu.group_key(["k"])), 500), ["i"], 500)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1500
    ties = spark.range(4000).select(F.lit(1).alias("k"), F.lit(0).alias("i"), "id")
    tied = ties.withColumn("_key", qu.group_key(["k"]))
    assert sl.ranged(tied, sl.large_groups(tied, 500), ["i"], 500).select("_part").distinct().count() >= 7


@pytest.mark.parametrize("by", [["g"], []])
def test_nearest_in_ranges(spark, by):
    rng = random.Random(4)
    left = [(rng.choice("aab"), rng.randrange(300), k) for k in range(400)] + [("c", 5, 1000), (None, 1, 1001)]
    right = [(rng.choice("ab"), rng.choice([rng.randrange(50), rng.randrange(250, 300)]), k) for k in range(60)]
    a, b = spark.createDataFrame(left, "g string, o int, k int").repartition(4), spark.createDataFrame(right, "g string, p int, id int")
    want = {}
    for g, o, k in left:
        near = [(abs(p - o), p, i) for h, p, i in right if not by or h == g]
        want[k] = min(near)[1:] if near else (None, None)
    for most in (9, 100, 10_000):
        got = jn.nearest_join(a, b, by, "o", "p", "k", "id", most=most).collect()
        assert {r.k: (r.nearest_p, r.nearest_id) for r in got} == want and len(got) == len(left)


def test_no_frame_of_nearest_rows_runs_to_the_end(spark):
    a, b = (spark.range(40).select(F.col("id").alias(c), (F.col("id") * 7 % 40).alias(o)) for c, o in (("k", "o"), ("id", "p")))
    for most in (9, 1000):
        out = jn.nearest_join(a, b, [], "o", "p", "k", "id", most=most)
        assert "unboundedfollowing" not in plan(out).lower() and all(r.o == r.nearest_p for r in out.collect())


def test_points_in_intervals_of_any_length(spark):
    rng = random.Random(5)
    points = [(k, rng.choice([rng.uniform(0, 10), rng.gauss(0, 1e6), 3.0, 0.0, 2.0**-1074, 1e308, -1e308])) for k in range(300)] + [(900, INF), (901, -INF), (902, NAN), (903, None)]
    spans = [(k, x, x + rng.choice([1e-9, 0.5, 3.0, 1e5])) for k, x in enumerate(rng.uniform(-5, 10) for _ in range(60))]
    spans += [(100, 0.0, INF), (101, -INF, 2.0), (102, -INF, INF), (103, 3.0, 3.0), (104, -0.0, 0.0), (105, 0.0, 3e9), (106, 5.0, 1.0), (107, None, 2.0), (108, NAN, 2.0), (109, 1.0, NAN), (110, INF, INF), (111, 0.0, 2.0**-1074), (112, -1.7e308, 1.7e308)]
    want = {(p, w) for p, v in points if v is not None and v == v for w, lo, hi in spans if lo is not None and lo <= v <= hi}
    a, b = spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(spans, "w int, lo double, hi double")
    for ranges, some in ((b, set(range(200))), (b.filter("w < 100"), set(range(100))), (b.filter("w = 105"), {105}), (b.filter("w >= 103 AND w <= 104"), {103, 104}), (b.filter("w = 106"), set())):
        out = jn.interval_join(a, ranges, "v", "lo", "hi", ["p"])
        rows = [(r.p, r.w) for r in out.collect()]
        assert set(rows) == {x for x in want if x[1] in some} and len(rows) == len(set(rows)) and "NestedLoop" not in plan(out)
    spread = b.filter("w NOT IN (106, 107, 108, 109)").select("w", F.size(F.sequence(iv._bin(F.col("lo"), iv._level(F.col("lo"), F.col("hi"))), iv._bin(F.col("hi"), iv._level(F.col("lo"), F.col("hi"))))).alias("n"))
    assert spread.filter("w < 100 OR w = 105").agg(F.max("n")).first()[0] <= 5
    first = {r.p: r.w for r in jn.interval_join(a.filter("p < 50"), b, "v", "lo", "hi", ["p"], how="first").collect()}
    assert all((p, w) in want for p, w in first.items()) and set(first) == {p for p, _ in want if p < 50}
    empty = jn.interval_join(a.limit(0), b, "v", "lo", "hi", ["p"])
    assert empty.count() == 0 and jn.interval_join(a, b.limit(0), "v", "lo", "hi", ["p"]).count() == 0
    looked = {r.p: r.w for r in jn.interval_lookup(a.filter("p < 20"), b.filter("w IN (103, 105)"), "v", "lo", "hi", "w", ["p"], -1).collect()}
    assert all(looked[p] == (min([w for q, w in want if q == p and w in (103, 105)], key=lambda w: w == 103, default=None) or (105 if v < 0 or v > 3e9 else -1)) for p, v in points[:20])


def test_windows_of_time(spark):
    rng = random.Random(6)
    left, right = [(rng.choice("ab"), rng.uniform(0, 9), k) for k in range(40)], [(rng.choice("ab"), rng.choice([rng.uniform(0, 9), 3.0]), k) for k in range(80)]
    a, b = spark.createDataFrame(left, "g string, t double, k int"), spark.createDataFrame(right, "g string, s double, j int")
    for window in (0.0, 0.25, 2.0, INF):
        got = {(r.k, r.j) for r in jn.rt_window_join(a, b, "t", "s", window, ["g"], offset=0.5).collect()}
        assert got == {(k, j) for g, t, k in left for h, s, j in right if g == h and abs(s - (t + 0.5)) <= window}


def test_bands_touch_two_bins(spark):
    rng = random.Random(7)
    values = [10.0 ** rng.uniform(-6, 12) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "t double")
    for tolerance, ppm, lower, upper in ((20, True, F.col("t") / (1 + 20e-6), F.col("t") / (1 - 20e-6)), (0.02, False, F.col("t") - 0.02, F.col("t") + 0.02)):
        n = df.select((jn.band_bins(upper, tolerance, ppm) - jn.band_bins(lower, tolerance, ppm)).alias("n")).agg(F.max("n")).first()[0]
        assert n <= 1
    a = spark.createDataFrame([(k, v) for k, v in enumerate([500.0, 500.02, 0.0, -3.0, None, NAN, 1e9])], "k int, t double")
    b = spark.createDataFrame([(500.004,), (500.0,), (0.0,), (-3.0,), (1e9 * (1 + 29e-6),), (NAN,), (None,)], "p double")
    got = sorted((r.k, r.p) for r in jn.band_join(a, b, "t", "p", 30).collect())
    want = sorted((k, p) for k, t in enumerate([500.0, 500.02, 0.0, -3.0, 1e9]) for p in (500.004, 500.0, 0.0, -3.0, 1e9 * (1 + 29e-6)) if t / (1 + 30e-6) <= p <= t / (1 - 30e-6))
    assert [(4 if k == 6 else k, p) for k, p in got] == want
    assert {(r.k, r.p) for r in jn.band_join(a, b, "t", "p", 0, ppm=False).collect()} == {(0, 500.0), (2, 0.0), (3, -3.0)}
    with pytest.raises(ValueError):
        jn.band_join(a, b, "t", "p", 1e6)


def test_binomial_tail_of_many_trials(spark):
    pairs = [(700, 500), (10000, 9700), (9700, 10000), (600, 600), (0, 1200), (1200, 0), (1, 1199), (16, 15), (0, 0), (0, 1), (5, 3), (1_000_000, 1_003_000)]
    df = spark.createDataFrame(pairs, "n_pos long, n_neg long")
    got = {(r.n_pos, r.n_neg): r for r in ag.consensus(df, "binomial", 0.05).collect()}
    for k, j in pairs[:-1]:
        n, term, total = k + j, 1, 0
        for i in range(k + 1):
            total += term
            term = term * (n - i) // (i + 1)
        assert math.isclose(got[k, j].cdf, float(Fraction(total, 2**n)), rel_tol=1e-11, abs_tol=1e-300), (k, j)
    assert (got[700, 500].label, got[500 + 9200, 10000].label, got[600, 600].label, got[0, 0].label) == (1, 0, None, 1)
    assert 0.0169 < got[pairs[-1]].cdf < 0.0172
