"""Work that must not grow faster than its input, and results that must not depend on the order of rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from peaklane.functions import scalars as sc
from peaklane.operators import aggregates as ag
from peaklane.operators import filters as fl
from peaklane.operators import generate as gen
from peaklane.operators import joins as jn
from peaklane.operators import pairs
from peaklane.operators import quantiles as qu
from peaklane.operators import signal as sg
from peaklane.operators import slices as sl
from peaklane.plans import jobs
from peaklane.sources import io

INF, NAN = float("inf"), float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_of_copies_cost_no_pairs(spark):
    rng = random.Random(11)
    values = [rng.choice([1.0, 2.5, 7.0, 7.25]) for _ in range(300)] + [None, NAN, INF]
    spans = [rng.choice([(0.0, 7.0), (2.5, 2.5), (7.0, INF), (-INF, 1.0), (3.0, 1.0), (None, 9.0)]) for _ in range(200)]
    points = spark.createDataFrame(list(enumerate(values)), "p int, v double")
    windows = spark.createDataFrame([(lo, hi, k) for k, (lo, hi) in enumerate(spans)], "lo double, hi double, w int")
    out = jn.interval_totals(points, windows, "v", "lo", "hi", {"ids": F.col("w")})
    want = {}
    for p, v in enumerate(values):
        held = [k for k, (lo, hi) in enumerate(spans) if v is not None and v == v and lo is not None and lo <= v <= hi]
        if held:
            want[p] = (len(held), sum(held))
    assert {r.p: (r.n_windows, r.ids) for r in out.collect()} == want


def test_points_and_windows_are_not_broadcast(spark):
    points = spark.range(50).select(F.col("id").cast("double").alias("v"))
    windows = spark.createDataFrame([(0.0, 10.0), (3.0, INF)], "lo double, hi double")
    out = jn.interval_join(points, windows, "v", "lo", "hi", ["v"])
    assert out.count() == 11 + 47 and "BroadcastHashJoin" not in plan(out)


def test_band_totals_of_copies(spark):
    rng = random.Random(12)
    t = [rng.choice([500.0, 500.004, 0.0, -3.0, None, NAN]) for _ in range(200)]
    p = [rng.choice([500.004, 500.0, 501.0, -3.0, None]) for _ in range(150)]
    a, b = spark.createDataFrame(list(enumerate(t)), "k int, t double"), spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.k: (r.n, r.ids) for r in jn.band_totals(a, b, "t", "p", 30, {"ids": F.col("i")}).collect()}
    pairs = jn.band_join(a, b, "t", "p", 30).groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("ids"))
    assert got == {r.k: (r.n, r.ids) for r in pairs.collect()} and len(got) > 50


def measured(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), k, r, rng.choice([0.0, 1.0, 2.5, 2.5, -1.0, None])) for k in range(14) for r in range(4) if rng.random() < 0.6] + [("c", 99, 0, 1.0), (None, 1, 0, 2.0)]
    values = spark.createDataFrame(rows, "g string, i long, r int, v double").dropDuplicates(["g", "i", "r"])
    others = spark.createDataFrame([(g, k) for g in "abd" for k in range(10, 20)] + [(None, 3)], "g string, i long")
    return values, others


def test_votes_leave_python_as_lists(spark):
    values, others = measured(spark, 1)
    votes = pairs.pair_votes(values, others, "g", "i", "r", "v", tile=3)
    want = ag.vote(jn.rank_pairs(values, others, "g", "i", "r", "v"), ["g"])
    assert sorted(map(tuple, votes.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and votes.count() > 50
    assert "Generate posexplode" in plan(votes)


def test_an_item_travels_as_often_in_a_larger_group(spark):
    for n in (3000, 6000):
        values = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.lit(1).alias("r"), F.col("id").cast("double").alias("v"))
        met = pairs._tile_pairs(values, values, "g", "i", "r", "v", None).select(F.size("_x").alias("x"), F.coalesce(F.size("_y"), F.lit(0)).alias("y"))
        sizes = [(r.x, max(r.y, 0)) for r in met.collect()]
        assert sum(x + y for x, y in sizes) <= 13 * n and len(sizes) >= 20
        assert sum(x * y if y else x * (x - 1) // 2 for x, y in sizes) == n * (n - 1) // 2


def test_items_without_a_name_have_no_pairs(spark):
    v = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 2, 0, 2.0), ("g", None, 0, 3.0)], "g string, i int, r int, v double")
    assert sorted((r.a, r.b) for r in pairs.pair_votes(v, v, "g", "i", "r", "v").collect()) == [(1, 2), (2, 1)]
    assert sorted((r.a, r.b) for r in pairs.pair_sums(v, v.limit(0), "g", "i", "r", "v").collect()) == [(1, 2), (2, 1)]


def test_blocks_of_many_runs_are_halved(monkeypatch):
    rng = random.Random(5)
    kind = pa.struct([("item", pa.int64()), ("measured", pa.bool_()), ("seen", pa.list_(pa.struct([("run", pa.int32()), ("_v", pa.float64())])))])
    items = [{"item": k, "measured": k % 4 > 0, "seen": [{"run": r, "_v": float(rng.randrange(3))} for r in range(9) if k % 4 and rng.random() < 0.5]} for k in range(11)]
    x, y = pa.array(items[:6], kind), pa.array(items[6:], kind)

    def told():
        out = {}
        for tile in [t for sides in ((x, None), (y, None), (x, y)) for t in pairs._met(*sides)]:
            codes = tile.votes()
            for a, b in zip(*tile.pairs(), strict=True):
                assert out.setdefault((tile.names[0][a].as_py(), tile.names[1][b].as_py()), int(codes[a, b])) == codes[a, b]
        return out

    whole = told()
    monkeypatch.setattr(pairs, "DENSE", 20)
    assert told() == whole and set(whole) == {(a, b) for a in range(11) for b in range(11) if a != b and a % 4}


def test_sums_of_pairs(spark):
    values, others = measured(spark, 2)
    got = {(r.g, r.a, r.b): (r.n_runs, r.va, r.vb) for r in pairs.pair_sums(values, others, "g", "i", "r", "v", tile=3).collect()}
    rows = jn.rank_pairs(values, others, "g", "i", "r", "v").groupBy("g", "a", "b").agg(F.count("*").alias("n"), F.sum("va").alias("va"), F.sum("vb").alias("vb"))
    assert got == {(r.g, r.a, r.b): (r.n, r.va, r.vb) for r in rows.collect()}


def test_totals_of_pairs_by_run(spark):
    values, others = measured(spark, 3)
    got = sorted(map(tuple, pairs.pair_run_totals(values, others, "g", "i", "r", "v").collect()))
    rows = jn.rank_pairs(values, others, "g", "i", "r", "v").groupBy("g", "r").agg(F.count("*").alias("n"), F.sum("va").alias("va"), F.sum("vb").alias("vb"))
    assert got == sorted(map(tuple, rows.collect())) and len(got) == 8


def test_totals_of_pairs_of_a_run(spark):
    values, others = measured(spark, 4)
    got = sorted(map(tuple, pairs.single_run_totals(values, others, "g", "i", "r", "v").collect()))
    rows = jn.rank_pairs_single_run(values, others, "g", "i", "r", "v").groupBy("g", "r").agg(F.count("*").alias("n"), F.sum("label").alias("ones"), F.sum(F.col("a") * F.col("label")).alias("keys"))
    assert got == sorted(map(tuple, rows.collect())) and len(got) >= 6


def test_binomial_table(spark):
    votes = spark.createDataFrame([(p, n) for p in range(9) for n in range(9)], "n_pos long, n_neg long")
    tabled = ag.consensus(votes, "binomial", 0.2, most=16)
    assert sorted(map(str, tabled.collect())) == sorted(map(str, ag.consensus(votes, "binomial", 0.2).collect()))
    assert "aggregate(" not in str(votes._jdf.queryExecution().toString()) and "BroadcastHashJoin" in plan(tabled)


def test_binomial_table_is_looked_up_by_one_number(spark):
    votes = spark.createDataFrame([(7, 0, 3), (0, 7, 4), (None, 1, 5)], "n_pos long, n_neg int, k int")
    tabled = ag.consensus(votes, "binomial", 0.2, most=7)
    assert "BroadcastHashJoin [_pair" in plan(tabled) and tabled.columns == ["n_pos", "n_neg", "k", "cdf", "label"]
    assert sorted((r.k, r.label) for r in tabled.collect()) == [(3, 1), (4, 0)]


def test_grid_search_by_exact_means(spark):
    rng = random.Random(6)
    cents = [rng.randrange(10**7) for _ in range(3997)]
    cents += [-sum(cents) % 4000 + 2000, 4000, 8000]  # the mean ends in half a cent
    grid = spark.createDataFrame([(1,)], "a int")
    exact = sum(cents) / 4000
    assert exact % 1 == 0.5
    for _ in range(4):
        rng.shuffle(cents)
        df = spark.createDataFrame([(1, c / 100) for c in cents], "k int, x double").repartition(7)
        out = jn.grid_search(df, grid, ["k"], lambda: F.col("x") * F.col("a"), ["a"], digits=8)
        assert out.first().score == exact / 100
    odd = spark.createDataFrame([(1, INF), (1, 2.0), (2, 1e30), (3, NAN), (4, None)], "k int, x double")
    assert {r.k: str(r.score) for r in jn.grid_search(odd, grid, ["k"], lambda: F.col("x") * F.col("a"), ["a"], digits=8).collect()} == {1: "inf", 2: "1e+30", 3: "nan", 4: "None"}


def test_few_ranges_for_small_slices(spark):
    df = spark.range(20_000).withColumn("_key", qu.group_key([]))
    placed = sl.ranged(df, sl.large_groups(df, 10), ["id"], 10)
    assert placed.select("_part").distinct().count() <= 260


def test_digest_totals(spark):
    rows = [(1, "MKAAAAAAARPDDDDDDDKAAAAAAAR"), (1, "MKAAAAAAARCCCCCCCK"), (2, "*KRAAAAAAAK*"), (3, None), (None, "AAAAAAAKCCCCCCCR"), (None, "AAAAAAAK"), (4, "")]
    names = [e[0] for e in gen.ENZYMES[1:]]
    for some in (rows, [r for k, r in enumerate(rows) if k not in (0, 4)]):
        df = spark.createDataFrame(some, "k int, s string")
        got = sorted(map(str, gen.digest_totals(df, ["k"], "s", names, 7, 12).collect()))
        want = []
        for name in names:
            cut = gen.digest(df, ["k"], "s", name, 0, 7, 12).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("peptide")).alias("residues"))
            want += cut.select(F.lit(name).alias("enzyme"), "k", "n", "residues").collect()
        assert got == sorted(map(str, want)) and len(got) > 10


def test_codes_make_the_modifications_once(spark):
    mods = F.transform(F.col("m"), lambda x: F.struct(F.when(x > 5, "b").otherwise("a").alias("name"), x.alias("site")))
    df = spark.createDataFrame([("PEPTIDE", [2, 7]), ("PEPTIDE", [0]), ("PEPTIDE", []), ("PEP", [0, 3])], "s string, m array<int>")
    code = sc.encode_modified("s", mods, {"a": "1"})
    assert [r.c for r in df.select(code.alias("c")).collect()] == ["-P1PTIDE-", "1PEPTIDE-", "-PEPTIDE-", "1PE1-"]
    assert str(df.select(code.alias("c"))._jdf.queryExecution().optimizedPlan().toString()).count("CASE WHEN (lambdavariable") + str(df.select(code.alias("c"))._jdf.queryExecution().optimizedPlan().toString()).count("map(keys: [a]") <= 2


def test_pairs_of_one_group_are_spread(spark):
    rows = [("g", k % 150) for k in range(400)] + [("h", 7), ("h", 7), ("h", None), ("i", 1), ("i", 2), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, i long")
    want = sorted([("g", a, b) for b in range(150) for a in range(b)] + [("i", 1, 2)])
    for how in ({}, {"tile": 1}, {"tile": 7}, {"tile": 40}):
        assert sorted(map(tuple, jn.group_pairs(df, ["g"], "i", **how).collect())) == want
    out = jn.group_pairs(df, ["g"], "i", tile=7)
    by_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) == 4 and max(by_task) < 0.6 * len(want) and "SortMergeJoin [g" in plan(out)
    odd = spark.createDataFrame([(NAN, "b"), (NAN, "a"), (1.0, "")], "k double, i string")
    assert [str(tuple(r)) for r in jn.group_pairs(odd, ["k"], "i").collect()] == ["(nan, 'a', 'b')"]
    floats = spark.createDataFrame([(1, NAN), (1, 2.0), (1, INF)], "k int, v double")
    assert sorted(str(tuple(r)[1:]) for r in jn.group_pairs(floats, ["k"], "v").collect()) == ["(2.0, inf)", "(2.0, nan)", "(inf, nan)"]


def test_pairs_take_little_where_they_are_written(spark, tmp_path):
    df = spark.range(2500).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 100_003).alias("i"))
    jn.group_pairs(df, ["g"], "i").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).filter("a < b").distinct().count() == 2500 * 2499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * 2500 * 2499 // 2


def test_threshold_looks_for_the_maximum_once(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [10.0, 1.0, 0.9]), (2, [1.0, 2.0], [5.0, None]), (3, [], []), (4, None, None)], "k int, m array<double>, i array<double>")
    cut = fl.relative_threshold(df, "m", "i", 0.1)
    assert [tuple(r) for r in cut.orderBy("k").collect()] == [(1, [1.0, 2.0], [10.0, 1.0]), (2, [1.0], [5.0])]
    assert ">= (array_max" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_middle_of_series_is_the_median(spark):
    rng = random.Random(8)
    rows = [(k, [[rng.choice([0.0, 1.5, -2.0, 3e5, 0.1, INF, NAN]) for _ in range(5)] for _ in range(k % 5 + 1)]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, s array<array<double>>")
    got = {r.k: str(r.m) for r in df.select("k", sg.middle_series(F.col("s")).alias("m")).collect()}
    cells = df.select("k", F.explode("s").alias("s")).select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.median("v").alias("m"))
    assert got == {r.k: str([x.m for x in sorted(r.l)]) for r in cells.groupBy("k").agg(F.collect_list(F.struct("i", "m")).alias("l")).collect()}


def test_chromatograms_are_made_once(spark):
    shape = [max(0.0, 8.0 - 2.0 * abs(k - 10)) for k in range(60)]
    rows = [("w", k, k * 0.1, [100.0 + j for j in range(4)], [float(v * (j + 1)) + 0.5 for j in range(4)]) for k, v in enumerate(shape)]
    scans = spark.createDataFrame(rows, "window string, scan int, rt double, mz_values array<double>, intensities array<double>")
    targets = spark.createDataFrame([("w", 1, j, 100.0 + j, t) for j in range(4) for t in (0.5, 1.0 + j % 2)], "window string, match int, ion int, target_mz double, target_rt double")
    how = {"window": ["window"], "scan": "scan", "time": "rt", "fraction": 0.0, "tolerance": 10}
    out = jobs.chromatogram_job(scans, targets, rt_window=1.0, **how)
    assert "ExistingRDD" not in plan(out) and "LocalTableScan" not in plan(out)
    got = sorted(map(tuple, out.drop("left", "right").collect()))
    assert [r[:2] for r in got] == [("w", 1)] * 4 and {r[-3] for r in got} == {10}
    every = jobs.chromatogram_job(scans, targets, rt_window=INF, **how)  # the same peak, whole axis
    assert sorted(map(tuple, every.drop("left", "right").collect())) == got
    assert jobs.chromatogram_job(scans, targets, rt_window=-1.0, **how).count() == 0


def test_library_tables_are_made_from_rows_of_spectra(spark):
    rng = random.Random(9)
    rows = [(f"P[Oxidation]{'ACDE'[k % 4] * (k % 9 + 1)}", "P", 500.0, k % 3 + 1, 1.0, None, "x", 0, rng.choice([100.0, 200.5, 300.0]), rng.choice([0.5, 0.25, None]), "by"[k % 2], k, 1, "") for k in range(300)]
    rows += [(None, *rows[0][1:]), (*rows[0][:3], None, *rows[0][4:])]
    types = "string string double int double double string int double double string int int string".split()
    lib = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(io.LIBRARY, types, strict=True)))
    key = ["ModifiedPeptide", "PrecursorCharge"]
    ids = {(r[0], r[1]): r[2] for r in io.dense_ids(lib.na.drop(subset=key), key, "n").collect()}
    tables = io.to_library_tables(lib)
    spectra = {(r.peptideModSeq, r.precursorCharge): r for r in tables["RefSpectra"].collect()}
    assert {k: r.RefSpectraID for k, r in spectra.items()} == ids and sorted(ids.values()) == list(range(1, len(ids) + 1))
    assert sum(r.numPeaks for r in spectra.values()) == 300 and tables["LibInfo"].first().numSpecs == len(ids)
    peaks = {r.RefSpectraID: r for r in tables["RefSpectraPeaks"].collect()}
    notes = tables["RefSpectraPeakAnnotations"].collect()
    seen = {}
    for r in rows[:300]:
        seen.setdefault(ids[r[0], r[3]], []).append((r[8], r[9], f"{r[10]}{r[11]}"))
    for n, found in seen.items():
        found.sort(key=lambda f: (f[0], f[1] is not None, f[1] or 0.0))
        assert list(zip(peaks[n].peakMZ, peaks[n].peakIntensity, strict=True)) == [f[:2] for f in found]
        own = sorted((a for a in notes if a.RefSpectraID == n), key=lambda a: a.peakIndex)
        assert [a.peakIndex for a in own] == list(range(len(found))) and [a.mzTheoretical for a in own] == [f[0] for f in found]
        assert {a.name for a in own} == {f[2] for f in found}
    assert tables["Modifications"].count() == tables["RetentionTimes"].count() == len(ids)
    for name in ("RefSpectra", "RefSpectraPeaks", "RefSpectraPeakAnnotations", "Modifications", "RetentionTimes"):
        assert "hashpartitioning" not in plan(tables[name]) and "Sort" not in plan(tables[name])


def test_full_slots_give_dense_ids_too(spark):
    lib = spark.range(500).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("ModifiedPeptide"), F.lit(2).alias("PrecursorCharge"), *[F.lit(1.0).alias(c) for c in io.LIBRARY if c not in ("ModifiedPeptide", "PrecursorCharge")])
    many = io._numbered(io.stored(io.library_spectra(lib)), 0.1)
    assert sorted(r.RefSpectraID for r in many.collect()) == list(range(1, 501))
