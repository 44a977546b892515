import itertools
import random
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from peaklane.operators import aggregates as ag
from peaklane.operators import filters as fl
from peaklane.operators import generate as gen
from peaklane.operators import joins as jn
from peaklane.operators import pairs
from peaklane.operators import sampling as sm
from peaklane.operators import scoring
from peaklane.plans import jobs
from peaklane.sources import io

REPORT = "run string, grp string, item string, v double, q double"


def test_rank_labels_of_two_runs(spark):
    rows = [("Run1", "PROT_A", "AEPTIDEAK|2", 100.0, 0.001), ("Run1", "PROT_A", "AEPTIDEBK|2", 50.0, 0.001), ("Run2", "PROT_A", "AEPTIDEBK|2", 80.0, 0.001)]
    got = jobs.rank_label_job(spark.createDataFrame(rows, REPORT), None, group="grp", item="item", run="run", value="v", q_values=["q"]).filter("a < b").first()
    assert (got.n_pos, got.n_neg, got.label, got.a_detected, got.b_detected) == (1, 1, 0, 1, 1)


def test_missing_confidence_is_kept(spark):
    df = spark.createDataFrame([(1, 0.001), (2, float("nan")), (3, None), (4, 0.02)], "id int, q double")
    assert [r.id for r in fl.confidence_filter(df, ["q"]).orderBy("id").collect()] == [1, 2, 3]


def test_dropped_rows_are_counted(spark):
    seen = Observation("rejects")
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, None, False), (4, True, False)], "id int, w boolean, k boolean")
    kept = fl.conditional_filter(df, F.col("w"), F.col("k"), seen)
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    assert seen.get["dropped"] == 2


def test_votes_are_antisymmetric(spark):
    rows = [(f"r{r}", "g", f"i{i}", float((i * 7 + r * 3) % 5), 0.0) for r in range(4) for i in range(6)]
    v = spark.createDataFrame(rows, REPORT)
    votes = {(r.a, r.b): r for r in ag.vote(jn.rank_pairs(v, v, "grp", "item", "run", "v"), ["grp"]).collect()}
    assert all(votes[a, b].n_pos == votes[b, a].n_neg for a, b in votes)
    assert jn.group_pairs(v, ["grp"], "item").count() == 15


def test_digest_concatenates_to_the_protein(spark):
    proteins = spark.createDataFrame([("A", "AEPTIDEAKAEPTIDEBK"), ("B", "MKPRAX**"), ("C", ""), ("D", None)], "id string, seq string")
    got = {(r.id, r.peptide): r.n_term for r in gen.digest(proteins, ["id"], "seq", "Trypsin", 0, 1, 99).collect()}
    assert got == {("A", "AEPTIDEAK"): True, ("A", "AEPTIDEBK"): False, ("B", "MKPR"): True, ("B", "AX"): False}
    clipped = {r.peptide for r in gen.digest(proteins.filter("id = 'B'"), ["id"], "seq", "Trypsin", 1, 3, 99, clip_m=True).collect()}
    assert clipped == {"MKPR", "KPR", "MKPRAX", "KPRAX"}
    every = {r.peptide for r in gen.digest(spark.createDataFrame([("A", "ABCD")], "id string, seq string"), ["id"], "seq", 0, 0, 2, 3).collect()}
    assert every == {"AB", "BC", "CD", "ABC", "BCD"}


def test_isoforms(spark):
    df = spark.createDataFrame([("MSCM", True)], "p string, n boolean")
    got = [[(m.site, m.name) for m in r.mods] for r in gen.expand_isoforms(df, "p", "n", [("Ox", "M"), ("Ac", "protein-n-term")], [("Cam", "C")], 2).collect()]
    assert len(got) == 1 + 3 + 3 and all((3, "Cam") in g for g in got) and len({tuple(g) for g in got}) == 7


def test_isoforms_by_number(spark):
    """Against all combinations of sites and names, with two names for a site and a fixed one on a variable site."""
    rules, fixed = [("P", "S"), ("G", "S"), ("O", "M"), ("A", "n-term"), ("B", "protein-n-term"), ("C", "n-term")], [("F", "S"), ("F", "C")]
    peptides = [("SMSC", True), ("SMSC", False), ("AAA", False), ("", True), ("SSSSSSSSS", False)]
    df = spark.createDataFrame(peptides, "p string, n boolean")
    for k in (0, 1, 3):
        got = gen.expand_isoforms(df, "p", "n", rules, fixed, k).collect()
        for p, n in peptides:
            options = [(i + 1, name) for i, c in enumerate(p) for name, target in rules if target == c]
            options += [(0, name) for name, target in rules if target == "n-term" or n and target == "protein-n-term"]
            want = []
            for j in range(k + 1):
                for chosen in itertools.combinations(sorted(options), j):
                    if len({s for s, _ in chosen}) == j:
                        free = [(i + 1, name) for i, c in enumerate(p) for name, target in fixed if target == c and i + 1 not in {s for s, _ in chosen}]
                        want.append(sorted([*chosen, *free]))
            assert sorted([(m.site, m.name) for m in r.mods] for r in got if (r.p, r.n) == (p, n)) == sorted(want)
    assert set(got[0].asDict()) == {"p", "n", "mods"}
    long = spark.createDataFrame([("S" * 35, False)], "p string, n boolean")
    assert gen.expand_isoforms(long, "p", "n", [("P", "S")], [], 4).select(F.array_join("mods.site", ",")).distinct().count() == 1 + 35 + 595 + 6545 + 52360


def test_scores_of_several_kinds(spark):
    df = spark.createDataFrame([(k, k % 3 or None) for k in range(40)], "k int, n int").repartition(24)

    def load():
        made = uuid.uuid4().hex
        return lambda frame: {"made": [made] * len(frame), "size": [len(set(frame["n"].fillna(0)))] * len(frame), "list": [[float(x)] * (x % 4) for x in frame["k"]]}

    out = scoring.score_batches(df, None, {"made": "string", "size": "int", "list": "array<double>"}, "n", 5, factory=load)
    rows = out.collect()
    assert sorted(r.k for r in rows) == list(range(40)) and all(r.size == 1 and r.list == [float(r.k)] * (r.k % 4) for r in rows)
    assert len({r.made for r in rows}) <= 8  # once a worker, not once a partition
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.v for r in scoring.score_batches(df, lambda f: f["k"] * 2.0, "v", "n").collect()} == {k: k * 2.0 for k in range(40)}
    with pytest.raises(ValueError):
        scoring.score_batches(df, len, "k", "n")
    with pytest.raises(Exception, match="1 values"):
        scoring.score_batches(df, lambda f: [1.0], "v", "n").collect()


def test_band_join_has_no_nested_loop(spark):
    a = spark.createDataFrame([(1, 500.0), (2, 500.02), (3, 900.0)], "k int, t double")
    b = spark.createDataFrame([(500.004,), (500.03,), (1.0,)], "p double")
    out = jn.band_join(a, b, "t", "p", 30)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.p) for r in out.collect()) == [(1, 500.004), (2, 500.03)]


def test_binomial_consensus(spark):
    df = spark.createDataFrame([(9, 1), (1, 9), (5, 5), (0, 0)], "n_pos long, n_neg long")
    assert [r.label for r in ag.consensus(df, "binomial", 0.05).collect()] == [1, 0, None, 1]


def test_split_shares_no_sequence(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 40).cast("string").alias("seq"))
    rows = sm.leakage_free_split(df, "seq", "k", 7).collect()
    train, test = ({r.seq for r in rows if r.part == p} for p in ("train", "test"))
    assert test and (not train & test or test == {str(i) for i in range(40)})


def test_library_tables(spark):
    row = ("PEPTIDE[57.02]K", "PEPTIDEK", 500.25, 2, 10.5, 1.2345, "P1", 0)
    rows = [row + (100.0 + i, 1.0 / (i + 1), "b", i + 1, 1, "") for i in range(5)]
    types = "string string double int double double string int double double string int int string".split()
    lib = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(io.LIBRARY, types, strict=True)))
    tables = io.to_library_tables(lib)
    spectrum = tables["RefSpectra"].first()
    assert (spectrum.numPeaks, spectrum.ionMobility, spectrum.ionMobilityType, spectrum.collisionalCrossSectionSqA, spectrum.retentionTime) == (5, 1.2345, 2, None, 10.5)
    assert tables["Modifications"].first().position == 7 and {r.id for r in tables["IonMobilityTypes"].collect()} == {0, 1, 2, 3}


def test_melt_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        gen.melt_fragments(spark.range(1).withColumn("q_z1", F.lit(1.0)), ["id"], ["q_z1"])


def test_fasta_headers_may_hold_the_sign_that_begins_records(spark, tmp_path):
    text = ">sp|A|B 3'->5' exonuclease\r\nMKV\r\nLL\r\n>x second > more\nAC\n\n>y\n"
    (tmp_path / "a.fasta").write_bytes(text.encode())
    got = sorted(tuple(r) for r in io.read_fasta(spark, str(tmp_path / "a.fasta")).collect())
    assert got == [("sp|A|B", "sp|A|B 3'->5' exonuclease", "MKVLL"), ("x", "x second > more", "AC"), ("y", "y", "")]


def test_peptide_index_goes_by_file_and_row(spark, tmp_path):
    for k, rows in enumerate([["B\t2", "A\t1"], ["A\t3", "C\t4", "C\t5"]]):
        (tmp_path / f"part-{k}.tsv").write_text("peptide\tproteins\n" + "\n".join(rows) + "\n")
    assert sorted(tuple(r) for r in io.read_peptide_index(spark, str(tmp_path)).collect()) == [("A", "1"), ("B", "2"), ("C", "4")]


def test_pair_runs_agree_with_rank_pairs_and_votes(spark):
    rng = random.Random(3)
    rows = [(g, i, r, float(rng.randrange(4))) for g in "xyz" for i in range(5) for r in range(4) if rng.random() < 0.6]
    values = spark.createDataFrame([*rows, rows[0]], "g string, i int, r int, v double")
    others = spark.createDataFrame([(g, i) for g in "xy" for i in range(3, 8)], "g string, i int")
    best = {}
    for g, i, r, v in rows:
        best[g, i, r] = max(v, best.get((g, i, r), 0.0))
    detected = {(g, i) for g, i, _, _ in rows}
    partners = detected | {(g, i) for g in "xy" for i in range(3, 8)}
    want = {(g, r, a, b, best.get((g, a, r), 0.0), best.get((g, b, r), 0.0)) for g, a in detected for h, b in partners if g == h and a != b for r in range(4) if (g, a, r) in best or (g, b, r) in best}
    long = jn.rank_pairs(values, others, "g", "i", "r", "v")
    assert {tuple(r) for r in long.select("g", "r", "a", "b", "va", "vb").collect()} == want and long.count() == len(want)
    names = ["g", "a", "b", "n_pos", "n_neg", "a_detected", "b_detected", "both_detected"]
    votes = pairs.pair_votes(values, others, "g", "i", "r", "v", tile=2)
    # an undetected partner without values has a row too, with the other item's runs
    assert sorted(map(tuple, votes.select(names).collect())) == sorted(map(tuple, ag.vote(long, ["g"]).select(names).collect()))
    whole = pairs.pair_votes(values, others, "g", "i", "r", "v")
    assert sorted(map(tuple, whole.select(names).collect())) == sorted(map(tuple, votes.select(names).collect()))


def test_votes_of_odd_values(spark):
    nan = float("nan")
    rows = [("g", "a", 1, nan), ("g", "a", 2, -1.0), ("g", "b", 1, nan), ("g", "b", 2, None), ("g", "c", 3, float("inf")), ("g", "c", 1, 2.0), (None, "a", 1, 1.0), (None, "b", 1, 2.0), ("h", "x", None, 3.0), ("h", "y", None, 4.0)]
    v = spark.createDataFrame(rows, "g string, i string, r int, v double")
    got = {(r.g, r.a, r.b): tuple(r)[3:] for r in pairs.pair_votes(v, v.limit(0), "g", "i", "r", "v").collect()}
    assert got == {
        ("g", "a", "b"): (0, 1, 0, 0, 1), ("g", "b", "a"): (1, 0, 0, 0, 1), ("g", "a", "c"): (1, 2, 1, 1, 1), ("g", "c", "a"): (2, 1, 1, 1, 1),
        ("g", "b", "c"): (1, 1, 1, 1, 1), ("g", "c", "b"): (1, 1, 1, 1, 1), ("h", "x", "y"): (0, 1, 1, 1, 1), ("h", "y", "x"): (1, 0, 1, 1, 1),
    }
    assert pairs.pair_votes(v.limit(0), v, "g", "i", "r", "v").count() == 0


def test_chromatogram_job_finds_a_peak(spark):
    """Four ions rise and fall together around scan 10, one is noise on the other side."""
    shape = [max(0.0, 8.0 - 2.0 * abs(k - 10)) for k in range(21)]
    rows = [("w", k, k * 0.1, [100.0 + j for j in range(5)], [float(v * (j + 1)) + 0.5 for j in range(4)] + [9.0 - v]) for k, v in enumerate(shape)]
    scans = spark.createDataFrame(rows, "window string, scan int, rt double, mz_values array<double>, intensities array<double>")
    targets = spark.createDataFrame([("w", 1, j, 100.0 + j, 1.0) for j in range(5)], "window string, match int, ion int, target_mz double, target_rt double")
    got = jobs.chromatogram_job(scans, targets, window=["window"], scan="scan", time="rt", fraction=0.0, tolerance=10, rt_window=5.0).collect()
    assert {r.ion for r in got} == set(range(5)) and {(r.apex, r.left < 10 < r.right) for r in got} == {(10, True)}
    assert all(r.best_ion < 4 for r in got) and all((r.cor > 0.99) == (r.ion < 4) for r in got)
