"""Composed jobs (K) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from peaklane.functions.constants import PROTON
from peaklane.operators import generate as gen
from peaklane.operators import scoring
from peaklane.plans import jobs
from peaklane.plans import tables as tb
from peaklane.plans.queries_aggregates import _CENTER, _COS
from peaklane.plans.queries_signal import _order
from peaklane.plans.queries_sources import _scratch
from peaklane.plans.registry import query
from peaklane.sources import io

_K1 = f"""WITH rep AS ({tb.REPORT_SQL}), ok AS (SELECT grp, item, run, max(v) AS v FROM rep WHERE NOT (q1 > 0.02 OR q2 > 0.02) GROUP BY ALL),
one AS (SELECT item FROM ok GROUP BY item HAVING count(DISTINCT grp) = 1), two AS (SELECT grp FROM ok WHERE item IN (SELECT item FROM one) GROUP BY grp HAVING count(DISTINCT item) >= 2),
v AS (SELECT * FROM ok WHERE item IN (SELECT item FROM one) AND grp IN (SELECT grp FROM two)), found AS (SELECT DISTINCT grp, item FROM v), d AS (SELECT grp, count(*) AS d FROM found GROUP BY grp),
u AS (SELECT grp, item, d, row_number() OVER (PARTITION BY grp ORDER BY {_order('item', 7)}, item) AS r FROM (SELECT p_brand || '|' || p_type AS grp, p_partkey AS item FROM part) JOIN d USING (grp) WHERE item NOT IN (SELECT item FROM found)),
o AS (SELECT grp, item FROM u WHERE r <= greatest(ceil((d - 1) / 2.0 / 2), 1) UNION SELECT grp, item FROM found), p AS (SELECT x.grp, x.item AS a, y.item AS b FROM found x JOIN o y ON x.grp = y.grp AND x.item <> y.item),
r AS (SELECT p.grp, a, b, run FROM p JOIN v ON v.grp = p.grp AND v.item IN (a, b) GROUP BY ALL),
w AS (SELECT r.grp, r.a, r.b, coalesce(x.v, 0) AS va, coalesce(y.v, 0) AS vb FROM r LEFT JOIN v x ON x.grp = r.grp AND x.item = r.a AND x.run = r.run LEFT JOIN v y ON y.grp = r.grp AND y.item = r.b AND y.run = r.run),
n AS (SELECT grp, a, b, count(*) FILTER (WHERE va > vb) AS n_pos, count(*) FILTER (WHERE va < vb) AS n_neg, max((va <> vb AND va > 0)::INT) AS a_detected, max((va <> vb AND vb > 0)::INT) AS b_detected, max((va > 0 AND vb > 0)::INT) AS both_detected FROM w GROUP BY ALL)
SELECT *, (n_pos > n_neg)::INT AS label FROM n"""


@query("k01_rank_label_job", _K1)
def _(spark, t):
    known = t("part").select(F.concat_ws("|", "p_brand", "p_type").alias("grp"), F.col("p_partkey").alias("item"))
    return jobs.rank_label_job(tb.report(t), known, group="grp", item="item", run="run", value="v", q_values=["q1", "q2"], limit=0.02)


#: Benchmark items as proteins; their peptides as detected in three runs or not, by arithmetic on item, length and run.
_K1_FILES = f"""WITH s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark), p AS (SELECT DISTINCT item_id, unnest(string_split(replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), '|P', 'P'), '|')) AS pep FROM s),
c AS (SELECT item_id, pep, length(pep) AS l FROM p WHERE length(pep) BETWEEN 7 AND 35), ok AS (SELECT item_id, pep, pep || '|' || (2 + l % 2) AS form, run, (l * 37 + item_id * 11 + run * 13) % 50 + 1.0 AS v FROM c, range(3) t(run) WHERE (l + run + item_id) % 3 <> 0 AND (l + run) % 10 <= 5),
one AS (SELECT pep FROM ok GROUP BY pep HAVING count(DISTINCT item_id) = 1), two AS (SELECT item_id FROM ok WHERE pep IN (SELECT pep FROM one) GROUP BY item_id HAVING count(DISTINCT pep) >= 2),
v AS (SELECT * FROM ok WHERE pep IN (SELECT pep FROM one) AND item_id IN (SELECT item_id FROM two)), found AS (SELECT DISTINCT item_id, pep FROM v), d AS (SELECT item_id, count(*) AS d FROM found GROUP BY item_id),
own AS (SELECT pep FROM c GROUP BY pep HAVING count(DISTINCT item_id) = 1), n AS (SELECT item_id, pep, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(pep, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: (a * 31 + b) % 1000003) AS k FROM c WHERE pep IN (SELECT pep FROM own)),
u AS (SELECT n.item_id, n.pep, d, row_number() OVER (PARTITION BY n.item_id ORDER BY {_order('k', 7)}, k) AS r FROM n JOIN d ON d.item_id = n.item_id ANTI JOIN found ON found.item_id = n.item_id AND found.pep = n.pep),
o AS (SELECT item_id, pep || '|' || z AS form FROM u, (VALUES (2), (3)) t(z) WHERE r <= greatest(ceil((d - 1) / 2.0 / 2), 1) UNION SELECT item_id, form FROM v),
q AS (SELECT DISTINCT x.item_id, x.form AS a, y.form AS b FROM v x JOIN o y ON x.item_id = y.item_id AND x.form <> y.form), r AS (SELECT DISTINCT q.item_id, a, b, run FROM q JOIN v ON v.item_id = q.item_id AND v.form IN (a, b)),
w AS (SELECT r.*, coalesce(x.v, 0) AS va, coalesce(y.v, 0) AS vb FROM r LEFT JOIN v x ON x.item_id = r.item_id AND x.form = a AND x.run = r.run LEFT JOIN v y ON y.item_id = r.item_id AND y.form = b AND y.run = r.run),
e AS (SELECT item_id, a, b, count(*) FILTER (WHERE va > vb) AS n_pos, count(*) FILTER (WHERE va < vb) AS n_neg, max((va > 0 AND vb > 0)::INT) AS both_detected FROM w GROUP BY ALL)
SELECT e.item_id, a || ':' || b AS pair, n_pos, n_neg, both_detected, (n_pos > n_neg)::INT AS label, round(t.total, 4) AS intensity FROM e JOIN (SELECT item_id, sum(v) AS total FROM v GROUP BY item_id) t ON t.item_id = e.item_id"""


@query("k01_rank_label_files", _K1_FILES)
def _(spark, t):
    path = _scratch(spark)
    proteins = t("benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    seen = gen.digest(proteins, ["item_id"], "seq", "Trypsin", 0, 7, 35).withColumn("l", F.length("peptide")).withColumn("run", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    seen = seen.filter((F.col("l") + F.col("run") + F.col("item_id")) % 3 != 0)
    report = seen.select("item_id", "peptide", (F.col("l") % 2 + 2).alias("z"), "run", ((F.col("l") * 37 + F.col("item_id") * 11 + F.col("run") * 13) % 50 + 1.0).alias("v"), ((F.col("l") + F.col("run")) % 10 / 100).alias("q"))
    jobs.rank_label_files_job(report, proteins, path, group="item_id", peptide="peptide", charge="z", run="run", value="v", q_values=["q"], sequence="seq", limit=0.05, missed=0, min_len=7, max_len=35)
    read = lambda name, schema: spark.read.option("sep", "\t").option("header", True).schema(schema).csv(f"{path}/{name}")
    pairs = read("pairs", "item_id long, a string, b string, n_pos long, n_neg long, a_detected int, b_detected int, both_detected int")
    labels = read("consensus", "item_id long, pair string, label int")
    totals = read("intensities", "item_id long, form string, run int, v double").groupBy("item_id").agg(F.round(F.sum("v"), 4).alias("intensity"))
    return pairs.withColumn("pair", F.concat_ws(":", "a", "b")).join(labels, ["item_id", "pair"]).join(totals, "item_id").select("item_id", "pair", "n_pos", "n_neg", "both_detected", "label", "intensity")


@query("k02_rank_pairs_job", """WITH s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark), p AS (SELECT DISTINCT item_id, unnest(string_split(replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), '|P', 'P'), '|')) AS pep FROM s),
f AS (SELECT item_id, pep || '|' || z AS form FROM p, (VALUES (2), (3)) t(z) WHERE length(pep) BETWEEN 7 AND 35) SELECT x.item_id, x.form AS a, y.form AS b, x.form || ':' || y.form AS pair FROM f x JOIN f y ON x.item_id = y.item_id AND x.form < y.form""")
def _(spark, t):
    proteins = t("benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return jobs.rank_pairs_job(proteins, proteins, group="item_id", sequence="seq", low=2, high=3, missed=0, min_len=7, max_len=35)


@query("k03_rt_table_job", f"""WITH e AS (SELECT * FROM ({tb.EVENTS_SQL})), s AS (SELECT min(sec) AS lo, max(sec) AS hi, count(DISTINCT user_id) AS n_runs FROM e), f AS (SELECT * FROM e WHERE value <= 60 AND event_type <> 'signup' AND (event_type <> 'error' OR value >= 5)),
m AS (SELECT user_id, event_type, avg(sec) AS sec, count(sec) AS n FROM f GROUP BY ALL) SELECT user_id, event_type, round(sec, 4) AS sec, n, round((sec - lo) / (hi - lo), 6) AS rt_norm, n_runs FROM m, s""")
def _(spark, t):
    mapped = t("events").select("event_type").filter("event_type <> 'signup'").distinct()
    rows, meta = jobs.rt_table_job(tb.events(t), mapped, keys=["user_id", "event_type"], rt="sec", run="user_id", q="value", cutoff=60, when=F.col("event_type") == "error", keep=F.col("value") >= 5, modification="event_type")
    path = _scratch(spark)
    io.write_run_meta(meta, "user_id", path)
    runs = io.read_run_meta(spark, path, "user_id", "rt_min long, rt_max long").agg(F.count("*").alias("n_runs"))
    return rows.crossJoin(F.broadcast(runs)).select("user_id", "event_type", F.round("sec", 4).alias("sec"), "n", F.round("rt_norm", 6).alias("rt_norm"), "n_runs")  # one row


_K4 = f"""WITH d AS (SELECT doc_id AS row, n_chars AS mz, length(lang) + doc_id % 7 AS number, n_chars % 97 AS intensity FROM documents), p AS (SELECT o_orderkey AS id, o_custkey AS s, o_custkey + 1 + o_orderkey % 6 AS e FROM orders),
x AS (SELECT p.id, d.* FROM p JOIN d ON d.row >= p.s AND d.row < p.e WHERE intensity > 0 AND mz BETWEEN 200 AND 9000 AND number >= 3), k AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz, number) AS r FROM k WHERE c >= 2)
SELECT 'P' || id AS ModifiedPeptide, count(*) AS n, sum(mz)::BIGINT AS mz, sum(intensity)::BIGINT AS intensity, max(o_orderstatus) AS ProteinID, round(max(o_totalprice) / 1000, 2) AS rt FROM r JOIN orders ON o_orderkey = id WHERE r <= 3 GROUP BY id"""


@query("k04_library_job", _K4)
def _(spark, t):
    o = t("orders")
    pep = F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))
    precursors = o.select(F.col("o_orderkey").alias("pepID"), F.lit(2).alias("charge"), pep.alias("sequence"), pep.alias("modified"), F.lit(500.0).alias("mz"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 6).alias("stop"))
    rows = t("documents").select(F.col("doc_id").alias("row"), F.col("n_chars").alias("frag_mz"), (F.length("lang") + F.col("doc_id") % 7).alias("number"), (F.col("n_chars") % 97).alias("intensity"), F.lit("b").alias("ion"), F.lit(1).alias("frag_charge"), F.lit("").alias("loss"))
    rt = o.select(F.col("o_orderkey").alias("pepID"), (F.col("o_totalprice") / 1000).alias("rt"))
    mobility = o.select(F.col("o_orderkey").alias("pepID"), F.lit(2).alias("charge"), F.lit(0.5).alias("mobility"))
    proteins = o.select(pep.alias("sequence"), F.col("o_orderstatus").alias("proteins"))
    lib = jobs.build_library(precursors, rows, rt, mobility, proteins, top=3, mz_min=200, mz_max=9000, min_number=3, min_n=2)
    return lib.groupBy("ModifiedPeptide").agg(F.count("*").alias("n"), F.sum("FragmentMz").alias("mz"), F.sum("RelativeIntensity").alias("intensity"), F.max("ProteinID").alias("ProteinID"), F.round(F.max("Tr_recalibrated"), 2).alias("rt"))


_K4_FILES = f"""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS number, max(l_quantity) AS q, max(l_tax) AS t, max(l_discount) AS d, max(l_extendedprice) AS e FROM lineitem GROUP BY ALL),
x AS (SELECT id, number, 'b' AS ion, '' AS loss, q / 50 AS i, e / 100 AS mz FROM l UNION ALL SELECT id, number, 'y', '', t, e / 100 + 1 FROM l UNION ALL SELECT id, number, 'y', 'modloss', d, e / 100 + 2 FROM l),
k AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM x WHERE i > 0 AND mz BETWEEN 50 AND 400 AND number BETWEEN 2 AND 7), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC, mz, ion, number) AS r FROM k WHERE c >= 2),
g AS (SELECT id, count(*) AS n, round(sum(mz), 4) AS mz, sum((loss = 'modloss')::INT) AS n_loss, min(printf('%.4f', i)) AS least FROM r WHERE r <= 4 GROUP BY id)
SELECT replace('MPEP' || translate(id::VARCHAR, '0123456789', 'ACDEFGHIKL'), 'M', CASE WHEN id % 2 = 0 THEN 'M[15.99491461956]' ELSE 'M' END) AS ModifiedPeptide, n, mz, n_loss::BIGINT AS n_loss, least, n AS numPeaks, n AS n_annotations, (id % 2 = 0)::INT AS n_mods, o_orderstatus AS protein FROM g JOIN orders ON o_orderkey = id"""


@query("k04_library_files", _K4_FILES)
def _(spark, t):
    path = _scratch(spark)
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(f"l_{c}").alias(c) for c in ("quantity", "tax", "discount", "extendedprice")])
    at = [(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.col("l_linenumber").alias("number")]
    ions = ["b_z1", "y_z1", "y_modloss_z1"]
    masses = lines.select(*at, *[(F.col("extendedprice") / 100 + k).alias(c) for k, c in enumerate(ions)])
    intensities = lines.select(*at, (F.col("quantity") / 50).alias(ions[0]), F.col("tax").alias(ions[1]), F.col("discount").alias(ions[2]))
    pep = F.concat(F.lit("MPEP"), F.translate(F.col("o_orderkey").cast("string"), "0123456789", "ACDEFGHIKL"))
    key = F.col("o_orderkey").alias("pepID")
    mods = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("Oxidation").alias("name"), F.lit(1).alias("site")))).otherwise(F.array().cast("array<struct<name:string,site:int>>"))
    o = t("orders")
    precursors = o.select(key, F.lit(2).alias("charge"), pep.alias("sequence"), mods.alias("mods"), F.lit(500.0).alias("mz"), (F.col("o_orderkey") * 8 + 1).alias("start"), (F.col("o_orderkey") * 8 + 8).alias("stop"))
    rt, mobility = o.select(key, (F.col("o_totalprice") / 1000).alias("rt")), o.select(key, F.lit(2).alias("charge"), F.lit(0.5).alias("mobility"))
    jobs.library_files_job(precursors, masses, intensities, rt, mobility, o.select(pep.alias("sequence"), F.col("o_orderstatus").alias("proteins")), path, ions=ions, names={"Oxidation": "15.99491461956"}, top=4, mz_min=50, mz_max=400, min_number=2, min_n=2)
    flat = spark.read.parquet(f"{path}/flat").groupBy("ModifiedPeptide").agg(F.count("*").alias("n"), F.round(F.sum("FragmentMz"), 4).alias("mz"), F.count_if(F.col("FragmentLossType") == "modloss").alias("n_loss"))
    text = spark.read.option("sep", "\t").option("header", True).csv(f"{path}/text").groupBy("ModifiedPeptide").agg(F.min("RelativeIntensity").alias("least"))
    table = lambda n: spark.read.parquet(f"{path}/tables/{n}")
    count = lambda n, c: table(n).groupBy("RefSpectraID").agg(F.count("*").alias(c))
    spectra = table("RefSpectra").select("RefSpectraID", F.col("peptideModSeq").alias("ModifiedPeptide"), "numPeaks", "protein")
    spectra = spectra.join(count("RefSpectraPeakAnnotations", "n_annotations"), "RefSpectraID").join(count("Modifications", "n_mods"), "RefSpectraID", "left").na.fill(0, ["n_mods"])
    return flat.join(text, "ModifiedPeptide").join(spectra, "ModifiedPeptide").select("ModifiedPeptide", "n", "mz", "n_loss", "least", "numPeaks", "n_annotations", F.col("n_mods").cast("int").alias("n_mods"), "protein")


_K5 = f"""WITH p AS (SELECT pep, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id::VARCHAR) AS proteins FROM ({tb.PEPTIDES_SQL}) WHERE pep NOT LIKE '%X%' GROUP BY pep),
d AS (SELECT pep AS peptide, proteins, 0 AS decoy FROM p UNION ALL SELECT pep[1] || reverse(pep[2:length(pep)-1]) || pep[length(pep)], proteins, 1 FROM p),
c AS (SELECT peptide, proteins, decoy, list_filter(range(1, length(peptide) + 1), lambda i: peptide[i] = 'C') AS cs FROM d),
o AS (SELECT *, 0 AS ox FROM c UNION ALL SELECT *, unnest(list_filter(range(1, length(peptide) + 1), lambda i: peptide[i] = 'M')) FROM c),
w AS (SELECT peptide, sum(coalesce(m, 0)) AS mass FROM (SELECT DISTINCT peptide, unnest(range(1, length(peptide) + 1)) AS i FROM d) LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in gen.RESIDUE_MASS.items())}) r(c, m) ON r.c = peptide[i] GROUP BY peptide)
SELECT o.peptide, decoy, proteins, z AS charge, array_to_string(list_transform(list_sort(list_transform(cs, lambda i: [i, 0]) || CASE WHEN ox > 0 THEN [[ox, 1]] ELSE [] END), lambda x: x[1] || ':' || ['Carbamidomethyl', 'Oxidation'][x[2] + 1]), ';') AS mods,
       round((mass + {gen.WATER} + len(cs) * 57.02146372057 + (ox > 0)::INT * 15.99491461956 + z * {PROTON}) / z, 5) AS mz
FROM o JOIN w ON w.peptide = o.peptide CROSS JOIN (VALUES (2), (3)) t(z)"""


@query("k05_peptide_list_job", _K5)
def _(spark, t):
    rows = jobs.peptide_list_job(tb.proteins(t).withColumn("doc_id", F.col("doc_id").cast("string")), key="doc_id", sequence="seq", low=2, high=3, variable=[("Oxidation", "M")], fixed=[("Carbamidomethyl", "C")], k=1, mz_min=0, mz_max=10000, mod_masses={"Oxidation": 15.99491461956, "Carbamidomethyl": 57.02146372057}, missed=0, min_len=7, max_len=12)
    mods = F.array_join(F.transform("mods", lambda m: F.concat(m["site"].cast("string"), F.lit(":"), m["name"])), ";")
    return rows.select("peptide", "decoy", "proteins", "charge", mods.alias("mods"), F.round("mz", 5).alias("mz"))


@query("k06_chromatogram_job")
def _(spark, t):
    e = tb.events(t).withColumn("mz", F.col("user_id") * 1.0).withColumn("hour", F.floor(F.col("sec") / 3600))
    scans = e.groupBy("event_type", F.col("hour").alias("scan")).agg(F.array_sort(F.collect_list(F.struct("mz", "value"))).alias("p"), (F.min("sec") / 60).alias("rt"))
    scans = scans.select("event_type", "scan", "rt", F.col("p.mz").alias("mz_values"), F.col("p.value").alias("intensities"))
    targets = e.groupBy("event_type", "user_id").agg((F.max_by("sec", "value") / 60).alias("target_rt"))
    wide = targets.select("event_type", F.col("user_id").alias("match"), "target_rt", F.explode(F.array(*[F.struct(F.lit(k).alias("ion"), ((F.col("user_id") + k * 7) % 150 * 1.0).alias("target_mz")) for k in range(4)])).alias("i"))
    found = jobs.chromatogram_job(scans, wide.select("event_type", "match", "target_rt", "i.*"), window=["event_type"], scan="scan", time="rt", fraction=0.01, tolerance=400, rt_window=1440.0)
    return found.withColumn("cor", F.round("cor", 4)).withColumn("min_smoothed", F.round("min_smoothed", 2))


def _k7(share: float) -> str:
    values = f"list_transform(range(0, len(x)), lambda i: x[i + 1] * (1 - {share} - vec_id % 3 * 0.1) + sin(i) * ({share} + vec_id % 3 * 0.1))"
    valid = "list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i] <= 0), lambda i: {0}[i])"
    return f"""SELECT vec_id, pcc, cos, 1 - 2 * acos(least(cos, 1.0)) / pi() AS sa FROM (SELECT vec_id, {_COS} AS cos FROM (SELECT vec_id, {valid.format("x")} AS x, {valid.format("y")} AS y FROM (SELECT vec_id, x, {values} AS y FROM test)))
JOIN (SELECT vec_id, {_COS} AS pcc FROM (SELECT vec_id, {_CENTER.format("x")} AS x, {_CENTER.format("y")} AS y FROM (SELECT vec_id, {valid.format("x")} AS x, {valid.format("y")} AS y FROM (SELECT vec_id, x, {values} AS y FROM test)))) USING (vec_id)"""


_K7 = f"""WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY {_order("vec_id", 7)}, vec_id) AS r, count(*) OVER () AS n FROM embeddings),
test AS (SELECT vec_id, x FROM o WHERE r > n - greatest(1, least(1000, ceil(n * 0.1) - 10))), b AS ({_k7(0.5)}), c AS ({_k7(0.2)}),
bm AS (SELECT metric, median(v) AS base FROM (UNPIVOT b ON pcc, cos, sa INTO NAME metric VALUE v) GROUP BY metric),
cm AS (SELECT metric, median(v) AS candidate, count(v) AS n, avg(v) AS mean, min(v) AS lowest, max(v) AS highest, count(*) FILTER (WHERE v > 0.9) / count(*) AS above_90 FROM (UNPIVOT c ON pcc, cos, sa INTO NAME metric VALUE v) GROUP BY metric)
SELECT metric, round(base, 5) AS base, round(candidate, 5) AS candidate, n, round(mean, 5) AS mean, round(lowest, 5) AS lowest, round(highest, 5) AS highest, round(above_90, 5) AS above_90,
(SELECT bool_and(candidate > base) FROM bm JOIN cm USING (metric)) AS candidate_wins, (SELECT count(*) < 100 FROM embeddings) AS skipped, round(candidate, 5) AS manifest FROM bm JOIN cm USING (metric)"""


@query("k07_evaluation_job", _K7)
def _(spark, t):
    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("observed")).withColumns({"length": F.size("observed"), "valid": F.col("observed")})

    def noisy(share: float):
        def score(df):
            told = scoring.score_batches(df, lambda frame: share + frame["vec_id"] % 3 * 0.1, "share", "length")
            return told.withColumn("predicted", F.transform("observed", lambda x, i: x * (1 - F.col("share")) + F.sin(i.cast("double")) * F.col("share")))

        return score

    found = jobs.evaluation_job(rows, noisy(0.5), noisy(0.2), sequence="vec_id", key="vec_id", observed="observed", predicted="predicted", seed=7, mask="valid")
    old = found.select(F.lit("m").alias("model"), F.lit("test").alias("stage"), "metric", F.col("base").alias("value"))
    manifest = jobs.evaluation_manifest(old, found, "m", "test").select("metric", F.col("value").alias("manifest"))
    return found.join(manifest, "metric").withColumns({c: F.round(c, 5) for c in ("base", "candidate", "mean", "lowest", "highest", "above_90", "manifest")})
