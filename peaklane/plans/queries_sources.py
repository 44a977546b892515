"""Sources and sinks (S) over the given tables: what is written to a scratch folder is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklane.operators.stored import shared_folder as _scratch
from peaklane.plans import tables as tb
from peaklane.plans.registry import query
from peaklane.sources import io


def _library(t) -> DataFrame:
    """Lines as library rows: orders are precursors, lines fragments."""
    lines = t("lineitem").repartition("l_orderkey")  # one shuffle for the groups and for the join
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("mz"), F.max("l_quantity").alias("i"), F.min("l_returnflag").alias("f"))
    rows = rows.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderstatus"), "l_orderkey")
    pep = F.concat(F.lit("PEP"), F.translate(F.col("l_orderkey").cast("string"), "0123456789", "ACDEFGHIKL"))
    return rows.select(
        pep.alias("ModifiedPeptide"), pep.alias("StrippedPeptide"), F.round(F.col("o_totalprice") / 100, 2).cast("float").alias("PrecursorMz"), F.lit(2).alias("PrecursorCharge"),
        F.round(F.col("o_totalprice") / 5000, 2).cast("float").alias("Tr_recalibrated"), F.lit(0.5).cast("float").alias("IonMobility"), F.col("o_orderstatus").alias("ProteinID"), F.lit(0).alias("Decoy"),
        F.round("mz", 2).cast("float").alias("FragmentMz"), F.col("i").cast("float").alias("RelativeIntensity"), F.when(F.col("f") == "A", "b").otherwise("y").alias("FragmentType"), F.col("l_linenumber").alias("FragmentNumber"), F.lit(1).alias("FragmentCharge"), F.lit("").alias("FragmentLossType"),
    )


_LIB = """SELECT 'PEP' || translate(l_orderkey::VARCHAR, '0123456789', 'ACDEFGHIKL') AS pep, o_orderstatus AS prot, l_linenumber AS number, max(l_quantity) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber, o_orderstatus"""


@query("s01_read_fasta", f"SELECT 'doc' || doc_id AS accession, length(seq) AS n, md5(seq) AS digest FROM ({tb.PROTEINS_SQL})")
def _(spark, t):
    path = _scratch(spark)
    lines = tb.proteins(t).select(F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" a 3'->5' record\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    lines.write.text(path)
    return io.read_fasta(spark, path).select("accession", F.length("sequence").alias("n"), F.md5("sequence").alias("digest"))


@query("s02_read_tsv_report", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark, t):
    path = _scratch(spark) + ".tsv"
    t("part").select("p_partkey", "p_name", "p_size").write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return io.read_report(spark, path, schema="p_partkey long, p_name string, p_size int")


@query("s03_read_parquet_report", "SELECT l_orderkey AS Run_Index, l_quantity AS \"Value\" FROM lineitem")
def _(spark, t):
    path = _scratch(spark)
    t("lineitem").select(F.col("l_orderkey").alias("Run.Index"), F.col("l_quantity").alias("Value"), "l_tax").write.parquet(path)
    return io.read_report(spark, path, columns=["Run.Index", "Value"])


@query("s04_canonicalize_report", "SELECT p_partkey AS charge, p_name AS peptide, p_brand AS run FROM part")
def _(spark, t):
    theirs = t("part").select(F.col("p_partkey").alias("Precursor.Charge"), F.col("p_name").alias("Stripped.Sequence"), F.col("p_brand").alias("File.Name"))
    return io.canonicalize_report(theirs, "diann").select("charge", "peptide", "run")


@query("s05_read_precursor_table", f"SELECT 2 AS charge, replace(pep, 'M', 'M(UniMod:35)') AS modified, pep AS peptide FROM ({tb.PEPTIDES_SQL})")
def _(spark, t):
    path = _scratch(spark)
    rows = tb.peptides(t).select(F.lit(2).alias("Precursor Charge"), F.replace("peptide", F.lit("M"), F.lit("M(UniMod:35)")).alias("Peptide Modified Sequence Unimod Ids"))
    rows.write.option("header", True).csv(path)
    return io.read_precursor_table(spark, path)


@query("s06_read_scans", "SELECT vec_id::INT AS index, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def _(spark, t):
    path = _scratch(spark)
    scans = t("embeddings").select(F.col("vec_id").cast("int").alias("index"), F.transform("embedding", lambda x, i: i.cast("float")).alias("mz_values"), F.col("embedding").cast("array<float>").alias("intensities"), *[F.lit(1.0).alias(c) for c in ("precursor_rt", "precursor_im", "collision_energy", "isolation_mz", "isolation_width")])
    scans.write.parquet(path)
    return io.read_scans(spark, path).select("index", F.round(F.aggregate("intensities", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s07_read_xic_json", f"SELECT user_id::INT AS id, count(*) AS n, round(sum(v), 2) AS total FROM ({tb.DAILY_SQL}) GROUP BY user_id")
def _(spark, t):
    path = _scratch(spark)
    tb.series(t).select(F.col("user_id").cast("int").alias("id"), F.array("values").alias("fragment_intensities"), F.array(F.lit("y1")).alias("fragment_labels")).write.json(path)
    return io.read_xic_json(spark, path).select("id", F.size(F.col("fragment_intensities")[0]).cast("long").alias("n"), F.round(F.aggregate(F.col("fragment_intensities")[0], F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("s08_first_row_per_key", "SELECT p_name AS peptide, arg_min(p_brand, p_partkey) AS proteins FROM part GROUP BY p_name")
def _(spark, t):
    return io.first_by(t("part").select(F.col("p_name").alias("peptide"), F.col("p_brand").alias("proteins"), "p_partkey"), "peptide", "proteins", "p_partkey")


@query("s08_read_peptide_index", "SELECT p_name AS peptide, arg_min(p_brand, p_partkey) AS proteins FROM part GROUP BY p_name")
def _(spark, t):
    path = _scratch(spark)
    t("part").select("p_name", "p_brand", "p_partkey").repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.option("sep", "\t").option("header", True).csv(path)
    return io.read_peptide_index(spark, path)


@query("s09_write_library", f"SELECT pep AS ModifiedPeptide, number AS FragmentNumber, i::FLOAT AS RelativeIntensity, printf('%.4f', i) AS shown FROM ({_LIB})")
def _(spark, t):
    path = _scratch(spark)
    lib = _library(t)
    io.write_library(lib, f"{path}/flat")
    io.write_library(lib, f"{path}/text", "tsv")
    text = spark.read.option("sep", "\t").option("header", True).csv(f"{path}/text").select("ModifiedPeptide", F.col("FragmentNumber").cast("int"), F.col("RelativeIntensity").alias("shown"))
    return spark.read.parquet(f"{path}/flat").select("ModifiedPeptide", "FragmentNumber", "RelativeIntensity").join(text, ["ModifiedPeptide", "FragmentNumber"])


@query("s10_library_tables", f"SELECT pep AS peptideModSeq, count(*) AS numPeaks, 2 AS ionMobilityType, count(*) AS n_annotations, round(sum(i), 2) AS total FROM ({_LIB}) GROUP BY pep")
def _(spark, t):
    path = _scratch(spark)
    io.write_library_tables(_library(t), path)
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    notes = read("RefSpectraPeakAnnotations").groupBy("RefSpectraID").agg(F.count("*").alias("n_annotations"))
    peaks = read("RefSpectraPeaks").select("RefSpectraID", F.round(F.aggregate("peakIntensity", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))
    return read("RefSpectra").select("RefSpectraID", "peptideModSeq", "numPeaks", "ionMobilityType").join(notes, "RefSpectraID").join(peaks, "RefSpectraID").drop("RefSpectraID")


@query("s10_library_side_tables", f"""WITH l AS (SELECT pep FROM ({_LIB}) GROUP BY pep) SELECT 'LibInfo' AS name, 1 AS n, count(*)::VARCHAR AS told FROM l
UNION ALL SELECT 'RetentionTimes', count(*), '1' FROM l UNION ALL SELECT 'Modifications', count(*), 'Oxidation' FROM l
UNION ALL SELECT * FROM (VALUES ('SpectrumSourceFiles', 1, 'own'), ('IonMobilityTypes', 4, 'none'), ('ScoreTypes', 1, 'UNKNOWN'))""")
def _(spark, t):
    path = _scratch(spark)
    modified = _library(t).withColumn("ModifiedPeptide", F.concat(F.lit("P[Oxidation]"), F.substring("ModifiedPeptide", 2, 1000)))
    io.write_library_tables(modified, path, "own")
    read = lambda n, told: spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("n"), F.min(told).cast("string").alias("told")).select(F.lit(n).alias("name"), "n", "told")
    tables = [read("LibInfo", "numSpecs"), read("RetentionTimes", "bestSpectrum"), read("Modifications", "mass"), read("SpectrumSourceFiles", "fileName"), read("ScoreTypes", "scoreType")]
    first = read("IonMobilityTypes", F.expr("CASE WHEN id = 0 THEN ionMobilityType END"))
    for table in tables:
        first = first.unionByName(table)
    return first


@query("s11_export_mgf", f"""SELECT user_id, 3 + 1 + count(*) FILTER (WHERE v > 1e-12) + 1 AS n_lines FROM ({tb.DAILY_SQL}) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id""")
def _(spark, t):
    scans = tb.series(t).withColumn("mz", F.transform("values", lambda x, i: i)).withColumn("pm", F.lit(500.5))
    matches = t("events").filter("event_type = 'purchase'").select("user_id", F.lit(2).alias("charge")).distinct()
    blocks = io.mgf_blocks(scans, matches, ["user_id"], F.col("user_id").cast("string"), "mz", "values", "pm", "charge")
    path = _scratch(spark)
    io.export_mgf(blocks, path)
    lines = spark.read.text(path, lineSep="END IONS\n").filter(F.col("value").contains("TITLE="))
    return lines.select(F.regexp_extract("value", r"TITLE=(\d+)", 1).cast("long").alias("user_id"), F.size(F.filter(F.split("value", "\n"), lambda x: x != "")).cast("long").alias("n")).select("user_id", (F.col("n") + 1).alias("n_lines"))


@query("s11_missing_scans", f"""WITH e AS (SELECT user_id, sec // 86400 AS day, event_type FROM ({tb.EVENTS_SQL})) SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase'
AND (user_id, day) NOT IN (SELECT (user_id, day) FROM e WHERE event_type = 'view')""")
def _(spark, t):
    e = tb.events(t).withColumn("day", F.floor(F.col("sec") / 86400))
    return io.missing_scans(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), ["user_id", "day"])


@query("s12_tag_fasta_headers", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'sp|' || p_partkey || '|T_' || p_name || ' GN=T_' || p_brand ELSE p_name END AS header, p_size <= 25 AS malformed FROM part")
def _(spark, t):
    header = F.when(F.col("p_size") > 25, F.concat(F.lit("sp|"), F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_name"), F.lit(" GN="), F.col("p_brand"))).otherwise(F.col("p_name"))
    return io.tag_fasta_headers(t("part").select("p_partkey", header.alias("header")), "T")


@query("s13_append_database", "SELECT doc_id AS id, 'main' AS origin FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def _(spark, t):
    return io.append_database(t("documents").select(F.col("doc_id").alias("id")), ("benchmark", t("benchmark").select(F.col("item_id").alias("id"))))


@query("s14_write_pairs", "SELECT p_brand, p_type, p_partkey FROM part")
def _(spark, t):
    path = _scratch(spark)
    io.write_pairs(t("part").select("p_brand", "p_type", "p_partkey"), path)
    return spark.read.option("sep", "\t").option("header", True).schema("p_brand string, p_type string, p_partkey long").csv(path)


@query("s14_write_filtered_intensities", f"SELECT grp, item, run, v FROM ({tb.VALUES_SQL})")
def _(spark, t):
    path = _scratch(spark)
    rows = tb.report(t).filter("q1 <= 0.05").withColumn("v", F.round("v", 2))
    io.write_filtered_intensities(rows, path, group="grp", item="item", run="run", value="v")
    return spark.read.option("sep", "\t").option("header", True).schema("grp string, item long, run int, v double").csv(path)


@query("s15_run_meta", f"SELECT event_type, count(*) AS n, max(sec) AS last FROM ({tb.EVENTS_SQL}) GROUP BY event_type")
def _(spark, t):
    meta = tb.events(t).groupBy("event_type").agg(F.count("*").alias("n"), F.max("sec").alias("last"))
    path = _scratch(spark)
    io.write_run_meta(meta, "event_type", path)
    return io.read_run_meta(spark, path, "event_type", "n long, last long")


@query("s16_merge_metrics", """SELECT coalesce(a.model, b.model) AS model, 's' AS stage, coalesce(a.metric, b.metric) AS metric, CASE WHEN b.model IS NOT NULL THEN CASE WHEN b.metric = 'click' THEN NULL ELSE b.v END ELSE a.v END AS value
FROM (SELECT user_id AS model, event_type AS metric, round(max(value), 2) AS v FROM events GROUP BY ALL) a FULL JOIN (SELECT user_id AS model, event_type AS metric, round(min(value), 2) AS v FROM events WHERE value > 20 GROUP BY ALL) b ON a.model = b.model AND a.metric = b.metric""")
def _(spark, t):
    e = t("events").select(F.col("user_id").alias("model"), F.lit("s").alias("stage"), F.col("event_type").alias("metric"), "value")
    old = e.groupBy("model", "stage", "metric").agg(F.round(F.max("value"), 2).alias("value"))
    new = e.filter("value > 20").groupBy("model", "stage", "metric").agg(F.round(F.min("value"), 2).alias("value")).withColumn("value", F.when(F.col("metric") == "click", float("nan")).otherwise(F.col("value")))
    return io.merge_metrics(old, new)


@query("s17_read_predictions", "SELECT p_partkey AS pepID, round(p_retailprice / 1000 * 60, 4) AS rt, p_size AS charge, round(p_retailprice / 500, 4) AS mobility FROM part")
def _(spark, t):
    raw = t("part").select(F.col("p_partkey").alias("pepID"), (F.col("p_retailprice") / 1000).alias("rt_pred"), F.col("p_size").alias("charge"), (F.col("p_retailprice") / 500).alias("mobility_pred"))
    return io.read_rt(raw, 60.0).withColumn("rt", F.round("rt", 4)).join(io.read_mobility(raw).withColumn("mobility", F.round("mobility", 4)), "pepID")
