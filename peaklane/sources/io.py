"""Readers, writers and the table shapes they need. Paths go to Spark's own readers and writers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peaklane.operators.stored import stored

#: Column names of two report dialects, as canonical name by theirs. Fixed values.
PROFILES = {
    "diann": {
        "Precursor.Id": "precursor_id", "Stripped.Sequence": "peptide", "Modified.Sequence": "modified", "Precursor.Charge": "charge",
        "Precursor.MZ": "mz", "RT": "rt", "RT.Start": "rt_start", "RT.Stop": "rt_stop", "Q.Value": "q_value", "PEP": "pep", "IM": "mobility",
        "PTM.Site.Confidence": "ptm_site_confidence", "PTM.Q.Value": "ptm_q_value", "Protein.Group": "protein_group",
        "Precursor.Normalised": "intensity", "Run": "run", "MS2.Scan": "scan",
        "Global.Q.Value": "global_q_value", "Lib.Q.Value": "lib_q_value", "Global.PG.Q.Value": "global_pg_q_value", "Lib.PG.Q.Value": "lib_pg_q_value",
    },
    "skyline": {
        "Peptide": "peptide", "Peptide Modified Sequence Unimod Ids": "modified", "Precursor Charge": "charge", "Best Retention Time": "rt",
        "Min Start Time": "rt_start", "Max End Time": "rt_stop", "Detection Q Value": "q_value", "Ion Mobility MS1": "mobility", "File Name": "run",
    },
}


def parse_fasta(records: DataFrame, record: str = "value") -> DataFrame:
    """(accession, header, sequence) of text records, with or without the ``>`` that begins them."""
    body = F.regexp_replace(F.regexp_replace(F.col(record), "\r", ""), r"^\s*>", "")
    header = F.split_part(body, F.lit("\n"), F.lit(1))
    sequence = F.regexp_replace(F.when(F.instr(body, "\n") > 0, body.substr(F.instr(body, "\n") + 1, F.length(body))).otherwise(""), r"\s", "")
    return records.filter(F.trim(record) != "").select(F.regexp_extract(header, r"^(\S*)", 1).alias("accession"), header.alias("header"), sequence.alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records begin with ``>`` at the start of a line; inside a header it is an ordinary character."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def read_report(spark: SparkSession, path: str, *, columns: list[str] | None = None, schema=None) -> DataFrame:
    """A report with a header, tab-separated (plain or .gz) or Parquet; dots in names become underscores only where
    the caller asks for columns by name."""
    if path.rstrip("/").endswith((".tsv", ".txt", ".gz", ".csv")):
        reader = spark.read.option("sep", "," if path.endswith(".csv") else "\t").option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if path.endswith(".gz") else df
    else:
        df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in columns]) if columns else df


def canonicalize_report(df: DataFrame, profile: str | dict) -> DataFrame:
    """Canonical column names; ``File.Name`` serves as run where there is no ``Run``."""
    names = PROFILES[profile] if isinstance(profile, str) else profile
    if "Run" not in df.columns and "File.Name" in df.columns:
        names = {**names, "File.Name": "run"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def read_precursor_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(charge, modified, peptide) of a delimited table with the skyline columns."""
    from peaklane.functions.scalars import strip_unimod

    df = canonicalize_report(spark.read.option("sep", sep).option("header", True).csv(path), "skyline")
    return df.select(F.col("charge").cast("int").alias("charge"), "modified", strip_unimod("modified").alias("peptide"))


SCAN_SCHEMA = "index int, mz_values array<float>, intensities array<float>, precursor_rt double, precursor_im double, collision_energy double, isolation_mz double, isolation_width double"
XIC_SCHEMA = "id int, mobility_ook0 double, rt_seconds double, precursor_mzs array<double>, precursor_intensities array<array<double>>, fragment_mzs array<double>, fragment_labels array<string>, fragment_intensities array<array<double>>, retention_time_results_seconds array<double>"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_SCHEMA).parquet(path)


def read_xic_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(XIC_SCHEMA).json(path)


def first_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first row's value of each key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def read_peptide_index(spark: SparkSession, path: str) -> DataFrame:
    """(peptide, proteins): of a peptide that stands twice the first row counts, in the order of file names, blocks of a file
    and rows."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return first_by(df.withColumn("_line", line), df.columns[0], df.columns[1], "_line").toDF("peptide", "proteins")


#: Columns of the flat library, in order, and whether text shows them with a fixed number of decimals.
LIBRARY = ["ModifiedPeptide", "StrippedPeptide", "PrecursorMz", "PrecursorCharge", "Tr_recalibrated", "IonMobility", "ProteinID", "Decoy", "FragmentMz", "RelativeIntensity", "FragmentType", "FragmentNumber", "FragmentCharge", "FragmentLossType"]
_SHOWN = {"Tr_recalibrated": "%.2f", "RelativeIntensity": "%.4f"}


def library_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.format_string(_SHOWN[c], F.col(c).cast("double")).alias(c) if c in _SHOWN else F.col(c) for c in LIBRARY])


def write_library(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The flat library as zstd Parquet without dictionaries, or as tab-separated text."""
    if fmt == "parquet":
        df.select(*LIBRARY).write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    else:
        library_text(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def dense_ids(df: DataFrame, key: list[str], out: str = "id", slot_rows: int = 1_000_000) -> DataFrame:
    """(key, out): numbers from 1 without gaps for the distinct keys, by hash slots of some ``slot_rows`` keys (1,024 slots
    at least) and the counts before them."""
    keys = df.select(*key).distinct()
    slots = F.broadcast(keys.agg(F.greatest(F.lit(1024), F.ceil(F.count("*") / slot_rows)).alias("_slots")))  # one row
    keys = keys.crossJoin(slots).withColumn("_slot", F.pmod(F.xxhash64(*key), F.col("_slots"))).drop("_slots")
    before = F.sum("_c").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))  # slots rows
    offsets = keys.groupBy("_slot").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(before, F.lit(0)))
    number = F.row_number().over(Window.partitionBy("_slot").orderBy(*key))
    return keys.withColumn("_i", number).join(F.broadcast(offsets.select("_slot", "_b")), "_slot").select(*key, (F.col("_b") + F.col("_i")).alias(out))


#: Columns of the flat library that name a spectrum, and those of a fragment in the related tables.
_SPECTRUM, _FRAGMENT = ["ModifiedPeptide", "PrecursorCharge"], ["FragmentMz", "RelativeIntensity", "FragmentType", "FragmentNumber", "FragmentCharge"]
_SLOTS = 1024


def library_spectra(lib: DataFrame) -> DataFrame:
    """The flat library with one row a spectrum: its fragments in the order of their m/z and intensity, and its number in its
    slot, from 1. The library is read and shuffled once. Rows without a sequence or charge belong to no spectrum."""
    rows = lib.filter(F.col(_SPECTRUM[0]).isNotNull() & F.col(_SPECTRUM[1]).isNotNull()).withColumn("_slot", F.pmod(F.xxhash64(*_SPECTRUM), F.lit(_SLOTS)))
    once = [F.first(c).alias(c) for c in ("StrippedPeptide", "PrecursorMz", "IonMobility", "Tr_recalibrated", "ProteinID")]
    spectra = rows.repartition("_slot").groupBy("_slot", *_SPECTRUM).agg(*once, F.sort_array(F.collect_list(F.struct(*_FRAGMENT))).alias("_fragments"))
    return spectra.withColumn("_i", F.row_number().over(Window.partitionBy("_slot").orderBy(*_SPECTRUM)))


def _numbered(spectra: DataFrame, slot_rows: int = 1_000_000) -> DataFrame:
    """Stored spectra with the ``RefSpectraID`` that ``dense_ids`` gives: the counts of the slots before are added, or, where slots
    hold more than ``slot_rows`` on average, it is made in more of them."""
    if spectra.count() > _SLOTS * slot_rows:
        return spectra.join(dense_ids(spectra, _SPECTRUM, "RefSpectraID", slot_rows), _SPECTRUM)
    before = F.sum("_c").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))  # a row a slot
    offsets = stored(spectra.groupBy("_slot").agg(F.count("*").alias("_c")).select("_slot", F.coalesce(before, F.lit(0)).alias("_b")))
    return spectra.join(F.broadcast(offsets), "_slot").withColumn("RefSpectraID", F.col("_b") + F.col("_i"))


def to_library_tables(lib: DataFrame, source: str = "library") -> dict[str, DataFrame]:
    """The flat library as related tables."""
    return _tables(_numbered(stored(library_spectra(lib))), source)


def _tables(rows: DataFrame, source: str) -> dict[str, DataFrame]:
    spark = rows.sparkSession
    named = {"peptideSeq": "StrippedPeptide", "peptideModSeq": "ModifiedPeptide", "precursorMZ": "PrecursorMz", "precursorCharge": "PrecursorCharge", "numPeaks": F.size("_fragments").cast("long"), "ionMobility": "IonMobility", "retentionTime": "Tr_recalibrated", "protein": "ProteinID"}
    spectra = rows.select("RefSpectraID", *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in named.items()])
    spectra = spectra.withColumn("ionMobilityType", F.when(F.col("ionMobility").isNull(), 0).otherwise(2)).withColumn("collisionalCrossSectionSqA", F.lit(None).cast("double")).withColumn("fileID", F.lit(1))
    peaks = rows.select("RefSpectraID", F.col("_fragments.FragmentMz").alias("peakMZ"), F.col("_fragments.RelativeIntensity").alias("peakIntensity"))
    annotations = rows.select("RefSpectraID", F.posexplode("_fragments").alias("peakIndex", "_f")).select("RefSpectraID", "peakIndex", F.concat("_f.FragmentType", F.col("_f.FragmentNumber").cast("string")).alias("name"), F.col("_f.FragmentCharge").alias("charge"), F.col("_f.FragmentMz").alias("mzTheoretical"))
    found = F.regexp_extract_all("peptideModSeq", F.lit(r"[A-Z]|\[[^\]]*\]"), F.lit(0))
    step = lambda a, x: F.struct(F.when(x.startswith("["), a.n).otherwise(a.n + 1).alias("n"), F.when(x.startswith("["), F.concat(a.out, F.array(F.struct(a.n.alias("position"), F.regexp_replace(x, r"[\[\]]", "").alias("mass"))))).otherwise(a.out).alias("out"))
    mods = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<position:int,mass:string>>").alias("out")), step, lambda a: a.out)
    modifications = spectra.select("RefSpectraID", F.explode_outer(mods).alias("m")).filter("m IS NOT NULL").select("RefSpectraID", "m.position", "m.mass")
    return {
        "LibInfo": spectra.agg(F.lit(source).alias("libLSID"), F.count("*").alias("numSpecs")),
        "SpectrumSourceFiles": spark.createDataFrame([(1, source)], "id int, fileName string"),
        "RefSpectra": spectra,
        "RefSpectraPeaks": peaks,
        "RefSpectraPeakAnnotations": annotations,
        "Modifications": modifications,
        "RetentionTimes": spectra.select("RefSpectraID", F.lit(1).alias("SpectrumSourceID"), "retentionTime", F.lit(1).alias("bestSpectrum")),
        "IonMobilityTypes": spark.createDataFrame([(0, "none"), (1, "driftTime(msec)"), (2, "inverseK0(Vsec/cm^2)"), (3, "compensation(V)")], "id int, ionMobilityType string"),
        "ScoreTypes": spark.createDataFrame([(0, "UNKNOWN", "NOT_A_PROBABILITY_VALUE")], "id int, scoreType string, probabilityType string"),
    }


def write_library_tables(lib: DataFrame, path: str, source: str = "library") -> None:
    """All tables of the library; its spectra are written once, beside them, and every table is made from their rows."""
    library_spectra(lib).write.mode("overwrite").parquet(f"{path}/_keyed")
    for name, df in _tables(_numbered(lib.sparkSession.read.parquet(f"{path}/_keyed")), source).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def mgf_blocks(scans: DataFrame, matches: DataFrame, on: list[str], title: Column, values: str, intensities: str, precursor: str, charge: str, *, least: float = 1e-12) -> DataFrame:
    """One text block for each matched scan; peaks of next to no intensity are left out."""
    peaks = F.filter(F.arrays_zip(F.col(values).alias("m"), F.col(intensities).alias("i")), lambda p: p["i"] > least)
    lines = F.transform(peaks, lambda p: F.concat(p["m"].cast("string"), F.lit(" "), p["i"].cast("string")))
    head = F.array(F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), title), F.concat(F.lit("PEPMASS="), F.col(precursor).cast("string")), F.concat(F.lit("CHARGE="), F.col(charge).cast("string"), F.lit("+")))
    wanted = matches.select(*on, charge).distinct()
    return scans.join(wanted, on).select(*on, F.array_join(F.concat(head, lines, F.array(F.lit("END IONS"))), "\n").alias("block"))


def missing_scans(scans: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    return matches.select(*on).distinct().join(scans.select(*on), on, "left_anti")


def export_mgf(blocks: DataFrame, path: str) -> None:
    blocks.select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def tag_fasta_headers(df: DataFrame, tag: str, header: str = "header") -> DataFrame:
    """Prefix the third ``|`` token and the ``GN=`` value with the tag; append ``GN=`` where there is none. ``malformed``
    marks headers of fewer than three tokens, which stay as they are."""
    parts = F.split(header, r"\|", 3)
    bad = F.size(parts) < 3
    third = F.concat_ws("|", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.concat(F.lit(f"{tag}_"), F.get(parts, F.lit(2))))
    name = F.regexp_extract(F.get(parts, F.lit(2)), r"^(\S*)", 1)
    named = F.when(F.col(header).rlike(r"\bGN=\S"), F.regexp_replace(third, r"\bGN=(\S)", f"GN={tag}_$1")).otherwise(F.concat(third, F.lit(f" GN={tag}_"), name))
    return df.withColumn("malformed", bad).withColumn(header, F.when(bad, F.col(header)).otherwise(named))


def append_database(df: DataFrame, *others: tuple[str, DataFrame], origin: str = "origin", own: str = "main") -> DataFrame:
    out = df.withColumn(origin, F.lit(own))
    for name, other in others:
        out = out.unionByName(other.withColumn(origin, F.lit(name)))
    return out


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


write_consensus = write_pairs


def write_filtered_intensities(df: DataFrame, path: str, *, group: str, item: str, run: str, value: str) -> None:
    """The rows that passed the filters, one for each group, item and run with its greatest value."""
    write_pairs(df.groupBy(group, item, run).agg(F.max(value).alias(value)), path)


def run_meta_json(df: DataFrame, run: str) -> DataFrame:
    """(run, meta): for each run a JSON object from its name to its values; readers merge them."""
    rest = [c for c in df.columns if c != run]
    return df.select(run, F.to_json(F.create_map(F.col(run), F.struct(*rest))).alias("meta"))


def write_run_meta(df: DataFrame, run: str, path: str) -> None:
    """One JSON object a run and line."""
    run_meta_json(df, run).select("meta").write.mode("overwrite").text(path)


def read_run_meta(spark: SparkSession, path: str, run: str, values: str) -> DataFrame:
    """The runs and their values (a DDL schema) again."""
    lines = spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,struct<{values}>>")).alias(run, "_v"))
    return lines.select(run, "_v.*")


def merge_metrics(old: DataFrame, new: DataFrame, key: tuple = ("model", "stage", "metric"), value: str = "value") -> DataFrame:
    """New values over old ones; NaN and infinities become null."""
    finite = lambda c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c))
    a = old.select(*key, finite(value).alias("_old"))
    b = new.select(*key, finite(value).alias("_new"), F.lit(True).alias("_has"))
    return a.join(b, list(key), "full").select(*key, F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias(value))


def read_rt(df: DataFrame, rt_max: float, ids: str = "pepID") -> DataFrame:
    """(pepID, rt): the scaled prediction, or the one on the reference scale if there is no maximum."""
    return df.select(ids, (F.col("rt_pred") * rt_max if rt_max > 0 else F.col("irt_pred")).alias("rt"))


def read_mobility(df: DataFrame, ids: str = "pepID", charge: str = "charge") -> DataFrame:
    return df.select(ids, charge, F.col("mobility_pred").alias("mobility"))
