"""A corpus pipeline of five stages, each a Parquet table from the one before.

Quality rules drop the documents that they reject, of each group of near-duplicates one document stays, words that
repeat an earlier document are cut from the text, documents that hold a benchmark window go, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklane.llm import pieces
from peaklane.llm.decontamination import without_benchmark
from peaklane.llm.near_dedup import keep_one
from peaklane.llm.quality import keep_good
from peaklane.llm.queries import _tokenizer
from peaklane.llm.scratch import written
from peaklane.llm.substring_dedup import substring_dedup

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Short texts are not judged by their length, and by their histograms only
    from the guards on; null and empty texts go."""
    return keep_good(docs, min_words=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies from a similarity of 0.80; rows with a null id stay."""
    return keep_one(docs, percent=80, keys=18)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated words change: their words are joined by blanks, and ``n_chars`` follows. Texts that hold
    no repeat stay as they are; a text of which nothing is left stays as an empty document. Other columns keep their values,
    whatever their names."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring_dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest")))
    changed = F.col("n_removed") > 0
    new = {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    new |= {c: F.col("_rest").getField(c) for c in rest}
    if "n_chars" in rest:
        size = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, size).otherwise(new["n_chars"])
    return cut.select(*[new[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, and digests of the pieces and of the text that they spell). Null text: no pieces."""
    coded = pieces.encode(docs.select("doc_id", "text"), _tokenizer("piece_bpe_32k.model"), decoded=True)
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can't express the last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
