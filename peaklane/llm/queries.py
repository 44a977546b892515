"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklane.llm import chat, pieces, token_files
from peaklane.llm.decontamination import decontaminate
from peaklane.llm.lexical import lexical_search
from peaklane.llm.licenses import license_scan
from peaklane.llm.merkle import lower_where, merkle_manifest
from peaklane.llm.near_dedup import near_duplicates
from peaklane.llm.quality import quality_rules
from peaklane.llm.sharding import assign_shards
from peaklane.llm.sql import SQL
from peaklane.llm.substring_dedup import substring_dedup
from peaklane.llm.toxicity import toxicity, train
from peaklane.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = _documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign_shards(sized).select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def _fold(ids: str) -> Column:
    return F.crc32(F.col(ids).cast("string")) % 3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    machine = train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable=_fold("doc_id") != 1)
    scored = toxicity(docs, machine)
    return scored.select("doc_id", (_fold("doc_id") == 1).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_documents(spark, sf_dir))
    base = F.filter("matches", lambda m: m.is_base)
    first = F.array_min(F.transform(base, lambda m: m.start))
    last = F.array_max(F.transform(base, lambda m: m.start))
    named = F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m.label))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), named.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    parts = token_files.write_token_files(_documents(spark, sf_dir), folder, _tokenizer("byte_bpe_50k.json"))
    return token_files.ids_crc32(token_files.read_token_files(parts, folder))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    records = rows.unionByName(marked).select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    read = chat.read_chats(chat.format_chats(chat.canonical_turns(records)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.content, F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return read.select(F.col("key").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pieces.encode(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), decoded=True)
    return read.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle_manifest(docs, changed=lower_where(F.col("text"), _fold("doc_id") == 0)).drop("n_siblings")


#: The rules of the contract: text and action.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action")) for r, a in RULES])
    rules = spark.range(1).select(F.inline(listed))
    return url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


_QUERIES = [op1_sharding, op2_toxicity, op3_substring_dedup, op4_license_scan, op5_token_files, op6_near_dedup, op7_quality_rules, op8_chat_format, op9_decontamination, op10_sentencepiece, op11_lexical_search, op12_merkle_manifest, op13_url_filter]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
