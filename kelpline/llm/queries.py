"""The queries of the numbered operators, as thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import bpe, chat, divergence, embedding, language, licenses, merkle, minhash, packing, quality, rules, sharding, windows
from kelpline.llm.common import table
from kelpline.llm.oracles import ORACLE_SQL as ORACLE_SQL


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer(), decode=True)
    return found.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    base = ~rules.passes("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rules.passes("v2").alias("kept"), "failures")


def language_model(spark: SparkSession, sf_dir: str) -> language.Crf:
    return language.train(table(spark, sf_dir, "documents").where(~held_out()))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language.predict(docs.select("doc_id", "text"), language_model(spark, sf_dir))
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.bounded_ring(table(spark, sf_dir, "documents"), shards=24)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Net:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.predict(docs, quality_model(spark, sf_dir))
    return found.select(F.col("row.doc_id").alias("doc_id"), "score", "predicted").withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    received = [F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in fields]
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs, fields, tampered=received, when=struck)
    root = merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_windows(table(spark, sf_dir, "documents"), tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_embedding": op3_embedding,
    "op4_licenses": op4_licenses,
    "op5_rules": op5_rules,
    "op6_language": op6_language,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_windows": op13_windows,
}
