"""The stages of the corpus pipeline: language ID, quality classifier, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and is written as Parquet
and read again. All but the last return the columns of ``documents``. Models are trained on the documents and labels of
``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import language, minhash, packing, quality
from kelpline.llm.common import bounded_batches, discard, table, written
from kelpline.llm.queries import language_model, quality_model, tokenizer

#: A document whose words are on average less sure of their label than this is rejected, as is one without a letter.
CONFIDENCE = 0.5
#: Words that the encoder remembers in a worker, fewer than alone: here executors also keep the heap of shuffles before it.
ENCODER_MEMORY = 100_000
#: Bytes of text that the encoder takes at once, fewer than alone for the same reason.
ENCODER_SLICE = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose words are in learned languages, one or several. A null text, or one without a letter, goes;
    repeated rows and rows with a null id are judged by their texts; an empty table stays empty."""
    bounded_batches(spark)
    found = language.predict(docs, language_model(spark, sf_dir))
    return found.where((F.col("lang_pred") != "und") & (F.col("confidence") >= CONFIDENCE)).select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier predicts to be good. A null text is judged as an empty one; repeated rows and
    rows with a null id are judged by their texts; an empty table stays empty."""
    bounded_batches(spark)
    return quality.predict(docs, quality_model(spark, sf_dir)).where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, similarity 0.8), the one with the smallest id; of
    repeated rows one stays, rows of one id with different texts are documents of their own, texts without a word all
    stay; an empty table stays empty."""
    bounded_batches(spark)
    return minhash.one_of_each(docs, words=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens. A null text has the end token alone; repeated rows and rows
    with a null id are packed each; an empty table gives no sequence."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer(), memory=ENCODER_MEMORY, slice_bytes=ENCODER_SLICE)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: No stage's model or local search can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
