"""Derived records: episodes, facts and predictions in one timeline, transcripts by minute, profile upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.paths import col

EPOCH = "1970-01-01"


def timeline(episodes: DataFrame, facts: DataFrame, predictions: DataFrame) -> DataFrame:
    """(kind, id, parent_id, text, at): all three tables as one; a missing time is the epoch."""
    one = episodes.select(F.lit("episode").alias("kind"), col("id").cast("string").alias("id"), col("parent_memcell_id").cast("string").alias("parent_id"), col("summary").alias("text"), col("timestamp").alias("at"))
    two = facts.select(F.lit("event"), col("id").cast("string"), col("parent_episode_id").cast("string"), col("atomic_fact"), col("timestamp"))
    three = predictions.select(F.lit("foresight"), col("id").cast("string"), col("parent_episode_id").cast("string"), col("content"), F.lit(None).cast("timestamp"))
    return one.union(two).union(three).withColumn("at", F.coalesce("at", F.lit(EPOCH).cast("timestamp")))


def with_episode(rows: DataFrame, episodes: DataFrame, linked_only: bool = False) -> DataFrame:
    """Facts or predictions with their episode's subject; ``linked_only`` leaves out rows that name no episode."""
    if linked_only:
        rows = rows.where("parent_episode_id is not null and parent_episode_id <> ''")
    return rows.join(episodes.select(F.col("id").alias("parent_episode_id"), F.col("subject").alias("episode_subject")), "parent_episode_id", "left")


def children(parents: DataFrame, rows: DataFrame, key: str, parent_key: str, item: str) -> DataFrame:
    """Every parent with the sorted list of its children's items."""
    grouped = rows.groupBy(F.col(parent_key).alias(key)).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return parents.join(grouped, key, "left").withColumn("items", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)))


def valid_transcript(text: str) -> "F.Column":
    return F.coalesce(~F.col(text).contains("[BLANK_AUDIO]") & (F.trim(F.col(text)) != ""), F.lit(False))


def by_minute(transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minute, human, computer): texts by minute of the day in order of time; a speaker other than ``other`` is human."""
    rows = transcripts.where(valid_transcript("text")).withColumn("minute", F.hour("start_time") * 60 + F.minute("start_time"))
    said = lambda who: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("start_time", "seq", "speaker", "text"))), who), lambda x: x["text"]), " ")
    other = lambda x: F.coalesce(x["speaker"] == "other", F.lit(False))
    return rows.groupBy(*keys, "minute").agg(said(lambda x: ~other(x)).alias("human"), said(other).alias("computer"))
