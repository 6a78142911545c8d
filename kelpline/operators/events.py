"""Answer streams folded into one message per session.

``events`` has (session, seq, type, data) with JSON in ``data``; ``seq`` orders a session's events. The fold is a set of
window sums and grouped aggregates: texts join in order, the last status counts, and hits become rows of a reference
table. ``messages`` joins a session's text in one row, so one answer must fit a task's memory. Steps are in
``operators/answers.py``. Every event of a batch is read (none is lost
after an early status). Sessions without events give no row; events with broken JSON count as null fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.labels import status_text
from kelpline.operators.retrieval import judge

HIT = "array<struct<file_id:string,chunk_id:string,score:double,snippet:string,metadata:struct<index:long>>>"


def messages(events: DataFrame) -> DataFrame:
    """(session, text, meta, is_multi, needs_decision, resume_token, processed, total, complete) per session."""
    data = F.col("data")
    said = F.when(F.col("type").isin("token", "done"), data).when(F.col("type") == "error", F.concat(F.lit("\n[Error: "), data, F.lit("]")))
    progress = F.when(F.col("type") == "chunk_progress", F.get_json_object(data, "$.current_file"))
    meta = (
        F.when(F.col("type") == "status", status_text(data))
        .when(F.col("type") == "hits", F.concat(F.lit("Found "), F.coalesce(F.json_array_length(data), F.lit(0)).cast("string"), F.lit(" sources")))
        .when(F.col("type") == "subquery_hits", F.concat(F.lit("Sub-query "), F.get_json_object(data, "$.sub_query_index"), F.lit(": Found "), F.coalesce(F.json_array_length(F.get_json_object(data, "$.hits")), F.lit(0)).cast("string"), F.lit(" sources")))
        .when(F.col("type") == "chunk_progress", F.concat(F.lit("Analyzing "), F.coalesce(F.nullif(progress, F.lit("")), F.lit("source")), F.lit("...")))
        .when(F.col("type") == "user_decision_required", "Waiting for confirmation...")
        .when(F.col("type") == "error", "Error")
        .when(F.col("type") == "done", "")
    )
    kind = F.col("type")
    steps = F.when(kind == "chunk_progress", F.struct("seq", F.get_json_object(data, "$.processed_count").try_cast("long").alias("processed"), F.get_json_object(data, "$.total_count").try_cast("long").alias("total"), F.lit(False).alias("complete")))
    steps = steps.when(kind == "chunk_analysis", F.struct("seq", F.json_array_length(data).cast("long").alias("processed"), F.json_array_length(data).cast("long").alias("total"), F.lit(True).alias("complete")))
    out = events.groupBy("session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("seq", said.alias("t"))))), lambda x: x["t"]), "").alias("text"),
        F.max(F.when(meta.isNotNull(), F.struct("seq", meta.alias("m")))).alias("_m"),
        F.bool_or(kind == "multi_path_start").alias("is_multi"),
        F.bool_or(kind == "user_decision_required").alias("needs_decision"),
        F.max(F.when(kind == "user_decision_required", F.struct("seq", F.get_json_object(data, "$.resume_token").alias("r")))).alias("_r"),
        F.max(steps).alias("_p"),
    )
    return out.select("session", "text", F.nullif("_m.m", F.lit("")).alias("meta"), "is_multi", "needs_decision", F.col("_r.r").alias("resume_token"), F.col("_p.processed").alias("processed"), F.col("_p.total").alias("total"), F.coalesce("_p.complete", F.lit(False)).alias("complete"))


def references(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(session, position, file_id, chunk_id, score, snippet, index, has_answer, comment, confidence): the hits that a
    session ends with. A list of hits replaces what was there, but in a multi-path run it only adds numbers not yet there;
    hits of sub-queries are always added. Judgements go by chunk, else by number or place; the first judgement stays.
    Joins are in ``parts``, windows in those of ``events`` if they are dealt by session."""
    rows = events.where(F.col("type").isin("multi_path_start", "hits", "subquery_hits"))
    lists = F.from_json(F.when(F.col("type") == "hits", F.col("data")).when(F.col("type") == "subquery_hits", F.get_json_object("data", "$.hits")), HIT)
    w = Window.partitionBy("session").orderBy("seq")
    rows = rows.select("session", "seq", "type", F.coalesce(lists, F.array().cast(HIT)).alias("hits"), F.max((F.col("type") == "multi_path_start").cast("int")).over(w).alias("multi"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    replaces = (F.col("type") == "hits") & (F.col("multi") == 0)
    rows = rows.withColumn("era", F.sum(replaces.cast("int")).over(w)).withColumn("last_era", F.max("era").over(Window.partitionBy("session"))).where("era = last_era")
    rows = rows.withColumn("held", F.coalesce(F.sum(F.size("hits")).over(before), F.lit(0)))
    hits = rows.select("session", "seq", F.when((F.col("type") == "hits") & (F.col("multi") == 1) & (F.col("held") > 0), 1).otherwise(0).alias("merges"), F.posexplode("hits").alias("at", "hit"))
    hits = hits.withColumn("index", F.col("hit.metadata.index"))
    first = F.row_number().over(Window.partitionBy("session", "index").orderBy("seq", "at"))
    hits = hits.withColumn("nth", first).where("merges = 0 or index is not null and nth = 1")
    hits = hits.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy("seq", "at")).cast("long"))
    plain = hits.select("session", "position", F.coalesce("hit.file_id", F.lit("")).alias("file_id"), F.nullif("hit.chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("hit.score", F.lit(0.0)).alias("score"), F.col("hit.snippet").alias("snippet"), "index", F.lit(None).cast("boolean").alias("has_answer"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("double").alias("confidence"))
    verdict = "struct<index:long,chunk_id:string,has_answer:boolean,comment:string,confidence:double>"
    one = events.where("type = 'chunk_progress'").select("session", "seq", F.array(F.from_json(F.get_json_object("data", "$.chunk_result"), verdict)).alias("v"))
    many = events.where("type = 'chunk_analysis'").select("session", "seq", F.from_json("data", f"array<{verdict}>").alias("v"))
    verdicts = one.union(many).select("session", "seq", F.posexplode("v").alias("at", "v")).where("v is not null").select("session", F.struct("seq", "at").alias("seq"), "v.*")
    placed = plain.withColumn("place", F.col("position")).withColumn("position", F.coalesce("index", "position"))
    judged = judge(placed, verdicts, ["session"], parts)
    return judged.withColumn("position", F.col("place")).drop("place").select(plain.columns)


def latest_request(rows: DataFrame, key: str, request: str = "request_id") -> DataFrame:
    """Only rows of the newest request of every key: late answers to older requests are left out."""
    newest = rows.groupBy(key).agg(F.max(request).alias("_newest"))
    return rows.join(newest, key).where(F.col(request) == F.col("_newest")).drop("_newest")
