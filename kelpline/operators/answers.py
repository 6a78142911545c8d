"""Steps, resumed hits and judgements of answer streams, as grouped aggregates and equi-joins.

Streams are rows (session, seq, type, data) with JSON in ``data``; ``seq`` orders a session. Nothing gathers a session in one
row, so a session of any length is only as large as its own steps or hits. Broken JSON counts as null fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators.events import HIT, messages
from kelpline.operators.retrieval import judge

#: Stored hits of a message, in order of their position.
REFERENCES = "array<struct<position:long,file_id:string,chunk_id:string,score:double,snippet:string,index:long,has_answer:boolean,comment:string,confidence:double>>"

def thinking_steps(events: DataFrame) -> DataFrame:
    """(session, position, id, title, status, hits): the steps of each session's last multi-path run.

    A step with a known id replaces that one in its place, but keeps its hits if it brings none. The end of the run completes
    the steps that are running then."""
    start = events.where("type = 'multi_path_start'").groupBy("session").agg(F.max("seq").alias("_start"))
    end = events.where("type = 'multi_path_end'").groupBy("session").agg(F.max("seq").alias("_end"))
    field = lambda name: F.get_json_object("data", f"$.{name}")
    steps = events.where("type = 'thinking_step'").select("session", "seq", field("id").alias("id"), field("title").alias("title"), field("status").alias("status"), F.json_array_length(field("hits")).cast("long").alias("hits"))
    steps = steps.join(start, "session", "left").where("_start is null or seq > _start")
    last = F.max(F.struct("seq", "title", "status")).alias("x")
    held = F.max(F.when(F.col("hits").isNotNull(), F.struct("seq", "hits"))).alias("h")
    by_id = steps.groupBy("session", "id").agg(F.min("seq").alias("first"), last, held).join(end, "session", "left")
    status = F.when((F.col("x.status") == "running") & (F.col("x.seq") < F.col("_end")), "complete").otherwise(F.col("x.status"))
    position = F.row_number().over(Window.partitionBy("session").orderBy("first")).cast("long")
    return by_id.select("session", position.alias("position"), "id", F.col("x.title").alias("title"), status.alias("status"), F.col("h.hits").alias("hits"))


def resumed_references(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two tables of hits (session, chunk_id, file_id, ...): after a resume, a new hit stays unless its chunk (its
    file, if it has no chunk) is among the existing ones; new hits that repeat each other all stay. This is the rule of multi-path
    runs; ``continued_references`` has both kinds of runs."""
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), "file_id")
    known = existing.select("session", key.alias("_key")).distinct()
    return existing.unionByName(new.withColumn("_key", key).join(known, ["session", "_key"], "left_anti").drop("_key"))


def continued_references(stored: DataFrame, events: DataFrame, parts: int | None = None) -> DataFrame:
    """(session, position, file_id, chunk_id, score, snippet, index, has_answer, comment, confidence): the hits of resumed
    answers. ``stored`` (session, is_multi, references array) are the messages as they stopped; sessions without one are left out.

    In a multi-path run (the stored one, or one that begins) a list of hits adds those whose chunk, or file without a chunk, was
    not there before; in a plain run it replaces all. Sub-queries' hits are always added. The last judgement made on the way
    replaces what is known; one of the final list judges only hits without one. Its joins are in ``parts``."""
    fields = ["file_id", "chunk_id", "score", "snippet", "index", "has_answer", "comment", "confidence"]
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("has_answer", "boolean"), ("comment", "string"), ("confidence", "double"))]
    mapped = lambda h: F.struct(F.coalesce(h["file_id"], F.lit("")).alias("file_id"), F.nullif(h["chunk_id"], F.lit("")).alias("chunk_id"), F.coalesce(h["score"], F.lit(0.0)).alias("score"), h["snippet"].alias("snippet"), h["metadata"]["index"].alias("index"), *none)
    known = F.transform(F.array_sort(F.coalesce("references", F.array().cast(REFERENCES))), lambda r: F.struct(*(r[f].alias(f) for f in fields)))
    start = stored.select("session", F.lit(None).cast(events.schema["seq"].dataType).alias("seq"), F.when(F.col("is_multi"), "multi_path_start").otherwise("stored").alias("type"), known.alias("hits"))
    kind = F.col("type")
    lists = F.from_json(F.when(kind == "hits", F.col("data")).when(kind == "subquery_hits", F.get_json_object("data", "$.hits")), HIT)
    found = events.where(kind.isin("multi_path_start", "hits", "subquery_hits")).join(stored.select("session"), "session", "left_semi")
    rows = start.unionByName(found.select("session", "seq", "type", F.transform(F.coalesce(lists, F.array().cast(HIT)), mapped).alias("hits")))
    w = Window.partitionBy("session").orderBy(F.asc_nulls_first("seq"))
    rows = rows.withColumn("multi", F.max((kind == "multi_path_start").cast("int")).over(w))
    rows = rows.withColumn("era", F.sum(((kind == "hits") & (F.col("multi") == 0)).cast("int")).over(w)).withColumn("last_era", F.max("era").over(Window.partitionBy("session"))).where("era = last_era")
    hits = rows.select("session", "seq", ((kind == "hits") & (F.col("multi") == 1)).alias("merges"), F.posexplode("hits").alias("at", "hit")).select("session", "seq", "merges", "at", "hit.*")
    key = F.coalesce("chunk_id", "file_id").alias("_key")
    first = F.min(F.struct(F.col("seq").isNotNull(), "seq")).over(Window.partitionBy("session", key))
    hits = hits.withColumn("_first", first).where(~F.col("merges") | (F.col("_first.seq") == F.col("seq")))
    position = F.row_number().over(Window.partitionBy("session").orderBy(F.asc_nulls_first("seq"), "at")).cast("long")
    placed = hits.select("session", position.alias("place"), *fields).withColumn("position", F.coalesce("index", "place"))
    verdict = "struct<index:long,chunk_id:string,has_answer:boolean,comment:string,confidence:double>"
    many = events.where("type = 'chunk_analysis'").select("session", "seq", F.posexplode(F.from_json("data", f"array<{verdict}>")).alias("at", "v")).where("v is not null").select("session", F.struct("seq", "at").alias("seq"), "v.*")
    one = events.where("type = 'chunk_progress'").select("session", "seq", F.from_json(F.get_json_object("data", "$.chunk_result"), verdict).alias("v")).where("v is not null").select("session", "seq", "v.*")
    judged = judge(placed, many, ["session"], parts)
    last = F.max(F.struct("seq", F.struct("has_answer", "comment", "confidence").alias("v")))
    judged = judged.join(one.where("chunk_id <> ''").groupBy("session", "chunk_id").agg(last.alias("_c")), ["session", "chunk_id"], "left")
    judged = judged.join(one.where("index is not null").groupBy("session", F.col("index").alias("position")).agg(last.alias("_p")), ["session", "position"], "left")
    newest = F.when(F.col("_p").isNull() | (F.col("_c.seq") >= F.col("_p.seq")), F.col("_c")).otherwise(F.col("_p"))
    newest = F.coalesce(newest["v"], F.struct("has_answer", "comment", "confidence"))
    return judged.withColumn("_v", newest).select("session", F.col("place").alias("position"), *fields[:5], "_v.has_answer", "_v.comment", "_v.confidence")


def continued_messages(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(session, text, meta, is_multi, needs_decision, resume_token) of resumed answers: the text goes on where ``stored``
    (session, text, is_multi, ...) stopped, an open decision is closed until a new one comes. Stored messages without events stay
    as they are, with an empty notice."""
    own = stored.select("session", F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("is_multi", F.lit(False)).alias("_multi"))
    new = own.join(messages(events), "session", "left")
    text = F.concat("_text", F.coalesce("text", F.lit("")))
    return new.select("session", text.alias("text"), "meta", (F.col("_multi") | F.coalesce("is_multi", F.lit(False))).alias("is_multi"), F.coalesce("needs_decision", F.lit(False)).alias("needs_decision"), "resume_token")


def judged_last(hits: DataFrame, events: DataFrame) -> DataFrame:
    """``hits`` (session, position, chunk_id) with (has_answer, comment, confidence) of the last event that names them.

    ``chunk_analysis_item`` names a hit by chunk or by its place, ``chunk_analysis`` (a list) by place alone, where the first
    entry of a list counts. Unlike the first pass, a later judgement replaces an earlier one."""
    shape = "struct<index:long,chunk_id:string,has_answer:boolean,comment:string,confidence:double>"
    value = F.struct("has_answer", "comment", "confidence").alias("v")
    item = events.where("type = 'chunk_analysis_item'").select("session", "seq", F.from_json("data", shape).alias("i")).select("session", "seq", F.lit(0).alias("at"), "i.*")
    batch = events.where("type = 'chunk_analysis'").select("session", "seq", F.posexplode(F.from_json("data", f"array<{shape}>")).alias("at", "i")).select("session", "seq", (-F.col("at")).alias("at"), "i.*")
    by_chunk = item.where("chunk_id <> ''").groupBy("session", "chunk_id").agg(F.max(F.struct("seq", "at", value)).alias("_c"))
    by_place = item.unionByName(batch).where("index is not null").groupBy("session", F.col("index").alias("position")).agg(F.max(F.struct("seq", "at", value)).alias("_p"))
    joined = hits.join(by_chunk, ["session", "chunk_id"], "left").join(by_place, ["session", "position"], "left")
    newest = F.when(F.col("_p").isNull() | (F.col("_c.seq") >= F.col("_p.seq")), F.col("_c.v")).otherwise(F.col("_p.v"))
    return joined.withColumn("_v", newest).select(*hits.columns, "_v.has_answer", "_v.comment", "_v.confidence")


def merged_sub_queries(answers: DataFrame) -> DataFrame:
    """(session, chunk_id, score, sub_queries, times) of ``answers`` (session, hits array of (sub_query, chunk_id, score)):
    the hits of all sub-queries, each chunk once with its best score and the number of sub-queries that found it."""
    rows = answers.select("session", F.explode("hits").alias("h")).select("session", "h.*")
    return rows.groupBy("session", "chunk_id").agg(F.max("score").alias("score"), F.count_distinct("sub_query").alias("sub_queries"), F.count("*").alias("times"))
