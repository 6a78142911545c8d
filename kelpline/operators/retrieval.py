"""Search hits: scoring, union of stages, grouping by file, judgements and citations.

How hits are scored is our definition (the functions say so); what is done with hits follows fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.labels import citations
from kelpline.functions.paths import col
from kelpline.model import HIGH_CONFIDENCE, LOW_SCORE


def chunk_windows(docs: DataFrame, key: str, text: str, size: int = 500, step: int = 400) -> DataFrame:
    """(key, ordinal, start, chunk): sliding windows of characters that cover the whole text; no text, no chunk."""
    n = F.length(col(text))
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    rows = docs.where(n > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    return rows.select(key, "ordinal", (F.col("ordinal") * step).alias("start"), F.substring("_t", F.col("ordinal") * step + 1, F.lit(size)).alias("chunk"))


def contains_any(terms: str, *columns: str) -> Column:
    """Whether one of the columns contains the terms in any case; null columns are empty."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(terms.lower())
    return found


def lexical_hits(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """(key, score, matched): our definition; the share of the query's distinct words that a text contains as a substring,
    ties by the smaller key. A blank query gives no rows."""
    terms = sorted(set(query.lower().split()))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("matched")).limit(0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    matched = sum((low.contains(t).cast("int") for t in terms[1:]), low.contains(terms[0]).cast("int"))
    return docs.select(key, matched.alias("matched")).where("matched > 0").withColumn("score", F.col("matched") / len(terms)).orderBy(F.desc("score"), key).limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_hits(vectors: DataFrame, key: str, vector: str, query_key, k: int = 20) -> DataFrame:
    """(key, score): the ``k`` vectors nearest to one vector by cosine, itself left out."""
    one = F.broadcast(vectors.where(F.col(key) == query_key).select(F.col(vector).alias("_q")).limit(1))  # one row
    return vectors.join(one).where(F.col(key) != query_key).select(key, cosine(F.col(vector), F.col("_q")).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def stages_union(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """All hits of all stages with ``stage`` and ``arrival`` (the stage's place); nothing is deduplicated."""
    out = None
    for place, (name, hits) in enumerate(stages):
        part = hits.withColumns({"stage": F.lit(name), "arrival": F.lit(place)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def best_by_file(hits: DataFrame, file: str = "file_id", score: str = "score", low: float = LOW_SCORE) -> DataFrame:
    """(file, best, hits, first_arrival, is_low): hits grouped by file, with the best score and a mark for weak files."""
    return hits.groupBy(file).agg(F.max(score).alias("best"), F.count("*").alias("hits"), F.min("arrival").alias("first_arrival")).withColumn("is_low", F.coalesce(F.col("best") < low, F.lit(True)))


def file_chunks(hits: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, best, chunks): the chunks of each file by falling score; bounded by a file's own hits."""
    ordered = F.sort_array(F.collect_list(F.struct("score", "chunk_id")), asc=False)
    return hits.groupBy(file).agg(F.max("score").alias("best"), ordered.alias("chunks"))


#: Rows of a part, where parts are counted.
PART_ROWS = 200_000


def parts_of(rows: DataFrame) -> int:
    """Into how many parts ``rows`` are dealt so that a task's memory doesn't grow with them: of ``PART_ROWS`` at most, and one
    for each core."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` in ``parts`` by ``keys``; without a number the session's settings hold, whose parts grow with the rows."""
    return rows.repartition(parts, *keys) if parts else rows


def judge(hits: DataFrame, judgements: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Hits (keys, position, chunk_id, has_answer, comment, confidence) with judgements (keys, index, chunk_id, has_answer,
    comment, confidence, seq): a judgement of the chunk comes first, else the one at the hit's place; the first of several
    wins; hits that are judged already stay as they are. ``keys`` name the session; both joins are in ``parts``."""
    value = F.struct("has_answer", "comment", "confidence")
    first = lambda by: F.min_by(value, F.struct("seq", "index"))
    by_chunk = dealt(judgements.where("chunk_id is not null and chunk_id <> ''"), parts, *keys, "chunk_id").groupBy(*keys, "chunk_id").agg(first(0).alias("_c"))
    by_place = dealt(judgements.where("index is not null").withColumn("position", F.col("index").cast("long")), parts, *keys, "position").groupBy(*keys, "position").agg(first(0).alias("_p"))
    joined = dealt(hits, parts, *keys, "chunk_id").join(by_chunk, [*keys, "chunk_id"], "left")
    joined = dealt(joined, parts, *keys, "position").join(by_place, [*keys, "position"], "left")
    new = F.coalesce("_c", "_p")
    pick = lambda c: F.when(F.col("has_answer").isNotNull() | new.isNull(), F.col(c)).otherwise(new[c])
    return joined.withColumns({"comment": pick("comment"), "confidence": pick("confidence"), "has_answer": pick("has_answer")}).drop("_c", "_p")


def high_quality(judgements: DataFrame, least: float = HIGH_CONFIDENCE) -> DataFrame:
    return judgements.agg(F.count("*").alias("judged"), F.count_if(F.col("has_answer") & (F.col("confidence") >= least)).alias("high_quality"))


def cited(texts: DataFrame, key: str, text: str, references: DataFrame) -> DataFrame:
    """(key, place, number, target): every citation of a text with the reference (key, number, target) that it names; null
    without one."""
    found = texts.select(key, F.posexplode(citations(text)).alias("place", "number"))
    return found.join(references.select(key, "number", "target"), [key, "number"], "left").select(key, "place", "number", "target")


def new_references(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union that keeps the first row of every key; new rows without a key are left out."""
    marked = existing.withColumn("_new", F.lit(0)).unionByName(new.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_new", F.lit(1)))
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_new", order)))
    return ranked.where("_new = 0 or _n = 1").drop("_new", "_n")


def page_groups(chunks: DataFrame, file: str, page: str = "page", order: str = "ordinal") -> DataFrame:
    """(file, page, chunks, first, last): chunks by page, where no page is page 1."""
    return chunks.groupBy(file, F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)).alias("page")).agg(F.count("*").alias("chunks"), F.min(order).alias("first"), F.max(order).alias("last"))


def page_text(chunks: DataFrame, file: str, order: str = "ordinal", text: str = "chunk") -> DataFrame:
    """(file, text): a file's chunks joined in order."""
    return chunks.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def locate_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hit_id, chunk_id, how): the chunk of its file that a hit shows.

    In this order: the chunk of the hit's id; the first chunk on the hit's page (by its page, its first page, or one of its pages;
    page 0 is none); the chunk that was selected before, if the file still has it; the first chunk on the page that was shown
    before; the file's first chunk. ``hits`` (hit_id, file_id, chunk_id, page) may have previous_chunk and previous_page, ``chunks``
    (file_id, chunk_id, ordinal, page) may have page_start and page_numbers. A hit of a file without chunks has null."""
    pick = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    rows = hits.select("hit_id", "file_id", "chunk_id", F.nullif("page", F.lit(0)).alias("page"), pick(hits, "previous_chunk", chunks.schema["chunk_id"].dataType).alias("previous_chunk"), pick(hits, "previous_page", "long").alias("previous_page"))
    page, start = F.col("page").cast("long"), pick(chunks, "page_start", "long").cast("long")
    numbers = F.coalesce(pick(chunks, "page_numbers", "array<long>").cast("array<long>"), F.array().cast("array<long>"))
    first = F.min_by("chunk_id", F.struct("ordinal", "chunk_id"))
    on = lambda pages, name, page_of: chunks.select("file_id", "chunk_id", "ordinal", F.explode(F.array_distinct(pages)).alias(page_of)).groupBy("file_id", page_of).agg(first.alias(name))
    known = chunks.select("file_id", "chunk_id").distinct()
    out = rows.join(known.withColumn("_id", F.col("chunk_id")), ["file_id", "chunk_id"], "left")
    out = out.join(on(F.concat(F.array(page, start), numbers), "_paged", "page"), ["file_id", "page"], "left")
    out = out.join(known.select("file_id", F.col("chunk_id").alias("previous_chunk"), F.col("chunk_id").alias("_before")), ["file_id", "previous_chunk"], "left")
    out = out.join(on(F.concat(F.array(F.coalesce(page, start)), numbers), "_shown", "previous_page"), ["file_id", "previous_page"], "left")
    out = out.join(chunks.groupBy("file_id").agg(first.alias("_first")), "file_id", "left")
    steps = {"_id": "id", "_paged": "page", "_before": "previous", "_shown": "previous page", "_first": "first"}
    how = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in steps.items()))
    return out.select("hit_id", F.coalesce(*steps).alias("chunk_id"), how.alias("how"))
