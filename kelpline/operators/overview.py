"""Filters and counts behind overviews: categories, accounts, queues, parents, memories, plans of an index run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.paths import col, parent


def of_category(files: DataFrame, category: str = "all") -> DataFrame:
    """Files (kind) without program code, of one kind or of ``all``."""
    rows = files.where(F.coalesce("kind", F.lit("")) != "code")
    return rows if category == "all" else rows.where(F.col("kind") == category)


def of_status(files: DataFrame, status: str = "all") -> DataFrame:
    """Files (status) that are ``not_indexed`` (also those in error), or, by any other name but ``all``, indexed or waiting."""
    tests = {"all": F.lit(True), "not_indexed": F.col("status").isin("not_indexed", "error")}
    return files.where(tests.get(status, F.col("status").isin("fast", "deep", "pending")))


def shown(paragraphs: DataFrame, display: str = "all") -> DataFrame:
    """Paragraphs (human, computer) with a text of the chosen speaker; ``all`` shows every one."""
    return paragraphs if display == "all" else paragraphs.where(F.coalesce(F.col(display), F.lit("")) != "")


def without_account(messages: DataFrame, account: int | str) -> DataFrame:
    """Messages (account_id) of other accounts; those of none stay."""
    return messages.where(~F.col("account_id").eqNullSafe(F.lit(account)))


def not_in_tree(queue: DataFrame, files: DataFrame) -> DataFrame:
    """Queue items (folder_id, path) whose path isn't among the folder's files (folder_id, path)."""
    return queue.join(files.select("folder_id", "path"), ["folder_id", "path"], "left_anti")


def nth_results(citations: DataFrame, results: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """``citations`` (key, number) with the result (key, order, target) that stands at that number, null without one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    return citations.join(results.select(key, place.alias("number"), target), [key, "number"], "left")


def newest(rows: DataFrame, key: str, time: str, order: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows of every key with their place; ties go by ``order``, rows without a time come last."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(time), order)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def memory_summary(tables: dict[str, DataFrame], user: str) -> DataFrame:
    """(user, one count per table): rows of every table by user, zero without one."""
    rows = None
    for name, df in tables.items():
        part = df.groupBy(user).agg(F.count("*").alias("n")).withColumn("t", F.lit(name))  # counted before the union's shuffle
        rows = part if rows is None else rows.union(part)
    counts = [F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables]
    return rows.groupBy(user).agg(*counts)


def stage_errors(progress: DataFrame, stages: list[str]) -> Column:
    """Errors of all stages (structs with ``error``) of a row; a missing one counts as none."""
    total = F.lit(0).cast("long")
    for stage in stages:
        total = total + F.coalesce(F.col(stage)["error"], F.lit(0))
    return total


def by_parent(paths: DataFrame, path: str = "path") -> DataFrame:
    """(parent_path, files, first): distinct parents of the paths with how many and the first; a bare name's parent is empty."""
    folder = F.coalesce(parent(path), F.lit(""))
    return paths.groupBy(folder.alias("parent_path")).agg(F.count("*").alias("files"), F.min(path).alias("first"))


def asset_group(asset_id: Column | str, audio: bool = False) -> Column:
    """The group of an asset by parts of its id; audio models are a group only if asked for."""
    a = col(asset_id)
    groups = F.when(a.contains("vlm") | a.contains("mmproj"), "vlm").when(a.contains("embedding"), "embedding").when(a.contains("reranker") | a.contains("bge"), "reranker")
    return (groups.when(a.contains("whisper"), "audio") if audio else groups).otherwise("other")


def asset_sizes(assets: DataFrame, audio: bool = False) -> DataFrame:
    """(group, assets, bytes, ready) of assets (id, size, exists): an unknown size is 0; a group is ready if all are there."""
    return assets.groupBy(asset_group("id", audio).alias("group")).agg(F.count("*").alias("assets"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.bool_and(F.coalesce("exists", F.lit(False))).alias("ready"))


def folder_queue(folders: DataFrame, items: DataFrame) -> DataFrame:
    """(folder_id, processing, pending, queued, first_processing) of every folder; items have (folder_id, seq, path, status). The first
    item is that of the smallest ``seq``, and of the smallest path among those."""
    first = F.min(F.when(F.col("status") == "processing", F.struct("seq", "path")))["path"]
    sums = items.groupBy("folder_id").agg(F.count_if(F.col("status") == "processing").alias("processing"), F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("queued"), first.alias("first_processing"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("processing", "pending", "queued")]
    return folders.select("folder_id").distinct().join(sums, "folder_id", "left").select("folder_id", *zero, "first_processing")


def evidence(results: DataFrame, key: str) -> DataFrame:
    """(key, file, place, text) of ``results`` (key, items array of (file, evidence array)): the evidence of all items."""
    items = results.select(key, F.explode("items").alias("i"))
    return items.select(key, F.col("i.file").alias("file"), F.posexplode("i.evidence").alias("place", "text"))


def index_plan(requests: DataFrame) -> DataFrame:
    """``requests`` (mode, scope, folders, purge_folders, drop_collection) with what they leave out: a run that drops or
    purges is a ``reindex``, else a ``rescan``; one with folders has the scope ``folder``, else ``global``; a reindex of
    folders purges them."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    mode = F.coalesce("mode", F.when(F.coalesce("drop_collection", F.lit(False)) | some("purge_folders"), "reindex").otherwise("rescan"))
    scope = F.coalesce("scope", F.when(some("folders"), "folder").otherwise("global"))
    rows = requests.withColumns({"mode": mode, "scope": scope})
    own = F.when((F.col("mode") == "reindex") & (F.col("scope") != "global"), F.coalesce("folders", F.array().cast("array<string>")))
    return rows.withColumn("purge_folders", F.coalesce("purge_folders", own))


def between(rows: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; a bound that is left out doesn't bind."""
    rows = rows.where(F.col(time) >= F.lit(start).cast("timestamp")) if start else rows
    return rows.where(F.col(time) <= F.lit(end).cast("timestamp")) if end else rows


def daily_summary(rows: DataFrame, time: str, kind: str) -> DataFrame:
    """(day, kind, rows, first, last) of a timeline."""
    return rows.groupBy(F.to_date(time).alias("day"), kind).agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))
