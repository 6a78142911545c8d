"""Files joined with folders, index records and queues, and what folders add up to.

Joins are plain equi-joins, so Spark picks a broadcast by the measured size of a side or splits hot keys at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.labels import half_up, index_status
from kelpline.functions.paths import ancestors, col


def with_folder(files: DataFrame, folders: DataFrame, key: str = "folder_id", label: str = "label") -> DataFrame:
    """Every file with its folder's label as ``location``; ``Unknown`` without one."""
    names = folders.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    return files.join(names, F.col(key) == F.col("_key"), "left").withColumn("location", F.coalesce("_label", F.lit("Unknown"))).drop("_key", "_label")


def with_index_status(files: DataFrame, indexed: DataFrame, queue: DataFrame, key: str = "path") -> DataFrame:
    """``index_status`` of every scanned file from index records (key, status, strategy, vision) and queued keys."""
    known = indexed.select(F.col(key).alias("_k"), F.col("status").alias("_status"), F.col("strategy").alias("_strategy"), F.col("vision").alias("_vision"))
    waits = queue.select(F.col(key).alias("_q")).distinct()
    joined = files.join(known, F.col(key) == F.col("_k"), "left").join(waits, F.col(key) == F.col("_q"), "left")
    status = index_status(F.col("_q").isNotNull(), F.col("_k").isNotNull(), F.col("_status"), F.col("_strategy"), F.col("_vision"))
    return joined.withColumn("index_status", status).drop("_k", "_status", "_strategy", "_vision", "_q")


def matches_any(files: DataFrame, items: DataFrame, keys: list[tuple[Column, Column]], row_key: str) -> DataFrame:
    """Rows of ``files`` for which any of the key pairs is equal to one of ``items``; the same rows as a join on the
    disjunction, without its nested loop. Null keys match nothing."""
    found = None
    for own, other in keys:
        part = files.select(F.col(row_key).alias("_row"), own.alias("_own")).join(items.select(other.alias("_other")).distinct(), F.col("_own") == F.col("_other"), "left_semi").select("_row")
        found = part if found is None else found.union(part)
    return files.join(found.distinct(), F.col(row_key) == F.col("_row"), "left_semi")


def deepest_folder(files: DataFrame, folders: DataFrame, folder_of: Column, path_col: str = "folder_path", row_key: str = "path") -> DataFrame:
    """(row_key, folder_path) of every file: the most specific registered folder above it; null if there is none. Ancestors
    belong to folders, so those of the distinct ones are joined by equality, a linear form of the prefix join."""
    own = files.select(F.col(row_key), folder_of.alias("_own"))
    rows = own.select("_own").distinct().select("_own", F.explode(ancestors("_own")).alias("_at"))
    known = folders.select(F.col(path_col).alias("_folder")).distinct()
    hit = rows.join(known, F.col("_at") == F.col("_folder")).groupBy("_own").agg(F.max_by("_folder", F.length("_folder")).alias(path_col))
    return own.join(hit, "_own", "left").select(row_key, path_col)


def inside_any(files: DataFrame, folders: DataFrame, folder_of: Column, path_col: str = "folder_path", row_key: str = "path") -> DataFrame:
    """Files inside a registered folder, at segment borders."""
    own = files.withColumn("_own", folder_of)
    rows = own.select("_own").distinct().select(F.col("_own").alias("_inside"), F.explode(ancestors("_own")).alias("_at"))
    found = rows.join(folders.select(F.col(path_col).alias("_folder")).distinct(), F.col("_at") == F.col("_folder"), "left_semi").select("_inside").distinct()
    return own.join(found, F.col("_own") == F.col("_inside"), "left_semi").drop("_own")


def folder_counters(files: DataFrame, queue: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder_id, files, queued, known): files of unknown folders make a row, queue rows of unknown folders are left out."""
    held = files.groupBy("folder_id").agg(F.count("*").alias("files"))
    waiting = queue.groupBy("folder_id").agg(F.count("*").alias("queued"))
    ids = folders.select("folder_id", F.lit(True).alias("known")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.join(held, "folder_id", "full").join(waiting, "folder_id", "left").select("folder_id", zero("files"), zero("queued"), F.coalesce("known", F.lit(False)).alias("known"))


def folder_progress(files: DataFrame) -> DataFrame:
    """(folder_id, total, indexed, errors, pending, percent); a null status counts as indexed."""
    status = F.coalesce("status", F.lit("indexed"))
    out = files.groupBy("folder_id").agg(F.count("*").alias("total"), F.count_if(status == "indexed").alias("indexed"), F.count_if(status == "error").alias("errors"), F.count_if(status == "pending").alias("pending"))
    return out.withColumn("percent", F.least(half_up(100 * F.col("indexed") / F.col("total")), F.lit(100)).cast("long"))


def queue_status(items: DataFrame, order: str = "seq") -> DataFrame:
    """(path, status): processing beats pending, otherwise the first item wins."""
    ranked = F.struct((F.col("status") != "processing").cast("int").alias("r"), F.col(order).alias("o"), "status")
    later = F.when(F.col("status").isin("processing", "pending"), ranked).otherwise(F.struct(F.lit(2).alias("r"), F.col(order).alias("o"), "status"))
    first = F.min(F.struct(F.col(order).alias("o"), "status")).alias("first")
    return items.where("path is not null").groupBy("path").agg(first, F.min(later).alias("best")).select("path", F.when((F.col("first.status") == "pending") & (F.col("best.r") == 0), "processing").otherwise(F.col("first.status")).alias("status"))


def sync_config(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, change): added keys that only ``found`` has, removed keys that only ``known`` has."""
    new = found.join(known, key, "left_anti").select(key, F.lit("added").alias("change"))
    return new.union(known.join(found, key, "left_anti").select(key, F.lit("removed").alias("change")))


def outside(files: DataFrame, expected: list[str], path: str = "path") -> DataFrame:
    """Files in none of the expected folders."""
    found = F.lit(False)
    for p in expected:
        found = found | col(path).startswith(p.rstrip("/") + "/")
    return files.where(~found)


def category_totals(files: DataFrame, kinds: list[str]) -> DataFrame:
    """(category, files, bytes) of listed kinds, zero-filled, and ``all`` with every file."""
    sums = [F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")]
    groups = files.where(F.col("kind").isin(kinds)).groupBy(F.col("kind").alias("category")).agg(*sums)
    listed = files.sparkSession.createDataFrame([(k,) for k in kinds], "category string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(groups, "category", "left").select("category", zero("files"), zero("bytes")).union(files.agg(*sums).select(F.lit("all"), "files", "bytes"))


def stage_counts(files: DataFrame) -> DataFrame:
    """One row of index progress from stage codes (our definition): per stage the total, done, pending, failed and percent.
    Code -1 is failed, 0 pending; fast 1 is text done, 2 embedding done; deep 1 or more is done."""
    def part(name: str, code: str, least: int) -> list[Column]:
        done = F.count_if(F.col(code) >= least)
        return [done.alias(f"{name}_done"), F.count_if(F.col(code) == -1).alias(f"{name}_error"), F.count_if(F.coalesce(F.col(code), F.lit(0)).between(0, least - 1)).alias(f"{name}_pending"), F.coalesce(half_up(100 * F.try_divide(done, F.count("*"))), F.lit(0)).alias(f"{name}_percent")]

    return files.agg(F.count("*").alias("total"), *part("text", "fast_stage", 1), *part("embed", "fast_stage", 2), *part("deep", "deep_stage", 1))


def asset_groups(assets: DataFrame, order: list[str]) -> DataFrame:
    """(group_name, ready, bytes, place): a group is ready if all its assets exist; unknown groups come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("group_name"))
    return assets.groupBy("group_name").agg(F.bool_and("present").alias("ready"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes")).withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1))


def first_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def status_order(processing: Column, status: Column) -> list[Column]:
    """Sort keys: what is processed first, then error, pending, indexed."""
    return [processing.desc(), F.when(status == "error", 0).when(status == "pending", 1).otherwise(2).asc()]


def pinned_page(rows: DataFrame, pinned: Column, order: list[Column], n: int = 30) -> DataFrame:
    """The first ``n`` rows in order, with a pinned row in any case first."""
    return rows.orderBy(pinned.desc(), *order).limit(n)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``changes`` are replaced, the others stay, new ones are added."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)
