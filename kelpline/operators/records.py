"""Small filters, lookups and sums on keys, assets, steps, cards and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.paths import col

# Extensions of images that may be read.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg", ".ico"]
LOG_LINES, LAST_EVENTS = 60, 4


def is_image(path: Column | str) -> Column:
    """Whether a path ends in an allowed image extension, without case."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1)).isin(IMAGE_EXTENSIONS)


def active_key(keys: DataFrame, name: str) -> DataFrame:
    """The key (id, name, is_active, is_system) of that name that is active and not the system's: the smallest id, or none."""
    return keys.where((F.col("name") == name) & F.col("is_active") & ~F.col("is_system")).orderBy("id").limit(1)


def external_keys(keys: DataFrame) -> DataFrame:
    """(name, is_active) of keys that aren't the system's."""
    return keys.where(~F.col("is_system")).select("name", "is_active")


def assets(descriptors: DataFrame, known: DataFrame) -> DataFrame:
    """(id, to_download, missing) per descriptor (id, optional) from ``known`` (id, exists): one that isn't there is to be
    downloaded, and missing if it isn't optional."""
    here = known.groupBy("id").agg(F.bool_or("exists").alias("_here"))
    absent = ~F.coalesce("_here", F.lit(False))
    return descriptors.join(here, "id", "left").select("id", absent.alias("to_download"), (absent & ~F.coalesce("optional", F.lit(False))).alias("missing"))


def visible(rows: DataFrame, local: bool) -> DataFrame:
    """Private rows are for local readers; a null privacy is public."""
    return rows if local else rows.where(F.coalesce("privacy", F.lit("normal")) != "private")


def card_counts(by_kind: DataFrame, key: str) -> DataFrame:
    """(key, documents, total, others): documents that are neither mail nor notes, with what waits, and the other kinds; no
    count falls below zero."""
    floor = lambda c: F.greatest(F.lit(0).cast("long"), c)
    documents = floor(F.col("document") - F.col("mail") - F.col("notes"))
    return by_kind.select(key, documents.alias("documents"), (documents + floor(F.col("pending"))).alias("total"), floor(F.col("other") + F.col("archive") + F.col("presentation")).alias("others"))


def last_completed(steps: DataFrame) -> DataFrame:
    """(session, time) of the last complete step (session, position, status, time) that has a time; 0 without one."""
    done = F.when((F.col("status") == "complete") & F.col("time").isNotNull() & (F.col("time") != 0), F.struct("position", "time"))
    return steps.groupBy("session").agg(F.max(done).alias("x")).select("session", F.coalesce("x.time", F.lit(0)).cast("long").alias("time"))


def by_confidence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with their place by falling confidence within ``keys``, where none counts as 0."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), order)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def log_tail(lines: Column | str, most: int = LOG_LINES) -> Column:
    """The last lines of an array, of which one equal to the line before it is left out."""
    a = col(lines)
    kept = F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))
    return F.slice(kept, F.greatest(F.size(kept) - most, F.lit(0)) + 1, F.lit(most))


def last_reversed(events: Column | str, most: int = LAST_EVENTS) -> Column:
    a = col(events)
    return F.reverse(F.slice(a, F.greatest(F.size(a) - most, F.lit(0)) + 1, F.lit(most)))


def named(texts: Column | str) -> Column:
    """An array without its null and empty items."""
    return F.filter(col(texts), lambda x: x.isNotNull() & (x != ""))


def relevant_count(results: Column | str) -> Column:
    """How many results (relevant) are relevant."""
    return F.size(F.filter(col(results), lambda r: F.coalesce(r["relevant"], F.lit(False)))).cast("long")


def privacy_counts(folders: DataFrame) -> DataFrame:
    """(normal, private) folders, in one row; a null privacy is normal."""
    private = F.coalesce(F.col("privacy") == "private", F.lit(False))
    return folders.agg(F.count_if(~private).alias("normal"), F.count_if(private).alias("private"))


def day_bounds(time: Column | str, zone: str) -> tuple[Column, Column]:
    """The first and last minute, in UTC, of the day of a zone that holds a UTC time."""
    local = F.from_utc_timestamp(col(time), zone)
    first = F.date_trunc("day", local)
    return F.to_utc_timestamp(first, zone), F.to_utc_timestamp(first + F.expr("interval 23 hours 59 minutes"), zone)


def nested_sizes(rows: DataFrame, keys: list[str], nested: str) -> DataFrame:
    """(keys, rows, items): how many rows a group has, and how many items their arrays hold together; a null array holds none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(F.coalesce(nested, F.array()))), F.lit(0)).alias("items"))


def keys_or_new(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, created) for every distinct asked name: the smallest id of its active keys that aren't the system's; a name
    without one is to be created, and its id is null until then."""
    known = keys.where("is_active and not is_system").groupBy("name").agg(F.min("id").alias("id"))
    return names.select("name").distinct().join(known, "name", "left").withColumn("created", F.col("id").isNull())
