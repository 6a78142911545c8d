"""Subtrees by parent links, and sibling orders by language rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators.scans import kept


def subtree(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the folders (id, parent) that are, or lie below, one of ``roots`` (id).

    Links are doubled: after k rounds a folder knows whether one of the 2 ** k folders above it is a root, so a chain of any
    length takes as many rounds as its length has bits, and a wide tree takes few. A link to itself, to no folder or to null ends
    there; a cycle without a root is outside, one with a root is inside, and rounds end at the number of folders at the latest.
    A root that is no folder has no rows; repeated folders count once, with their first parent."""
    one = folders.groupBy("id").agg(F.min("parent").alias("parent")).where("id is not null")
    marked = one.join(roots.select("id").distinct().withColumn("_root", F.lit(True)), "id", "left")
    state = kept(marked.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("up"), F.coalesce("_root", F.lit(False)).alias("inside")))
    rounds = max(1, state.count()).bit_length()
    for _ in range(rounds):
        open_ = state.where("up is not null and not inside")
        if open_.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("inside").alias("_in"))
        stepped = open_.join(above, "up", "left").select("id", F.col("_next").alias("up"), F.coalesce("_in", F.lit(False)).alias("inside"))
        state = kept(state.where("up is null or inside").unionByName(stepped))
    return state.where("inside").select("id")


def files_below(files: DataFrame, folder: str, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """The files whose folder is in a subtree of ``roots``."""
    return files.join(subtree(folders, roots).withColumnRenamed("id", folder), folder, "left_semi")


#: Orders of names: by letters, then accents, then case; or by letters alone.
FULL, BASE = "UNICODE", "UNICODE_CI_AI"


def collated(name: Column | str, rule: str = FULL, numeric: bool = False) -> Column:
    """A name that sorts and compares by the rules of a language; ``numeric`` puts 2 before 10."""
    value = F.col(name) if isinstance(name, str) else name
    if numeric:  # runs of digits get one width
        parts = F.regexp_extract_all(value, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
        value = F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")
    return F.collate(value, rule)


def locale_places(rows: DataFrame, group: str, name: str, key: str, rule: str = FULL, numeric: bool = False, folders_first: str | None = None) -> DataFrame:
    """``rows`` with ``place``: the order of siblings by name, ties by their characters and then by ``key``; ``folders_first``
    names a column of flags that come first."""
    order = [F.desc(folders_first)] if folders_first else []
    w = Window.partitionBy(group).orderBy(*order, collated(name, rule, numeric), F.col(name), F.col(key))
    return rows.withColumn("place", F.row_number().over(w))


def same_names(rows: DataFrame, group: str, name: str, key: str) -> DataFrame:
    """(group, first, n): names of siblings that are equal but for case and accents, where there are several."""
    same = rows.groupBy(group, collated(name, BASE).alias("_name")).agg(F.min(F.col(name)).alias("first"), F.count(key).alias("n"))
    return same.where("n > 1").select(group, "first", "n")
