"""Path trees and where activity concentrates. A tree is rows (folder, depth, parent), never a nested structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.labels import percent, short_name
from kelpline.functions.paths import ancestors, meaningful_folder, parent, project, segments
from kelpline.model import SAMPLE_NAMES, SAMPLED_FILES, TOP_FOLDERS


def tree_rollup(files: DataFrame, folder_of: Column, root: str = "") -> DataFrame:
    """(folder, depth, direct_files, direct_bytes, total_files, total_bytes, latest) of every folder with files below it.

    Files are first summed by their own folder, so the explosion to ancestors is as long as the number of folders."""
    own = files.groupBy(folder_of.alias("_own")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.max("modified_at").alias("m"))
    rows = own.select("*", F.explode(ancestors("_own")).alias("folder")).where(F.col("folder").startswith(root) if root else F.lit(True))
    here = F.col("folder") == F.concat(F.lit("/"), F.array_join(segments("_own"), "/"))
    zero = lambda c: F.sum(F.when(here, F.col(c)).otherwise(0))
    out = rows.groupBy("folder").agg(zero("n").alias("direct_files"), zero("b").alias("direct_bytes"), F.sum("n").alias("total_files"), F.sum("b").alias("total_bytes"), F.max("m").alias("latest"))
    return out.withColumn("depth", F.size(segments("folder")))


def registered_tree(files: DataFrame, folders: DataFrame, path_col: str = "folder_path") -> DataFrame:
    """(folder, registered, own_files, all_files): registered folders and the folders above them, with the counts of files
    whose deepest registered folder is at or below each. ``files`` has ``folder_path`` of that deepest folder."""
    own = files.where(F.col(path_col).isNotNull()).groupBy(path_col).agg(F.count("*").alias("n"))
    held = folders.select(path_col).distinct().join(own, path_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = held.select(path_col, "n", F.explode(ancestors(path_col)).alias("folder"))
    here = F.col("folder") == F.col(path_col)
    return rows.groupBy("folder").agg(F.bool_or(here).alias("registered"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("own_files"), F.sum("n").alias("all_files"))


def filtered_tree(files: DataFrame, folder_of: Column, matches: Column) -> DataFrame:
    """(folder, matched, total): folders that hold a matching file at any depth below."""
    own = files.groupBy(folder_of.alias("_own")).agg(F.count_if(matches).alias("k"), F.count("*").alias("n"))
    rows = own.select("k", "n", F.explode(ancestors("_own")).alias("folder"))
    return rows.groupBy("folder").agg(F.sum("k").alias("matched"), F.sum("n").alias("total")).where("matched > 0")


def project_insights(files: DataFrame, top: int = 5) -> DataFrame:
    """(project, files, bytes, kind, percent): the top projects with 5 % of the files or 50 files, and their main kind."""
    by_kind = files.groupBy(project(parent("path")).alias("project"), "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    sums = by_kind.groupBy("project").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.min(F.struct((-F.col("n")).alias("minus"), "kind")).alias("x"))
    total = F.broadcast(by_kind.agg(F.sum("n").alias("_total")))  # one row
    first = sums.orderBy(F.desc("files"), "project").limit(top).join(total)
    share = percent(F.col("files"), F.col("_total"))
    return first.select("project", "files", "bytes", F.col("x.kind").alias("kind"), share.alias("percent")).where("percent >= 5 or files >= 50")


def hotspots(files: DataFrame, top: int = TOP_FOLDERS, order: list[str] | None = None) -> DataFrame:
    """(folder, label, files, bytes, percent, kind, samples, covered): the folders with most files. The main kind and the
    sample names come from a folder's first ten files in ``order`` (by default the path); ``covered`` is the share of all
    files in the folders listed. Only the files of listed folders are ranked."""
    order = order or ["path"]
    groups = files.groupBy(parent("path").alias("folder")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    total = F.broadcast(groups.agg(F.sum("files").alias("_total")))  # one row
    first = groups.orderBy(F.desc("files"), "folder").limit(top)
    rows = files.select(parent("path").alias("folder"), "name", "kind", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = rows.join(F.broadcast(first.select("folder")), "folder", "left_semi")  # as many rows as are listed
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy(*[f"_o{i}" for i in range(len(order))]))).where(F.col("r") <= SAMPLED_FILES)
    kinds = ranked.groupBy("folder", "kind").agg(F.count("*").alias("k"), F.min("r").alias("at")).groupBy("folder").agg(F.min(F.struct((-F.col("k")).alias("minus"), "at", "kind")).alias("x"))
    samples = ranked.where(F.col("r") <= SAMPLE_NAMES).groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", short_name("name").alias("s")))), lambda x: x["s"]), ", ").alias("samples"))
    out = first.join(kinds, "folder").join(samples, "folder").join(total)
    covered = F.broadcast(first.agg(F.sum("files").alias("_covered")))  # one row
    out = out.join(covered)
    return out.select("folder", meaningful_folder("folder").alias("label"), "files", "bytes", percent(F.col("files"), F.col("_total")).alias("percent"), F.col("x.kind").alias("kind"), "samples", percent(F.col("_covered"), F.col("_total")).alias("covered"))


def by_kind_moves(files: DataFrame) -> DataFrame:
    """(target, files, bytes): a dry run of sorting files by kind (our definition); no kind is ``Uncategorized``."""
    return files.groupBy(F.coalesce(F.nullif("kind", F.lit("")), F.lit("Uncategorized")).alias("target")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
