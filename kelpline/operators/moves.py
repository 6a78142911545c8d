"""Moves of files that collide with nothing, and their undoing.

A plan gives every file a target name that no other move and no file that stays has. Names that collide get a number before
the extension; a number may give a name that is taken as well, so ranks are given again, to what still collides, until nothing
does. A log of executed moves undoes them in reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.paths import base_name, parent
from kelpline.operators.scans import kept


def numbered(name: Column, number: Column) -> Column:
    """``report (2).pdf`` for the second ``report.pdf``; the first keeps its name."""
    stem, extension = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.when(number <= 1, name).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), extension))


def plan(files: DataFrame, folder: str, most_rounds: int = 100) -> DataFrame:
    """(path, target): where each of ``files`` (path, and the column ``folder``: where it is to go, null to stay) goes.

    Files are ranked by path among those that want the same name in the same folder; a file that is already where it should be
    stays, and what stays keeps its path. Each round, the first by path that wants a free name gets it and the others want the
    next number; a round with a free name settles at least one file of each name, and numbers rise past what is taken. A path
    stands once; null paths are left out; what is left after ``most_rounds`` is an error, never a clash."""
    one = files.where("path is not null").groupBy("path").agg(F.min(folder).alias("_to"))
    home = (F.col("_to").isNull()) | (F.concat(F.regexp_replace("_to", "/+$", ""), F.lit("/"), base_name("path")) == F.col("path"))
    taken = kept(one.where(home).select(F.col("path").alias("target")))
    open_ = one.where(~home).select("path", F.regexp_replace("_to", "/+$", "").alias("_to"), base_name("path").alias("_name"), F.lit(1).alias("_from"))
    done, open_ = None, kept(open_)
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        same = Window.partitionBy("_to", "_name", "_from").orderBy("path")
        wanted = open_.withColumn("_n", F.col("_from") + F.row_number().over(same) - 1)
        wanted = wanted.withColumn("target", F.concat("_to", F.lit("/"), numbered(F.col("_name"), F.col("_n"))))
        # two names may give one target ("a (2).txt" and the second "a.txt"): the first by path has it
        wanted = wanted.withColumn("_first", F.row_number().over(Window.partitionBy("target").orderBy("path")) == 1)
        free = wanted.join(taken.withColumn("_taken", F.lit(True)), "target", "left")
        free = kept(free.withColumn("_settled", F.col("_first") & F.col("_taken").isNull()))
        settled = free.where("_settled").select("path", "target")
        done = settled if done is None else done.unionByName(settled)
        taken = kept(taken.unionByName(settled.select("target")))
        # what collides goes on behind the highest number that its name wanted
        last = free.groupBy("_to", "_name").agg(F.max("_n").alias("_last"))
        open_ = kept(free.where("not _settled").join(last, ["_to", "_name"]).select("path", "_to", "_name", (F.col("_last") + 1).cast("int").alias("_from")))
    else:
        raise RuntimeError(f"names still collide after {most_rounds} rounds")
    return done if done is not None else one.select("path", F.col("path").alias("target")).limit(0)


def executed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``files`` with the paths that they have after ``moves`` (path, target)."""
    columns = files.columns
    return files.join(moves.select("path", "target"), "path", "left").withColumn("path", F.coalesce("target", "path")).select(columns)


def undone(files: DataFrame, log: DataFrame) -> DataFrame:
    """``files`` with the paths that they had before the moves of ``log``."""
    return executed(files, log.select(F.col("target").alias("path"), F.col("path").alias("target")))


def emptied(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(folder): folders that hold no file any more after the moves."""
    before, after = files.select(parent("path").alias("folder")), executed(files, moves).select(parent("path").alias("folder"))
    return before.distinct().join(after.distinct(), "folder", "left_anti")
