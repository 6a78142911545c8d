"""Operator 11: a Merkle manifest of a table, by levels of windows.

A row's leaf is the digest of its fields. Leaves of one group (source) ascend by id; every ``fan_out`` consecutive nodes
become one parent until one node is left, the group's subroot; subroots in the order of their groups likewise give the
root. A level is one window: nodes are partitioned by group and parent index, and an ordered ``collect_list`` over the full
frame gives every node its run, which holds both the parent's preimage and the node's siblings. Parents are deduplicated
before the next level. A window holds ``fan_out`` nodes at most, so a group with a third of all rows is spread like others.

Positions in a group come from a range partitioning on (group, id) and one offset for each partition and group; no row is
counted by a single task, and only the number of levels reaches the driver. Proofs are handed down from the root: a level's
windows and the join with its parents' proofs share one partitioning, so leaves move once.

Edge cases: a null field is ``-``, an empty one ``0:``; a null group is a group of its own and comes first; equal ids follow
the order of their leaves, equal rows get neighbouring places and proofs of their own; a lone leaf is its group's subroot, a
lone subroot is the root (their proofs are empty); an empty table gives an empty result; long texts are hashed in place and
never moved; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.common import written

FAN_OUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field, fields)))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Add ``place`` (from 0, ascending in each ``group`` by ``id`` and ``node``) and ``size`` (rows of the group).

    ``rows`` is range-partitioned on (group, id, node, a row number), so equal rows and one hot group are split; a place is
    the row's place in its partition, less where the group begins there, plus the group's rows in partitions before."""
    ordered = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("group", "id", "node", "_row").sortWithinPartitions("group", "id", "node", "_row").drop("_row")
    ordered = written(ordered.select("*", F.monotonically_increasing_id().alias("_at")), name)
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part"), "group").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("group")
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "group", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("size"))
    starts = written(starts, f"{name}-starts")  # a row for each partition and group; Spark broadcasts it where that is small
    return ordered.withColumn("_part", part).join(starts, ["_part", "group"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def with_run(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Add the node's ``parent`` index and its ``run``: the digests of the nodes of one parent, in order."""
    full = Window.partitionBy("group", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("parent", F.floor(F.col("place") / fan_out).cast("long")).withColumn("run", F.collect_list("node").over(full))


def tree(leaves: DataFrame, fan_out: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of numbered nodes (group, place, size, node), leaves first, and (group, node) of the last node of each group."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = with_run(levels[-1].where("size > 1").select("group", "place", "size", "node"), fan_out)
        parents = runs.select("group", F.col("parent").alias("place"), F.ceil(F.col("size") / fan_out).cast("long").alias("size"), digest(F.array_join("run", "")).alias("node"))
        levels.append(written(parents.dropDuplicates(["group", "place"]), f"{name}-{len(levels)}"))
        most = -(-most // fan_out)
    tops = [level.where("size = 1").select("group", "node") for level in levels]
    last = tops[0]
    for top in tops[1:]:
        last = last.unionByName(top)
    return levels, last


def with_path(levels: list[DataFrame], above: DataFrame, fan_out: int) -> DataFrame:
    """The leaves with ``path``: for each level up to the root the digests left and right of the node, joined; ``above`` has
    (group, path, and what the group's rows are to carry) for the last node of each group."""
    place = (F.col("place") % fan_out).cast("int")
    own = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("left"), F.array_join(F.slice("run", place + 2, F.lit(fan_out)), "").alias("right"))
    carried = [c for c in above.columns if c not in ("group", "path")]
    upper = None
    for level in reversed(levels):
        known = level.where("size = 1").join(above, "group")
        if upper is not None:
            parents = upper.select("group", F.col("place").alias("parent"), F.col("path").alias("_up"), *carried)
            below = with_run(level.where("size > 1"), fan_out).join(parents, ["group", "parent"])
            below = below.withColumn("path", F.concat(F.array(own), "_up")).drop("_up", "run", "parent")
            known = known.unionByName(below)
        upper = known
    return upper


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", fan_out: int = FAN_OUT, tampered: list[Column] | None = None, when: Column | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, path, tampered_leaf) of every row. ``path`` is the proof: for each level the siblings'
    digests left and right of the row's node. ``tampered`` are the fields of a row as received, where ``when`` is true."""
    changed = F.when(F.coalesce(when, F.lit(False)), leaf(tampered)) if tampered else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # never null, and null comes first
    rows = written(docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf([F.col(c) for c in fields]).alias("node"), changed.alias("tampered_leaf")), "merkle-leaves")
    levels, subroots = tree(numbered(rows, "merkle-rows"), fan_out, "merkle-level")
    subroots = written(subroots, "merkle-subroots")
    # the subroots' own tree is one group, ordered by the groups' names
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("id"), "node")
    upper, root = tree(numbered(named, "merkle-groups"), fan_out, "merkle-upper")
    roots = root.select("group", F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = with_path(upper, roots, fan_out).select(F.col("id").alias("group"), F.col("node").alias("subroot"), "root", "path")
    out = with_path(levels, written(above, "merkle-above"), fan_out)
    return out.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", "tampered_leaf")


def proof(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root's."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x["left"], node, x["right"])))
