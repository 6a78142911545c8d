"""Ordered scans over long groups that no task holds: running sums, lines across chunk borders, joined text in segments.

A window over a key puts all rows of the key in one task. Here rows are range partitioned on (key, order), so a key with a third
of all rows lies in many partitions; each partition sums what it has of a key, and a small table of one row for each partition
and key carries the sums on. Joined text is made in segments of bounded length, with their offsets, so no row holds a whole
group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same key before this one in ``order``; null values count as 0.

    Keys may be null (a key of their own) and repeated. Ties in ``order`` are broken by the row's other columns, so equal rows
    are interchangeable. The partitions' sums depend on one range partitioning, which is kept by a checkpoint where the session
    has a folder for it, and by a cached table else."""
    columns = rows.columns
    plain = [c for c in columns if c not in (*keys, *order) and rows.schema[c].dataType.typeName() not in ("map", "variant")]
    by = [*keys, *order, *plain]
    ordered = rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = kept(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    key = F.struct(*keys).alias("_key")
    sums = ordered.groupBy(part.alias("_part"), key).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", "_key", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_part", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = ordered.withColumn("_part", part).withColumn("_key", F.struct(*keys))
    found = found.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    own = [F.col("_part") == F.col("c._part"), *(F.col(f"_key.{k}").eqNullSafe(F.col(f"c._key.{k}")) for k in keys)]
    carried = sums.select(F.struct("_part", "_key", "_carried").alias("c"))
    return found.join(carried, own).select(*columns, (F.col("_inside") + F.col("c._carried")).alias(name))


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` as they are now: a checkpoint in the shared folder, or a cached table without one."""
    context = rows.sparkSession.sparkContext
    where = context.getCheckpointDir() or rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if where is None:
        return rows.persist()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return rows.checkpoint()


def framed_lines(chunks: DataFrame, key: str = "stream", order: str = "n", chunk: str = "chunk", last: bool = False) -> DataFrame:
    """(key, line_no, line): the lines of streams that arrive in chunks, whose lines may cross chunk borders.

    A chunk's first part belongs to the line that is open when it arrives, whose number is the count of line ends before; only
    the parts of one line are gathered. What stands behind a stream's last line end is left out, unless ``last`` keeps it.
    Blank lines have numbers too but no row; a null chunk is empty; a stream without line ends has one open line."""
    rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("n"), F.coalesce(chunk, F.lit("")).alias("chunk"))
    breaks = F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"), F.lit("")))
    placed = running(rows, ["key"], ["n"], breaks, "lines")
    parts = placed.select("key", "n", "lines", F.posexplode(F.split("chunk", "\n", -1)).alias("at", "part"))
    line = (F.col("lines") + F.col("at")).alias("line_no")
    whole = parts.groupBy("key", line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("n", "at", "part")))), lambda x: x["part"]), "").alias("line"))
    if not last:
        ends = rows.groupBy("key").agg(F.sum(breaks).alias("_ends"))
        whole = whole.join(ends.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k"))).where("line_no < _ends").drop("_k", "_ends")
    return whole.where(F.trim("line") != "").select(F.col("key").alias(key), "line_no", "line")


def joined_segments(rows: DataFrame, key: str, order: str, text: str, separator: str = "", size: int = 65536) -> DataFrame:
    """(key, segment, start, text): the texts of each key joined in order, cut every ``size`` characters.

    Segments of a key, by number, are the joined text; ``start`` is a segment's place in it. A text that crosses a segment's
    border gives a part to each. Null texts are left out with their separator."""
    kept_rows = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("n"), F.concat(F.lit(separator), F.col(text)).alias("text"))
    placed = running(kept_rows, ["key"], ["n"], F.length("text"), "start").withColumn("start", F.col("start") - len(separator))  # none stands before the first
    end = F.col("start") + F.length("text")
    first, final = F.floor(F.greatest(F.lit(0), F.col("start")) / size), F.floor((end - 1) / size)
    parts = placed.where(end > 0).where(F.length("text") > 0).select("key", "n", "start", "text", F.explode(F.sequence(first, final)).alias("segment"))
    skipped = F.greatest(F.lit(0), F.col("segment") * size - F.col("start"))
    place = F.col("start") + skipped
    part = F.substring("text", (skipped + 1).cast("int"), ((F.col("segment") + 1) * size - place).cast("int"))
    out = parts.select("key", "segment", F.struct(place.alias("place"), "n", part.alias("part")).alias("x")).groupBy("key", "segment")
    joined = out.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("text"))
    return joined.select(F.col("key").alias(key), F.col("segment").cast("long").alias("segment"), (F.col("segment") * size).cast("long").alias("start"), "text")
