"""Activity over time. ``files`` has (path, name, extension, kind, size, modified_at) or the columns named in a docstring;
timestamps are read in the session's time zone. Ties go to the smallest key. Empty inputs give empty or zero rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.labels import half_up, hour_range, percent
from kelpline.functions.paths import meaningful_folder, parent, segments, words
from kelpline.model import DAY_CAP, GENERIC_FOLDERS, HOUR_CAP, WEEKDAYS


def totals(files: DataFrame) -> DataFrame:
    """One row: files, bytes, active days, distinct extensions, files per active day, per month."""
    days = F.countDistinct(F.to_date("modified_at"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), days.alias("active_days"), F.countDistinct(F.nullif(F.lower("extension"), F.lit(""))).alias("extensions")).select(
        "files", "bytes", "active_days", "extensions", (F.col("files") / F.greatest("active_days", F.lit(1))).alias("per_day"), half_up(F.col("files") / 12).alias("per_month"), (F.col("bytes") / 12).alias("bytes_per_month")
    )


def month_buckets(files: DataFrame) -> DataFrame:
    """Twelve rows (month from 0, files, bytes), all years together."""
    found = files.where("modified_at is not null").groupBy((F.month("modified_at") - 1).cast("long").alias("month")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return files.sparkSession.range(12).withColumnRenamed("id", "month").join(found, "month", "left").select("month", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def daily_counts(files: DataFrame) -> DataFrame:
    """(day, files, weekday from Sunday = 0, week of the year from 0)."""
    days = files.where("modified_at is not null").groupBy(F.to_date("modified_at").alias("day")).agg(F.count("*").alias("files"))
    return days.select("day", "files", (F.dayofweek("day") - 1).alias("weekday"), F.floor(F.datediff("day", F.trunc("day", "year")) / 7).alias("week"))


def busiest_day(files: DataFrame) -> DataFrame:
    """One row: the day with most files, the earliest of several."""
    return daily_counts(files).orderBy(F.desc("files"), "day").limit(1)


def busiest_day_kinds(files: DataFrame) -> DataFrame:
    day = F.broadcast(busiest_day(files).select("day"))  # one row
    return share_by(files.join(day, F.to_date("modified_at") == F.col("day"), "left_semi"), F.col("kind"), "kind")


def share_by(files: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, files, bytes, percent of all files) by a key; null is ``unknown``."""
    groups = files.groupBy(F.coalesce(key, F.lit("unknown")).alias(name)).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    total = F.broadcast(groups.agg(F.sum("files").alias("_total")))  # one row
    return groups.join(total).select(name, "files", "bytes", percent(F.col("files"), F.col("_total")).alias("percent"))


def capped_weekdays(files: DataFrame, cap: int = DAY_CAP) -> DataFrame:
    """One row: the busiest and laziest weekday by counts of at most ``cap`` a day, and their shares."""
    by_weekday = daily_counts(files).groupBy("weekday").agg(F.sum(F.least("files", F.lit(cap))).alias("n"))
    one = by_weekday.agg(F.max(F.struct("n", (-F.col("weekday")).alias("w"))).alias("hi"), F.min(F.struct("n", F.col("weekday").alias("w"))).alias("lo"), F.sum("n").alias("total"))
    named = lambda w: F.get(words(WEEKDAYS), w)
    return one.select(named(-F.col("hi.w")).alias("busy_day"), F.col("hi.n").alias("busy_count"), percent(F.col("hi.n"), F.col("total")).alias("busy_percent"), named(F.col("lo.w")).alias("lazy_day"), F.col("lo.n").alias("lazy_count"), percent(F.col("lo.n"), F.col("total")).alias("lazy_percent"))


def capped_hour(files: DataFrame, cap: int = HOUR_CAP) -> DataFrame:
    """One row: the most active hour by counts of at most ``cap`` an hour of a day."""
    groups = files.where("modified_at is not null").groupBy(F.to_date("modified_at").alias("day"), F.hour("modified_at").alias("hour")).agg(F.count("*").alias("n"))
    hours = groups.groupBy("hour").agg(F.sum(F.least("n", F.lit(cap))).alias("n"))
    one = hours.agg(F.max(F.struct("n", (-F.col("hour")).alias("h"))).alias("hi"), F.sum("n").alias("total"))
    return one.select(hour_range(-F.col("hi.h")).alias("hour"), F.col("hi.n").alias("files"), percent(F.col("hi.n"), F.col("total")).alias("percent"))


def night_owl(files: DataFrame, key: str = "path") -> DataFrame:
    """At most one row: the file between 22:00 and 05:00 that is nearest to 05:00."""
    hour, minute = F.hour("modified_at"), F.minute("modified_at")
    left = F.when(hour >= 22, (29 - hour) * 60 - minute).when(hour < 5, (5 - hour) * 60 - minute)
    return files.withColumn("minutes_to_five", left).where("minutes_to_five is not null").orderBy("minutes_to_five", key).limit(1)


def calendar_grid(files: DataFrame, year: int) -> DataFrame:
    """53 weeks of 7 days from the Sunday on or before January 1: (week, weekday, day, in_year, files, level)."""
    first = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    start = F.date_sub(first, F.dayofweek(first) - 1)
    days = files.sparkSession.range(53 * 7).select(F.floor(F.col("id") / 7).alias("week"), (F.col("id") % 7).cast("int").alias("weekday"), F.date_add(start, F.col("id").cast("int")).alias("day"))
    counts = daily_counts(files.where((F.col("modified_at") >= F.make_date(F.lit(year - 1), F.lit(12), F.lit(25))) & (F.col("modified_at") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(8))))).select("day", "files")
    from kelpline.functions.labels import activity_level

    n = F.coalesce("files", F.lit(0))
    return days.join(counts, "day", "left").select("week", "weekday", "day", (F.year("day") == year).alias("in_year"), n.alias("files"), activity_level(n).alias("level"))


def month_positions(grid: DataFrame) -> DataFrame:
    """(month, week): the weeks of a calendar grid in which a new month begins, without a leading December."""
    first = grid.where("in_year").groupBy("week").agg(F.month(F.min("day")).alias("month"))
    axis = first.withColumn("before", F.lag("month").over(Window.orderBy("week")))  # 53 rows at most
    return axis.where("before is null or before <> month").where("not (before is null and month = 12)").select("month", "week")


def oldest_per_kind(files: DataFrame) -> DataFrame:
    """One file of each kind: the oldest whose name says something, else the oldest."""
    name = F.lower("name")
    generic = name.rlike(r"^(img_|dsc_|screenshot|screen shot|untitled|新建)") | name.rlike(r"^\d+\.\w+$")
    best = F.min(F.struct(generic.alias("generic"), "modified_at", "path", "name", "size"))
    return files.where("modified_at is not null").groupBy("kind").agg(best.alias("x")).select("kind", "x.path", "x.name", "x.modified_at", "x.size")


def largest_files(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.desc("size"), "path").limit(n).select("path", "name", "size")


def month_highlights(files: DataFrame) -> DataFrame:
    """For each month: the most frequent folder with a meaningful name, and the largest file of 1 KB or more, first from
    folders that are not generic; null where there is none. The folder decides both, so files are read once, by month and
    folder, and names are made for distinct folders."""
    best = F.min(F.when(F.col("size") >= 1024, F.struct((-F.col("size")).alias("minus"), "path"))).alias("best")
    found = files.where("modified_at is not null").groupBy((F.month("modified_at") - 1).alias("month"), parent("path").alias("folder_path")).agg(F.count("*").alias("n"), best)
    generic = lambda c: F.array_contains(words(GENERIC_FOLDERS), c)
    last = F.coalesce(F.get(segments("folder_path"), F.size(segments("folder_path")) - 1), F.lit(""))
    named = found.select("month", "n", "best", meaningful_folder("folder_path").alias("folder"), generic(last).alias("generic"))
    notable = F.when((F.col("best.minus") < -1024) | ~F.col("generic"), F.struct("generic", "best.minus", "best.path"))
    folders = named.groupBy("month", "folder").agg(F.sum("n").alias("n"), F.min(F.when(F.col("best").isNotNull(), notable)).alias("g"))
    top = F.min(F.when(~generic(F.col("folder")), F.struct((-F.col("n")).alias("minus"), "folder"))).alias("f")
    months = folders.groupBy("month").agg(F.sum("n").alias("files"), top, F.min("g").alias("g"))
    return months.select("month", "files", F.col("f.folder").alias("folder"), (-F.col("f.minus")).alias("folder_files"), F.col("g.path").alias("file"), (-F.col("g.minus")).alias("file_size"))


def month_top_kinds(files: DataFrame, n: int = 3) -> DataFrame:
    """(month, kinds): the most frequent kinds of a month as ``kind: count``, joined by commas."""
    counts = files.where("modified_at is not null").groupBy((F.month("modified_at") - 1).alias("month"), "kind").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("n"), "kind"))).where(F.col("rank") <= n)
    return ranked.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "n"))), lambda x: F.concat(x["kind"], F.lit(": "), x["n"].cast("string"))), ", ").alias("kinds"))


def in_range(c: str, start: Column | None, end: Column | None, cutoff: Column | None = None) -> Column:
    """Between two bounds, both included, else from a cutoff on."""
    if start is not None and end is not None:
        return F.col(c).between(start, end)
    return F.col(c) >= cutoff if cutoff is not None else F.lit(True)


def in_last_days(c: str, days: int | None, now: Column) -> Column:
    """Within ``days`` before ``now``; without ``days`` everything, null included; else null is out."""
    return F.lit(True) if days is None else F.coalesce(F.col(c) >= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def range_days(name: str, days: dict[str, int], start=None, end=None) -> float:
    """Length of a named range in days, infinite for ``all``: for deciding whether rows already scanned cover a selection."""
    if name == "all":
        return float("inf")
    return (end - start).total_seconds() / 86400 if name == "custom" else float(days.get(name, 365))
