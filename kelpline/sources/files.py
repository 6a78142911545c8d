"""Sources and sinks on landed files. Listings read no file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.labels import kind_of
from kelpline.functions.paths import base_name, excluded, extension, hidden, origin, parent
from kelpline.functions.redaction import redact, redacted


def list_files(spark: SparkSession, roots: list[str], modified_after: str | None = None, modified_before: str | None = None) -> DataFrame:
    """(path, name, extension, size, modified_at, kind, parent_path) of all files below the roots, each path once.

    ``modified_after`` and ``modified_before`` narrow the listing itself; both bounds are left out by the reader, so pass
    wider ones and keep the exact filter (``scan``). Creation times are not known to the reader, which also leaves out
    files whose names begin with a dot or an underscore."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    for name, value in (("modifiedAfter", modified_after), ("modifiedBefore", modified_before)):
        reader = reader.option(name, value) if value else reader
    raw = reader.load(roots).select("path", "length", "modificationTime").dropDuplicates(["path"])
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    name = base_name("path")
    return rows.withColumns({"name": name, "extension": extension(name), "kind": kind_of(extension(name)), "parent_path": parent("path")})


def scan(files: DataFrame, system: list[str] = [], custom: list[str] = [], recommended: bool = True, kinds: list[str] | None = None, start: Column | None = None, end: Column | None = None, cutoff: Column | None = None) -> DataFrame:  # noqa: B006
    """A listing without hidden files, excluded places and unsupported types, within a time window (both bounds included)."""
    from kelpline.operators.activity import in_range

    rows = files.where(~hidden("path") & ~excluded("path", system, custom, recommended) & F.col("kind").isNotNull())
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    return rows.where(in_range("modified_at", start, end, cutoff))


def with_origin(files: DataFrame, downloads: list[str], synced: list[str], created: list[str]) -> DataFrame:
    return files.withColumn("origin", origin("path", downloads, synced, created))


def scan_counts(files: DataFrame, kept: Column) -> DataFrame:
    """One row (scanned, matched, skipped)."""
    return files.agg(F.count("*").alias("scanned"), F.count_if(F.coalesce(kept, F.lit(False))).alias("matched")).withColumn("skipped", F.col("scanned") - F.col("matched"))


def ndjson(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """One JSON object a line; blank and broken lines are left out."""
    lines = (spark.readStream if stream else spark.read).format("text").load(path)
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("x"), "value").where(F.try_parse_json("value").isNotNull()).select("x.*")


def sse(spark: SparkSession, path: str, schema: str, stream: bool = False, line_end: str = "\n") -> DataFrame:
    """(event, data fields) of server-sent events: blocks parted by blank lines, ``event:`` and ``data:`` lines in each, that
    end in ``line_end`` (``\\r\\n`` for streams that use it).

    Several data lines of one block are joined; blocks without data are left out."""
    blocks = (spark.readStream if stream else spark.read).format("text").option("lineSep", line_end * 2).load(path)
    blocks = blocks.select(F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))
    data = F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    event = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^event: ?(.*)$", 1), F.lit("")), F.lit("message"))
    return blocks.select(event.alias("event"), data.alias("d")).where("d <> ''").select("event", F.from_json("d", schema).alias("x")).select("event", "x.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests (JSON files) with id, name and version; the first file of every id, by path."""
    raw = spark.read.schema("id string, name string, version string, description string, permissions array<string>, dependencies map<string, string>").option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("path", F.input_file_name())
    rows = raw.where("id <> '' and name <> '' and version <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).where("_n = 1").drop("_n")


def coalesced(rows: DataFrame, fields: dict[str, tuple[str, ...]], defaults: dict[str, object] = {}) -> DataFrame:  # noqa: B006
    """One column per field from the first of its names that a row has: snake_case, camelCase or other aliases."""
    out = []
    for field, names in fields.items():
        found = [F.col(n) for n in names if n in rows.columns] or [F.lit(None)]
        out.append(F.coalesce(*found, F.lit(defaults[field])).alias(field) if field in defaults else F.coalesce(*found).alias(field))
    return rows.select(*out)


def export_redacted(rows: DataFrame, text: str, rules: list[tuple[str, str]], path: str) -> DataFrame:
    """Write redacted lines as compressed text; gives one row (lines, redactions), counted while writing."""
    seen = Observation()
    found = redacted(rows.select(F.col(text).alias("value")), "value", rules, "_n")
    found = found.observe(seen, F.count("*").alias("lines"), F.coalesce(F.sum("_n"), F.lit(0)).alias("redactions"))
    found.select("value").write.mode("overwrite").option("compression", "gzip").text(path)
    return rows.sparkSession.createDataFrame([(seen.get["lines"], seen.get["redactions"])], "lines long, redactions long")


def redact_struct(rows: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Redact all strings of a struct column by way of its JSON."""
    kind = rows.schema[column].dataType.simpleString()
    return rows.withColumn(column, F.from_json(redact(F.to_json(column), rules), kind))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def save_settings(settings: DataFrame, path: str) -> None:
    """A few settings rows as one JSON file."""
    settings.coalesce(1).write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
