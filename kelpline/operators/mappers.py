"""Payloads (JSON) as typed rows: every field by its snake_case or camelCase name, with a default.

A payload is parsed once. Broken JSON, a null payload and fields of another type count as missing. Nested lists and objects
stay JSON text, to be parsed by whoever needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.paths import col

#: (type, default) of every field; ``now`` stands for the time of reading. A third entry names further aliases.
FOLDER = {"id": ("string", None), "label": ("string", None), "path": ("string", ""), "created_at": ("timestamp", "now"), "updated_at": ("timestamp", "now"), "last_indexed_at": ("timestamp", None), "enabled": ("boolean", True), "failed_files": ("string", "[]"), "indexed_count": ("long", 0), "privacy_level": ("string", "normal")}
FILE = {
    "id": ("string", None), "folder_id": ("string", ""), "path": ("string", ""), "name": ("string", "Unnamed", "filename"), "extension": ("string", ""), "size": ("long", 0),
    "modified_at": ("timestamp", "now"), "created_at": ("timestamp", "now"), "kind": ("string", "other"), "summary": ("string", None), "metadata": ("string", "{}"), "index_status": ("string", "indexed"),
    "error_reason": ("string", None), "error_at": ("timestamp", None), "fast_stage": ("long", 0), "fast_text_at": ("timestamp", None), "fast_embed_at": ("timestamp", None), "deep_stage": ("long", 0),
    "deep_text_at": ("timestamp", None), "deep_embed_at": ("timestamp", None), "memory_status": ("string", "pending"), "memory_extracted_at": ("timestamp", None), "memory_total_chunks": ("long", 0),
    "memory_processed_chunks": ("long", 0), "memory_last_chunk_size": ("long", None), "full_path": ("string", None, "path"), "location": ("string", ""), "privacy_level": ("string", "normal"),
}
PROGRESS = {"status": ("string", "idle"), "started_at": ("timestamp", None), "completed_at": ("timestamp", None), "processed": ("long", 0), "failed": ("long", 0), "failed_items": ("string", "[]"), "total": ("long", None), "message": ("string", None), "last_error": ("string", None)}
SUMMARY = {"files_indexed": ("long", 0), "total_size_bytes": ("long", 0), "folders_indexed": ("long", 0), "last_completed_at": ("timestamp", None)}
QUEUE_ITEM = {"folder_id": ("string", ""), "folder_path": ("string", ""), "file_path": ("string", ""), "file_id": ("string", None), "file_name": ("string", None), "status": ("string", "pending"), "started_at": ("timestamp", None), "progress": ("double", None), "kind": ("string", None), "stage": ("string", None), "detail": ("string", None), "step_current": ("long", None), "step_total": ("long", None), "recent_events": ("string", "[]")}
SERVICE = {"name": ("string", "Unknown"), "status": ("string", "unknown"), "latency_ms": ("double", None), "details": ("string", None)}
HEALTH = {"status": ("string", "idle"), "indexed_files": ("long", 0), "watched_folders": ("long", 0), "message": ("string", None), "services": ("string", "[]")}
HIT = {"file_id": ("string", ""), "score": ("double", 0.0), "summary": ("string", None), "snippet": ("string", None), "metadata": ("string", "{}"), "chunk_id": ("string", None), "analysis_comment": ("string", None), "has_answer": ("boolean", None), "analysis_confidence": ("double", None)}
SEARCH = {"query": ("string", ""), "hits": ("string", "[]"), "rewritten_query": ("string", None), "query_variants": ("string", "[]"), "strategy": ("string", "vector"), "latency_ms": ("double", None)}
ANSWER = {"answer": ("string", ""), "hits": ("string", "[]"), "latency_ms": ("double", 0.0), "rewritten_query": ("string", None), "query_variants": ("string", "[]")}
ACCOUNT = {"id": ("string", "", "account_id"), "label": ("string", "Email account"), "protocol": ("string", "imap"), "host": ("string", ""), "port": ("long", 0), "username": ("string", ""), "use_ssl": ("boolean", True), "folder": ("string", None), "enabled": ("boolean", True), "created_at": ("timestamp", "now"), "updated_at": ("timestamp", "now"), "last_synced_at": ("timestamp", None), "last_sync_status": ("string", None), "total_messages": ("long", 0), "recent_new_messages": ("long", 0), "folder_id": ("string", ""), "folder_path": ("string", "")}
SYNC = {"account_id": ("string", ""), "folder_id": ("string", ""), "folder_path": ("string", ""), "new_messages": ("long", 0), "total_messages": ("long", 0), "indexed": ("long", 0), "last_synced_at": ("timestamp", "now"), "status": ("string", "ok"), "message": ("string", None)}
MAIL = {"id": ("string", ""), "account_id": ("string", ""), "subject": ("string", None), "sender": ("string", None), "recipients": ("string", "[]"), "sent_at": ("timestamp", None), "stored_path": ("string", ""), "size": ("long", 0), "created_at": ("timestamp", "now"), "preview": ("string", None), "markdown": ("string", "")}
NOTE = {"id": ("string", ""), "title": ("string", "Untitled note"), "markdown": ("string", ""), "created_at": ("timestamp", "now"), "updated_at": ("timestamp", "now"), "preview": ("string", None)}
MESSAGE = {"role": ("string", "user"), "content": ("string", "", "text"), "timestamp": ("timestamp", "now"), "meta": ("string", None), "references": ("string", None), "is_multi_path": ("boolean", None), "thinking_steps": ("string", None)}
CHAT = {"id": ("string", ""), "title": ("string", "New Chat"), "messages": ("string", "[]"), "updated_at": ("timestamp", "now")}
CHUNK = {"chunk_id": ("string", None), "file_id": ("string", None), "ordinal": ("long", 0), "text": ("string", ""), "snippet": ("string", ""), "metadata": ("string", "{}"), "page_num": ("long", None), "bbox": ("string", None), "source_regions": ("string", None)}
STEP = {"id": ("string", None, "step_id"), "title": ("string", "Step"), "detail": ("string", None), "status": ("string", "complete"), "files": ("string", "[]"), "duration_ms": ("double", None)}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(map(str.capitalize, rest))


def mapped(rows: DataFrame, payload: str, fields: dict[str, tuple], keep: list[str] = [], now: Column | None = None) -> DataFrame:  # noqa: B006
    """(keep, fields) of every row of ``rows``: the first of a field's names that the payload has, else its default."""
    aliases = {name: list(dict.fromkeys([name, camel(name), *rest])) for name, (_, _, *rest) in fields.items()}
    shape = ", ".join(f"`{a}` string" for a in dict.fromkeys(a for names in aliases.values() for a in names))
    parsed = rows.select(*keep, F.from_json(payload, shape).alias("_p"))
    out = []
    for name, (kind, default, *_) in fields.items():
        value = F.coalesce(*[F.col("_p")[a] for a in aliases[name]]).try_cast(kind)
        given = (F.current_timestamp() if now is None else now) if default == "now" else F.lit(default)
        out.append((value if default is None else F.coalesce(value, given.cast(kind))).alias(name))
    return parsed.select(*keep, *out)


def folders(rows: DataFrame, payload: str, keep: list[str] = [], now: Column | None = None) -> DataFrame:  # noqa: B006
    """Folders; one without a label has its path, or ``Folder``."""
    found = mapped(rows, payload, FOLDER, keep, now)
    return found.withColumn("label", F.coalesce("label", F.nullif("path", F.lit("")), F.lit("Folder")))


def diagnostics(rows: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, position, step fields, summary): the steps of every payload (steps, summary), one row each; a payload with a
    summary alone gives one row without a step, and one with neither gives none. A step without an id is ``step-`` and its
    position."""
    top = rows.select(key, F.from_json(payload, "steps array<string>, summary string").alias("_d")).select(key, "_d.*")
    top = top.where((F.coalesce(F.size("steps"), F.lit(0)) > 0) | (F.coalesce("summary", F.lit("")) != ""))
    steps = mapped(top.select(key, "summary", F.posexplode_outer("steps").alias("position", "_s")), "_s", STEP, [key, "summary", "position"])
    none = F.col("position").isNull()
    steps = steps.withColumn("id", F.when(~none, F.coalesce("id", F.concat(F.lit("step-"), F.col("position").cast("string")))))
    return steps.withColumns({c: F.when(~none, F.col(c)) for c in ("title", "status", "files")})


def _first(metadata: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(metadata[n], F.lit("")) for n in names])


def source(metadata: Column | str) -> Column:
    """struct (name, path) of a map of strings, null if it names neither."""
    m = col(metadata)
    name, path = _first(m, "file_name", "fileName", "name"), _first(m, "file_path", "filePath", "path")
    return F.when(name.isNotNull() | path.isNotNull(), F.struct(name.alias("name"), path.alias("path")))


def reference_label(file_id: Column | str, metadata: Column | str) -> Column:
    """struct (name, location): the name of the metadata (a map of strings), else the last part of the location, else
    ``File`` and the id; no location is empty."""
    m = col(metadata)
    location = F.coalesce(_first(m, "path", "file_path", "full_path"), F.lit(""))
    last = F.nullif(F.regexp_extract(F.replace(location, F.lit("\\"), F.lit("/")), "([^/]+)/*$", 1), F.lit(""))
    name = F.coalesce(_first(m, "file_name", "name", "filename", "title"), last, F.concat(F.lit("File "), col(file_id).cast("string")))
    return F.struct(name.alias("name"), location.alias("location"))
