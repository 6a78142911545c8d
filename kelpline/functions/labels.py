"""Column functions that turn values into labels, codes and classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.functions.paths import col, segments
from kelpline.model import DENIALS, KIND_EXTENSIONS, LENIENT_PHRASES, NAME_LENGTH, STATUS_TEXTS, STRICT_PHRASES, WORKSPACE_EXTENSIONS


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, negative ones too."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(half_up(100 * part / F.nullif(whole.cast("double"), F.lit(0.0))), F.lit(0)).cast("long")


def _ladder(size: Column, units: list[str], label) -> Column:
    out = None
    for k, unit in enumerate(units):
        value = size.cast("double") / float(1024**k)
        here = F.concat(label(value, k), F.lit(f" {unit}"))
        out = (F.when(size < 1024 ** (k + 1), here) if out is None else out.when(size < 1024 ** (k + 1), here)) if k < len(units) - 1 else out.otherwise(here)
    return out


def size_label(size: Column | str) -> Column:
    """One decimal, without a trailing zero: 0 B, 1.5 KB, 2 MB."""
    size = col(size)
    return F.when(size == 0, "0 B").otherwise(_ladder(size, ["B", "KB", "MB", "GB", "TB"], lambda v, k: F.regexp_replace(F.round(v, 1).cast("string"), r"\.0$", "")))


def size_label_short(size: Column | str) -> Column:
    """No decimal from 10 on, one below; up to GB; 0 B for what is null or not positive."""
    size = col(size)
    text = lambda v, k: F.when(v >= 10, F.round(v, 0).cast("long").cast("string")).otherwise(F.round(v, 1).cast("string"))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "0 B").otherwise(_ladder(size, ["B", "KB", "MB", "GB"], text))


def size_label_fixed(size: Column | str) -> Column:
    """Always one decimal but for bytes; 0 B for null."""
    size = col(size)
    text = lambda v, k: F.round(v, 0).cast("long").cast("string") if k == 0 else F.round(v, 1).cast("string")
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").otherwise(_ladder(size, ["B", "KB", "MB", "GB", "TB"], text))


def count_label(n: Column | str) -> Column:
    """1.2M, 3.4K, 567."""
    n = col(n)
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1e6, 1).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1e3, 1).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def relative_time(ts: Column | str, now: Column, months: bool = True) -> Column:
    """Just now, 5m ago, 2h ago, Yesterday, days, weeks, months (with ``months``), else the date."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(col(ts))
    days = F.floor(seconds / 86400)
    some = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    out = F.when((days == 0) & (seconds < 120), "Just now").when((days == 0) & (seconds < 3600), some(F.floor(seconds / 60), "m ago")).when(days == 0, some(F.floor(seconds / 3600), "h ago"))
    out = out.when(days == 1, "Yesterday").when(days < 7, some(days, " days ago" if months else "d ago")).when(days < 30, some(F.floor(days / 7), "w ago"))
    out = out.when(days < 365, some(F.floor(days / 30), "mo ago")) if months else out
    return out.otherwise(F.date_format(col(ts), "yyyy-MM-dd"))


def short_name(name: Column | str, most: int = NAME_LENGTH) -> Column:
    """A name of at most ``most`` characters that keeps an extension of fewer than 10."""
    name = col(name)
    ext = F.regexp_extract(name, r"\.[^.]*$", 0)
    keeps = (ext != "") & (F.length(ext) < 10) & (F.length(name) > F.length(ext))
    cut = F.when(keeps, F.concat(F.substring(name, F.lit(1), F.lit(most - 3) - F.length(ext)), F.lit("..."), ext)).otherwise(F.concat(F.substring(name, 1, most - 3), F.lit("...")))
    return F.when(F.length(name) <= most, name).otherwise(cut)


def _by_extension(ext: Column, table: dict[str, list[str]]) -> Column:
    ext = F.ltrim(F.lower(ext), F.lit("."))
    out = None
    for kind, names in table.items():
        out = F.when(ext.isin(names), kind) if out is None else out.when(ext.isin(names), kind)
    return out


def kind_of(ext: Column | str) -> Column:
    """Kind of an extension (any case, with or without its dot); null if it has none."""
    return _by_extension(col(ext), KIND_EXTENSIONS)


def supported(ext: Column | str) -> Column:
    return F.coalesce(kind_of(ext).isNotNull(), F.lit(False))


def workspace_kind(ext: Column | str) -> Column:
    return F.coalesce(_by_extension(col(ext), WORKSPACE_EXTENSIONS), F.lit("other"))


def processing_stage(stage: Column | str) -> Column:
    s = F.lower(col(stage))
    return F.when((s == "") | s.isNull(), F.lit(None).cast("string")).when(s.rlike("deep|vision"), "vision").when(s.rlike("embed|semantic"), "semantic").otherwise("keyword")


def index_status(queued: Column, known: Column, status: Column, strategy: Column, vision: Column) -> Column:
    """pending, not_indexed, error, deep or fast of a scanned file."""
    return F.when(queued, "pending").when(~known, "not_indexed").when(status == "error", "error").when(strategy.contains("_fine"), "deep").when(strategy.contains("_fast"), "fast").when(vision == "deep", "deep").otherwise("fast")


def index_mode(processing: Column, stage: Column, status: Column, deep: Column, fast: Column, strategy: Column, vision: Column) -> Column:
    """How far a file's index is: *_processing, error, *_done or none."""
    out = F.when(processing, F.concat(F.coalesce(processing_stage(stage), F.lit("keyword")), F.lit("_processing"))).when(status == "error", "error")
    out = out.when(deep > 0, "vision_done").when(fast >= 2, "semantic_done").when(fast == 1, "keyword_done").when(status == "pending", "none")
    out = out.when(strategy.contains("_fine"), "vision_done").when(strategy.contains("_fast"), "semantic_done")
    return out.when(vision == "deep", "vision_done").when((vision == "fast") | (strategy != ""), "semantic_done").otherwise("none")


def clamp_percent(x: Column | str) -> Column:
    x = col(x)
    return F.when(x.isNull() | F.isnan(x.cast("double")), 0).otherwise(F.least(F.greatest(half_up(x.cast("double")), F.lit(0)), F.lit(100))).cast("int")


def active_stage(text: Column, embed: Column, deep: Column, semantic_on: Column, deep_on: Column) -> Column:
    return F.when(clamp_percent(text) < 100, "keyword").when(semantic_on & (clamp_percent(embed) < 100), "semantic").when(deep_on & (clamp_percent(deep) < 100), "vision")


def folder_label(label: Column, path: Column, folder_id: Column) -> Column:
    last = F.get(segments(F.replace(path, F.lit("\\"), F.lit("/"))), F.size(segments(F.replace(path, F.lit("\\"), F.lit("/")))) - 1)
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), last, F.nullif(path, F.lit("")), F.concat(F.lit("Folder "), folder_id.cast("string")))


def page_label(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"(?i)page\s+(\d+)", 1), F.lit(""))


def page_number(number: Column, page: Column, start: Column, numbers: Column) -> Column:
    """The first of the fields that is neither null nor 0, then the first listed number."""
    return F.coalesce(F.nullif(number, F.lit(0)), F.nullif(page, F.lit(0)), F.nullif(start, F.lit(0)), F.get(numbers, F.lit(0)))


def hour_label(hour: Column) -> Column:
    return F.when(hour == 0, "12 AM").when(hour < 12, F.concat(hour.cast("string"), F.lit(" AM"))).when(hour == 12, "12 PM").otherwise(F.concat((hour - 12).cast("string"), F.lit(" PM")))


def hour_range(hour: Column) -> Column:
    return F.concat(hour_label(hour), F.lit("-"), hour_label((hour + 1) % 24))


def activity_level(n: Column | str) -> Column:
    n = col(n)
    return F.when(n == 0, 0).when(n <= 5, 1).when(n <= 10, 2).when(n <= 100, 3).when(n <= 1000, 4).otherwise(5)


def summary_file_time(name: Column | str) -> Column:
    """Struct (date, time) of a summary file's name; null for other names."""
    rx = r"Activity_Summary_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2})"
    return F.when(col(name).rlike(rx), F.struct(F.regexp_extract(col(name), rx, 1).alias("date"), F.replace(F.regexp_extract(col(name), rx, 2), F.lit("-"), F.lit(":")).alias("time")))


def first_words(text: Column | str, n: int = 15) -> Column:
    parts = F.split(col(text), " ")
    return F.concat(F.array_join(F.slice(parts, 1, n), " "), F.when(F.size(parts) > n, "...").otherwise(""))


def first_lines(text: Column | str, n: int = 2) -> Column:
    lines = F.filter(F.split(col(text), "\n"), lambda x: x != "")
    return F.when(F.coalesce(col(text), F.lit("")) == "", "No preview available yet.").otherwise(F.array_join(F.slice(lines, 1, n), " "))


def recipients_label(names: Column | str) -> Column:
    names = col(names)
    return F.when(F.size(names) == 0, "Unknown recipients").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" +"), (F.size(names) - 1).cast("string")))


def citations(text: Column | str) -> Column:
    """Numbers cited as [1] or [1, 2], in order."""
    groups = F.regexp_extract_all(col(text), F.lit(r"\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: x.try_cast("long"))))


def first_sentence(text: Column | str) -> Column:
    return F.get(F.split(col(text), r"[.?!]\s", 2), F.lit(0))


def _denied(comment: Column, phrases: list[str]) -> Column:
    whole = F.upper(F.coalesce(comment, F.lit("")))
    first = F.coalesce(F.nullif(first_sentence(whole), F.lit("")), whole)
    return F.regexp_like(whole, F.lit("|".join(map(re.escape, DENIALS)))) | F.regexp_like(first, F.lit("|".join(map(re.escape, phrases))))


def relevant(has_answer: Column | str, comment: Column | str, strict: bool = True) -> Column:
    """True only if there is an answer that the comment doesn't deny; false for null."""
    return F.coalesce(col(has_answer), F.lit(False)) & ~_denied(col(comment), STRICT_PHRASES if strict else LENIENT_PHRASES)


def answer_class(has_answer: Column | str, comment: Column | str) -> Column:
    """relevant, not_relevant, or unanalysed for a null ``has_answer``."""
    return F.when(col(has_answer).isNull(), "unanalysed").when(relevant(has_answer, comment), "relevant").otherwise("not_relevant")


def json_preview(text: Column | str, most: int = 300) -> Column:
    """The content of a JSON list's first item; the raw text if it is no JSON; empty for other JSON."""
    raw = col(text)
    content = F.get_json_object(raw, "$[0].content")
    return F.when(raw.isNull(), "").when(F.try_parse_json(raw).isNull(), F.substring(raw, 1, most)).when(F.substring(F.ltrim(raw), 1, 1) == "[", F.coalesce(F.substring(content, 1, most), F.lit(""))).otherwise("")


def clean_title(text: Column | str) -> Column:
    """A proposed title without its quotes; null if it is too short or says that there is none."""
    title = F.regexp_replace(F.trim(col(text)), "^[\"']|[\"']$", "")
    low = F.lower(title)
    return F.when(~((F.length(title) < 3) | low.isin("unknown", "untitled") | low.contains("no title") | low.contains("cannot")), title)


def status_text(code: Column | str) -> Column:
    """A status code in words, with the two patterns that hold numbers."""
    code = col(code)
    out = F.when(code.rlike(r"analyzing_\d+_chunks"), F.concat(F.lit("Starting analysis of "), F.regexp_extract(code, r"analyzing_(\d+)_chunks", 1), F.lit(" sources...")))
    sub = r"searching_subquery_(\d+)_of_(\d+)"
    out = out.when(code.rlike(sub), F.concat(F.lit("Searching sub-query "), F.regexp_extract(code, sub, 1), F.lit("/"), F.regexp_extract(code, sub, 2), F.lit("...")))
    for key, text in STATUS_TEXTS.items():
        out = out.when(code == key, text)
    return out.otherwise(code)


def analysis_batches(code: Column | str, size: int = 5) -> Column:
    n = F.regexp_extract(col(code), r"analyzing_(\d+)_chunks", 1).try_cast("long")
    return F.ceil(n / size)


def largest_context(memory: Column | str) -> Column:
    """Largest context size for a machine's memory in bytes; 0 or null is unknown."""
    m, gb = F.coalesce(col(memory), F.lit(0)), 1 << 30
    return F.when((m > 0) & (m < 22 * gb), 8192).when((m > 0) & (m < 30 * gb), 16384).otherwise(32768)


def prompt(parts: list[Column], most: int = 3000) -> Column:
    """Lines joined and cut, as a model's input."""
    return F.substring(F.concat_ws("\n", *parts), 1, most)
