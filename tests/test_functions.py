"""Truth tables of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from kelpline.functions import labels, paths, redaction
from kelpline.model import KIND_EXTENSIONS


def values(spark, inputs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_excluded_directories(spark):
    inside = ["node_modules", ".git", "__pycache__", "venv", "dist", "build", "Documents", "Projects", "my_project"]
    assert values(spark, [f"/u/{d}/f.txt" for d in inside], paths.in_excluded_directory) == [True] * 6 + [False] * 3
    assert values(spark, ["/u/build", "f", None], paths.in_excluded_directory) == [False, False, None]


def test_excluded_prefixes(spark):
    cases = ["/System/Library/CoreServices", "/Library/Application Support", "/SYSTEM/Something", "/LibraryX/a", "/Users/test/Documents", None]
    prefixes = ["/System", "/Library", "/Users/test/Library"]
    assert values(spark, cases, lambda c: paths.under_prefix(c, prefixes)) == [True, True, True, True, False, None]
    assert values(spark, cases, lambda c: paths.under_prefix(c, prefixes, strict_boundary=True)) == [True, True, True, False, False, None]
    assert values(spark, ["C:\\Windows\\System32", "C:\\Users\\Test"], lambda c: paths.under_prefix(c, ["C:\\Windows", "C:\\Program Files"])) == [True, False]


def test_kinds_and_supported_types(spark):
    good = "pdf doc docx txt jpg jpeg png gif heic mp4 mov avi mp3 wav flac zip rar 7z .pdf PDF Jpg MP4".split()
    bad = "ts tsx js jsx py java cpp html css xyz".split()
    assert values(spark, good + bad, labels.supported) == [True] * len(good) + [False] * len(bad)
    assert values(spark, ["pdf", "jpg", "mov", "wav", "ts", None], labels.kind_of) == ["document", "image", "video", "audio", None, None]
    assert len(KIND_EXTENSIONS) == 8
    assert values(spark, ["md", "epub", None], labels.workspace_kind) == ["document", "other", "other"]


def test_paths(spark):
    cases = ["/a/b.tar.gz", "b", "/b", "/a/.hidden", "C:\\x\\y.TXT", None]
    assert values(spark, cases, paths.base_name) == ["b.tar.gz", "b", "b", ".hidden", "y.TXT", None]
    assert values(spark, cases, paths.parent) == ["/a", "/", "/", "/a", "/", None]
    assert values(spark, ["a.PDF", ".env", "a", "a.b.c", "/x/.y"], paths.extension) == ["pdf", "", "", "c", ""]
    assert values(spark, ["/a/.b/c", "/a/b", ".x"], paths.hidden) == [True, False, True]
    assert values(spark, ["/Users/me/Documents/atlas", "/Users/me/work/src", "/Users/me/Desktop", "/Users/me/src/lib", "/"], paths.meaningful_folder) == ["Documents/atlas", "work", "Desktop", "lib", "/"]
    assert values(spark, ["/Users/me/Documents/atlas/x", "/Users/me/src/lib", "/Users/me/src", "/"], paths.project) == ["atlas", "lib", "src", "root"]
    assert values(spark, ["/d/x", "/s/x", "/c/x", "/x", None], lambda c: paths.origin(c, ["/d"], ["/s"], ["/c"])) == ["downloaded", "synced", "created_here", "unknown", "unknown"]


def test_size_labels(spark):
    sizes = [0, 1, 1023, 1024, 1536, 10 * 1024, 5 * 1024**2, 3 * 1024**4, None]
    assert values(spark, sizes, labels.size_label, "long") == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "10 KB", "5 MB", "3 TB", None]
    assert values(spark, sizes, labels.size_label_short, "long") == ["0 B", "1.0 B", "1023 B", "1.0 KB", "1.5 KB", "10 KB", "5.0 MB", "3072 GB", "0 B"]
    assert values(spark, sizes, labels.size_label_fixed, "long") == ["0 B", "1 B", "1023 B", "1.0 KB", "1.5 KB", "10.0 KB", "5.0 MB", "3.0 TB", "0 B"]
    assert values(spark, [5, 1500, 2_340_000], labels.count_label, "long") == ["5", "1.5K", "2.3M"]


def test_relative_times(spark):
    now = datetime.datetime(2024, 3, 10, 12)
    ago = [datetime.timedelta(seconds=30), datetime.timedelta(minutes=5), datetime.timedelta(hours=3), datetime.timedelta(days=1), datetime.timedelta(days=3), datetime.timedelta(days=15), datetime.timedelta(days=90), datetime.timedelta(days=400)]
    got = values(spark, [now - x for x in ago], lambda c: labels.relative_time(c.cast("timestamp"), F.lit(now)), "timestamp_ntz")
    assert got == ["Just now", "5m ago", "3h ago", "Yesterday", "3 days ago", "2w ago", "3mo ago", "2023-02-04"]


def test_names_and_numbers(spark):
    assert values(spark, ["short.txt", "x" * 40 + ".docx", "y" * 40], labels.short_name) == ["short.txt", "x" * 27 + "....docx", "y" * 32 + "..."]
    assert values(spark, [None, -3.0, 49.5, 120.0, float("nan")], labels.clamp_percent, "double") == [0, 0, 50, 100, 0]
    assert values(spark, [0, 1, 12, 23], lambda c: labels.hour_range(c), "int") == ["12 AM-1 AM", "1 AM-2 AM", "12 PM-1 PM", "11 PM-12 AM"]
    assert values(spark, [0, 5, 6, 11, 101, 1001], labels.activity_level, "long") == [0, 1, 2, 3, 4, 5]
    assert values(spark, ["see Page 12 now", "no", None], labels.page_label) == ["12", None, None]
    assert values(spark, [0, 8 << 30, 24 << 30, 64 << 30], labels.largest_context, "long") == [32768, 8192, 16384, 32768]
    assert values(spark, ["Activity_Summary_2025-11-20_14-30.md", "other.md"], lambda c: labels.summary_file_time(c)["time"]) == ["14:30", None]


def test_text_functions(spark):
    assert values(spark, ["see [1, 2] and [ 3 ] not [x]", "", None], labels.citations) == [[1, 2, 3], [], None]
    assert values(spark, ["One. Two", "no end", "a.b. c"], labels.first_sentence) == ["One", "no end", "a.b"]
    assert values(spark, ['"A title"', "ab", "Untitled", "I cannot do it", " 'x y z' "], labels.clean_title) == ["A title", None, None, None, "x y z"]
    assert values(spark, ['[{"content": "hello"}]', "plain text", '{"a": 1}', "[]", None], labels.json_preview) == ["hello", "plain text", "", "", ""]
    assert values(spark, [[], ["a"], ["a", "b", "c"]], labels.recipients_label, "array<string>") == ["Unknown recipients", "a", "a +2"]
    assert values(spark, ["a\n\nb\nc", "", None], labels.first_lines) == ["a b", "No preview available yet.", "No preview available yet."]


def test_relevance(spark):
    rows = [(True, "Yes. It is not relevant here."), (True, "Not relevant."), (True, "fine NO_ANSWER"), (False, "Good"), (None, "Good"), (True, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h boolean, c string")
    got = df.select("i", labels.relevant("h", "c").alias("r"), labels.answer_class("h", "c").alias("k")).orderBy("i").collect()
    assert [r.r for r in got] == [True, False, False, False, False, True]
    assert got[4].k == "unanalysed"


def test_index_modes(spark):
    none = F.lit(None).cast("string")
    status = lambda q, k, s, st: labels.index_status(F.lit(q), F.lit(k), F.lit(s), F.lit(st).cast("string"), none)
    one = spark.range(1)
    got = one.select(status(True, False, None, None), status(False, False, None, None), status(False, True, "error", "x_fine"), status(False, True, "indexed", "x_fine"), status(False, True, "indexed", None)).collect()[0]
    assert list(got) == ["pending", "not_indexed", "error", "deep", "fast"]
    mode = lambda p, stage, s, deep, fast, st: labels.index_mode(F.lit(p), F.lit(stage).cast("string"), F.lit(s), F.lit(deep), F.lit(fast), F.lit(st).cast("string"), none)
    got = one.select(mode(True, "deep_x", "", 0, 0, None), mode(False, None, "error", 1, 2, None), mode(False, None, "ok", 1, 0, None), mode(False, None, "ok", 0, 2, None), mode(False, None, "ok", 0, 1, None), mode(False, None, "ok", 0, 0, "a_fast"), mode(False, None, "ok", 0, 0, None)).collect()[0]
    assert list(got) == ["vision_processing", "error", "vision_done", "semantic_done", "keyword_done", "semantic_done", "none"]


@pytest.mark.parametrize(("text", "want"), [("api_key = 'abcdefghijklmnop12'", "api_key = '[REDACTED]'"), ("Bearer abc.def", "Bearer [REDACTED]"), ("pwd: x1", "pwd=[REDACTED]"), ("mail a.b@c.org!", "mail [EMAIL_REDACTED]!"), ("card 4111 1111 1111 1111 1", "card [CARD_REDACTED]"), ("postgres://u:p@h", "postgres://***:[REDACTED]@h")])
def test_log_redaction(spark, text, want):
    assert values(spark, [text], lambda c: redaction.redact(c, redaction.log_rules())) == [want]


def test_export_redaction_counts_rule_by_rule(spark):
    text = "token: abc a@b.co /home/me/x ?q=1&r=2 \U0001f4dd User Query: secret 10.0.0.1"
    out = values(spark, [text, None], lambda c: redaction.redact(c, redaction.EXPORT_RULES))
    assert out == ["token=[REDACTED] [EMAIL] [PATH] ?q=[REDACTED]&r=[REDACTED] \U0001f4dd User Query: [REDACTED]", None]
    counts = values(spark, [text], lambda c: redaction.redaction_counts(c, redaction.EXPORT_RULES))[0]
    assert sum(counts) == 6
    assert values(spark, ["/Users/me/a /home/me/b C:\\Users\\me\\c /Users/mel/"], lambda c: redaction.redact_user(c, "me")) == ["/Users/[USER]/a /home/[USER]/b C:\\Users\\[USER]\\c /Users/mel/"]
