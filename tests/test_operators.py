"""Operators, sources and streams on hand-made rows: nulls, ties, empty tables, repeated keys."""

import json

import pytest
from pyspark.sql import functions as F

from kelpline.operators import activity, catalog, events, folders, memory, retrieval
from kelpline.plans.extensions import Extension, Registry, migrated
from kelpline.sources import files as sources
from kelpline.streaming import jobs

FILES = "path string, name string, extension string, kind string, size long, modified_at timestamp"


def files(spark, rows=()):
    return spark.createDataFrame(list(rows), FILES)


def test_activity_of_no_files(spark):
    none = files(spark)
    assert activity.totals(none).collect()[0].files == 0
    assert activity.month_buckets(none).count() == 12
    assert activity.capped_weekdays(none).collect()[0].busy_percent == 0
    assert activity.night_owl(none).count() == activity.busiest_day(none).count() == activity.month_highlights(none).count() == 0
    assert folders.hotspots(none).count() == folders.project_insights(none).count() == 0
    assert activity.calendar_grid(none, 2023).where("in_year").count() == 365


def test_folder_joins(spark):
    rows = spark.createDataFrame([("/a/b/c/f",), ("/a/bx/f",), ("/f",)], "path string")
    known = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b",)], "folder_path string")
    from kelpline.functions.paths import parent

    got = {r.path: r.folder_path for r in catalog.deepest_folder(rows, known, parent("path")).collect()}
    assert got == {"/a/b/c/f": "/a/b", "/a/bx/f": "/a", "/f": None}
    assert {r.path for r in catalog.inside_any(rows, known, parent("path")).collect()} == {"/a/b/c/f", "/a/bx/f"}


def test_queue_status_precedence(spark):
    items = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "processing"), ("b", 1, "done"), ("b", 2, "processing"), (None, 1, "x")], "path string, seq int, status string")
    assert {r.path: r.status for r in catalog.queue_status(items).collect()} == {"a": "processing", "b": "done"}


def test_asset_groups_and_first_by_id(spark):
    assets = spark.createDataFrame([("x", True, 5), ("x", False, None), ("z", True, 1)], "group_name string, present boolean, size long")
    got = {r.group_name: (r.ready, r.bytes, r.place) for r in catalog.asset_groups(assets, ["x", "y"]).collect()}
    assert got == {"x": (False, 5, 1), "z": (True, 1, 3)}
    assert {(r.group_name, r.size) for r in catalog.first_by_id(assets, "group_name", "size").collect()} == {("x", None), ("z", 1)}


def test_judgements_prefer_the_chunk_and_keep_what_is_judged(spark):
    hits = spark.createDataFrame([(1, 1, "c1", None, None, None), (1, 2, "c2", None, None, None), (1, 3, None, True, "old", 0.5), (1, 4, "c4", None, None, None)], "s int, position long, chunk_id string, has_answer boolean, comment string, confidence double")
    verdicts = spark.createDataFrame([(1, 1, 1, "c2", True, "chunk", 0.9), (1, 2, 2, "zz", False, "place", 0.1), (1, 3, 3, None, False, "new", 0.2), (1, 4, 1, None, True, "late", 0.3)], "s int, seq int, index int, chunk_id string, has_answer boolean, comment string, confidence double")
    got = {r.position: (r.has_answer, r.comment) for r in retrieval.judge(hits, verdicts, ["s"]).collect()}
    assert got == {1: (True, "chunk"), 2: (True, "chunk"), 3: (True, "old"), 4: (None, None)}


def event(session, seq, kind, data=None):
    return (session, seq, kind, data if isinstance(data, str) or data is None else json.dumps(data))


EVENTS = [
    event("a", 1, "status", "searching"), event("a", 2, "hits", [{"file_id": "x", "chunk_id": "c1", "score": 0.9}, {"file_id": "y"}]),
    event("a", 3, "chunk_progress", {"processed_count": 1, "total_count": 2, "current_file": "x.pdf", "chunk_result": {"index": 1, "chunk_id": "c1", "has_answer": True, "comment": "ok", "confidence": 0.9}}),
    event("a", 4, "chunk_analysis", [{"index": 1, "has_answer": False}, {"index": 2, "has_answer": False, "confidence": 0.1}]),
    event("a", 5, "token", "Hel"), event("a", 6, "token", "lo"), event("a", 7, "done", "!"),
    event("b", 1, "multi_path_start"), event("b", 2, "hits", [{"file_id": "x", "metadata": {"index": 1}}, {"file_id": "n"}]),
    event("b", 3, "hits", [{"file_id": "z", "metadata": {"index": 1}}, {"file_id": "w", "metadata": {"index": 2}}, {"file_id": "none"}]),
    event("b", 4, "subquery_hits", {"sub_query_index": 2, "hits": [{"file_id": "q", "metadata": {"index": 2}}]}), event("b", 5, "error", "bad"),
    event("c", 1, "hits", [{"file_id": "1"}, {"file_id": "2"}]), event("c", 2, "hits", [{"file_id": "3"}]), event("c", 3, "user_decision_required", {"resume_token": "t"}),
]


def test_answer_streams_fold_into_messages_and_references(spark):
    log = spark.createDataFrame(EVENTS, "session string, seq int, type string, data string")
    m = {r.session: r for r in events.messages(log).collect()}
    assert (m["a"].text, m["a"].meta, m["a"].processed, m["a"].complete, m["a"].is_multi) == ("Hello!", None, 2, True, False)
    assert (m["b"].text, m["b"].meta, m["b"].is_multi) == ("\n[Error: bad]", "Error", True)
    assert (m["c"].needs_decision, m["c"].resume_token, m["c"].meta) == (True, "t", "Waiting for confirmation...")
    refs = {}
    for r in events.references(log).orderBy("session", "position").collect():
        refs.setdefault(r.session, []).append((r.file_id, r.has_answer))
    assert refs == {"a": [("x", True), ("y", False)], "b": [("x", None), ("n", None), ("w", None), ("q", None)], "c": [("3", None)]}
    assert events.messages(log.limit(0)).count() == events.references(log.limit(0)).count() == 0


def test_memory_records(spark):
    facts = spark.createDataFrame([(1, "e1"), (2, ""), (3, None)], "id int, parent_episode_id string")
    episodes = spark.createDataFrame([("e1", "subject")], "id string, subject string")
    assert memory.with_episode(facts, episodes).count() == 3
    assert [r.episode_subject for r in memory.with_episode(facts, episodes, linked_only=True).collect()] == ["subject"]


def test_references_keep_the_first_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3), (None, "e", 4)], "k int, v string, o int")
    assert {r.v for r in retrieval.new_references(old, new, ["k"], "o").collect()} == {"a", "c"}


@pytest.fixture
def folder(tmp_path):
    for name in ("docs/a.pdf", "docs/b.py", "docs/.hidden.pdf", "build/c.pdf", "pics/d.JPG"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x" * 10)
    return tmp_path


def test_file_listing_and_scan(spark, folder):
    listed = sources.list_files(spark, [str(folder / "in"), str(folder / "in" / "docs")])
    assert listed.count() == 4  # the reader itself leaves out names that begin with a dot
    kept = sources.scan(listed)
    assert {r.name for r in kept.collect()} == {"a.pdf", "d.JPG"}
    assert sources.scan(listed, kinds=["image"], cutoff=F.lit("2000-01-01").cast("timestamp")).collect()[0].extension == "jpg"
    assert sources.scan(listed, start=F.lit("1999-01-01").cast("timestamp"), end=F.lit("2000-01-01").cast("timestamp")).count() == 0


def test_json_lines_and_server_sent_events(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"stage": "x", "n": 1}\n\nbroken\n{"stage": "y"}\n')
    assert [(r.stage, r.n) for r in sources.ndjson(spark, str(tmp_path / "a.ndjson"), "stage string, n int").collect()] == [("x", 1), ("y", None)]
    (tmp_path / "b.sse").write_text('event: add\ndata: {"n": 1}\n\n: comment\n\ndata: {"n": 2}\n\n')
    assert [(r.event, r.n) for r in sources.sse(spark, str(tmp_path / "b.sse"), "n int").collect()] == [("add", 1), ("message", 2)]


def test_manifests_settings_and_exports(spark, tmp_path):
    for k, m in {"a": {"id": "p", "name": "P", "version": "1"}, "b": {"id": "p", "name": "Q", "version": "2"}, "c": {"id": "q", "name": "no version"}}.items():
        (tmp_path / "m" / k).mkdir(parents=True)
        (tmp_path / "m" / k / "plugin.json").write_text(json.dumps(m))
    assert [(r.id, r.name) for r in sources.manifests(spark, str(tmp_path / "m")).collect()] == [("p", "P")]
    rows = spark.createDataFrame([("mail a@b.org",), (None,)], "line string")
    from kelpline.functions.redaction import EXPORT_RULES

    counts = sources.export_redacted(rows, "line", EXPORT_RULES, str(tmp_path / "out")).collect()[0]
    assert (counts.lines, counts.redactions) == (2, 1)
    assert "mail [EMAIL]" in {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    sources.save_settings(spark.createDataFrame([("k", 1)], "a string, b int"), str(tmp_path / "s"))
    assert sources.load_settings(spark, str(tmp_path / "s"), "a string, b int").collect()[0].b == 1
    nested = spark.createDataFrame([(("to x@y.org", 1),)], "log struct<text:string,n:int>")
    assert sources.redact_struct(nested, "log", EXPORT_RULES).collect()[0].log.text == "to [EMAIL]"
    mixed = spark.createDataFrame([(1, None), (None, 2)], "file_id int, fileId int")
    assert [r.id for r in sources.coalesced(mixed, {"id": ("file_id", "fileId"), "x": ("none",)}, {"x": "-"}).collect()] == [1, 2]


def test_streamed_minute_counts_equal_the_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = jobs.minute_counts(jobs.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", 1))
    q = stream.writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.start, r.events) for r in spark.table("minutes").collect()}
    assert got == {(r.start, r.events) for r in jobs.minute_counts(batch).collect()}


def test_extensions(spark):
    r = Registry()
    assert r.add(Extension("b", "B", "1", lambda df: df.withColumn("x", F.col("x") * 2), order=2))
    assert r.add(Extension("a", "A", "1", lambda df: df.withColumn("x", F.col("x") + 1), order=1, needs=("b",)))
    assert not r.add(Extension("a", "again", "1", lambda df: df))
    assert not r.add(Extension("c", "", "1", lambda df: df))
    assert r.apply(spark.range(1).withColumnRenamed("id", "x")).collect()[0].x == 2
    assert r.table(spark).count() == 2
    assert r.reorder(["a"]) and [e.id for e in r.enabled()] == ["a", "b"]
    assert not r.reorder(["b", "unknown"]) and [e.id for e in r.enabled()] == ["a", "b"]


def test_settings_of_older_versions_lose_what_is_not_supported(spark):
    rows = [("a", True, 1), ("b", True, 1), ("c", True, None), ("d", True, 2), ("a2", False, 1), ("e", True, 3)]
    got = migrated(spark.createDataFrame(rows, "id string, enabled boolean, version int"), ["a", "a2"])
    assert {tuple(x) for x in got.collect()} == {("a", True, 2), ("b", False, 2), ("c", False, 2), ("d", True, 2), ("a2", False, 2), ("e", True, 3)}


def test_names_and_keys_that_are_not_known(spark):
    from kelpline.operators import listing, records

    keys = spark.createDataFrame([(3, "a", True, False), (1, "a", False, False), (2, "a", True, False), (4, "b", True, True)], "id int, name string, is_active boolean, is_system boolean")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "name string")
    assert sorted(map(tuple, records.keys_or_new(keys, asked).collect()), key=str) == [("a", 2, False), ("b", None, True), ("c", None, True)]
    named = listing.with_name(spark.createDataFrame([("x",), ("y",), (None,)], "by string"), "by", spark.createDataFrame([("x", "Ex")], "id string, name string"), "label")
    assert {tuple(x) for x in named.collect()} == {("x", "Ex"), ("y", "y"), (None, None)}


def test_highlights_of_months_at_the_borders(spark):
    from kelpline.operators import activity

    rows = [("/w/Downloads/a.bin", 1024, 1), ("/w/Plans/b.bin", 1024, 2), ("/w/Downloads/c.bin", 5000, 2), ("/w/Plans/d.bin", 10, 3), ("/w/Downloads/e.bin", 1025, 4), ("/w/Plans/f.bin", None, 4), (None, 9000, 5)]
    files = spark.createDataFrame(rows, "path string, size long, m int").selectExpr("path", "size", "make_timestamp(2024, m, 3, 0, 0, 0) as modified_at")
    got = {r.month: (r.files, r.file, r.file_size) for r in activity.month_highlights(files).collect()}
    assert got[0] == (1, None, None)  # 1 KB in a generic folder is too small
    assert got[1] == (2, "/w/Plans/b.bin", 1024)
    assert got[2] == (1, None, None)
    assert got[3] == (2, "/w/Downloads/e.bin", 1025)
    assert got[4][0] == 1
