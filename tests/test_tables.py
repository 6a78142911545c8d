"""Rewrites by bucket, stages that are cancelled and started anew, progress of streams, indexes and trees."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from kelpline.operators import index, moves, trees
from kelpline.sources import files as sources
from kelpline.streaming import control, jobs, tables

FILE = "path string, modified_at long, size long, digest string"


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def folders(tmp_path):
    return sorted(f"{p.parent.name}/{p.name}" for p in tmp_path.glob("version=*/_b=*"))


def test_few_keys_write_few_buckets(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path), "path", buckets=16, compare=["modified_at", "size", "digest"])
    assert table.read() is None and table.apply(deletes=spark.createDataFrame([("x",)], "path string")) == []
    first = [(f"/f{k}", 1, k, "d") for k in range(200)] + [(None, 1, 1, "null key")]
    assert len(table.apply(spark.createDataFrame(first, FILE), "modified_at")) == 16
    assert rows_of(table) == sorted(first, key=repr)
    before = folders(tmp_path)
    # the same rows again, and an older row of a key, change nothing
    assert table.apply(spark.createDataFrame(first[:50], FILE), "modified_at") == []
    assert folders(tmp_path) == before
    new = [("/f3", 2, 3, "e"), ("/f3", 1, 9, "old"), ("/new", 1, 1, "n"), (None, 2, 2, "x")]
    dirty = table.apply(spark.createDataFrame(new, FILE), "modified_at")
    assert 1 <= len(dirty) <= 3 and len(folders(tmp_path)) == len(before) + len(dirty)
    want = {r[0]: r for r in first} | {"/f3": new[0], "/new": new[2], None: new[3]}
    assert rows_of(table) == sorted(want.values(), key=repr)
    gone = spark.createDataFrame([("/f5",), ("/f5",), ("/missing",), (None,)], "path string")
    assert 1 <= len(table.apply(deletes=gone)) <= 2
    for key in ("/f5", None):
        want.pop(key)
    assert rows_of(table) == sorted(want.values(), key=repr)
    assert table.apply(deletes=gone) == []
    assert table.vacuum() > 0 and rows_of(table) == sorted(want.values(), key=repr)
    assert len(folders(tmp_path)) == len(table.state()["buckets"])


def test_a_key_that_is_brought_and_removed_is_gone_and_a_bucket_may_empty(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path), "path", buckets=4)
    table.apply(spark.createDataFrame([("a", 1, 1, "d"), ("b", 1, 1, "d")], FILE), "modified_at")
    both = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    table.apply(spark.createDataFrame([("c", 1, 1, "d"), ("a", 2, 2, "e")], FILE), "modified_at", both)
    assert table.read().count() == 0 and table.state()["buckets"] == {}
    table.apply(spark.createDataFrame([("a", 3, 3, "f")], FILE), "modified_at")
    assert rows_of(table) == [("a", 3, 3, "f")]


def test_random_batches_equal_a_dictionary_and_repeats_change_nothing(spark, tmp_path):
    pick, want = random.Random(3), {}
    table = tables.KeyedTable(spark, str(tmp_path), "path", buckets=8)
    for batch in range(4):
        rows = [(f"k{pick.randint(0, 30)}", batch, pick.randint(0, 2), pick.choice("ab")) for _ in range(pick.randint(1, 12))]
        gone = [(f"k{pick.randint(0, 30)}",) for _ in range(2)]
        for row in sorted(rows, key=lambda r: r[1:]):
            want[row[0]] = row
        for (key,) in gone:
            want.pop(key, None)
        for _ in range(2):
            table.apply(spark.createDataFrame(rows, FILE), "modified_at", spark.createDataFrame(gone, "path string"), batch)
        assert rows_of(table) == sorted(want.values(), key=repr)
    assert table.apply(spark.createDataFrame([("late", 9, 9, "z")], FILE), "modified_at", batch=1) == []


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(9):
        (folder / f"f{k}.{'pdf' if k % 3 else 'zzz'}").write_text("x" * (k + 1))
    return folder


def test_streamed_upserts_and_progress_equal_the_batch(spark, landed, tmp_path):
    table, log = tables.KeyedTable(spark, str(tmp_path / "out"), "path", buckets=4), control.ProgressLog()
    spark.streams.addListener(log)
    try:
        kept = F.col("extension") == "pdf"
        stream = PausedFiles(spark, landed, table, str(tmp_path / "cp"), kept)
        stream.resume().awaitTermination(120)
        (landed / "late.pdf").write_text("y")
        stream.pause()
        stream.resume().awaitTermination(120)
        deadline = time.time() + 30
        while control.totals(log.rows(spark)).first().scanned < 10 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert table.read().count() == 10
    listing = sources.list_files(spark, [str(landed)])
    assert tuple(control.totals(log.rows(spark)).first()) == tuple(sources.scan_counts(listing, kept).first())
    assert log.rows(spark).count() > 3


class PausedFiles(control.PausedStream):
    def __init__(self, spark, folder, table, checkpoint, kept):
        super().__init__(lambda: tables.upsert_batches(control.counted(jobs.new_files(spark, str(folder), 2), kept), table, "modified_at", checkpoint))


def test_a_cancelled_run_is_never_seen_and_a_restart_finds_every_file_once(spark, landed, tmp_path):
    stage = control.Stage(spark, str(tmp_path / "out"))
    begun = threading.Event()

    def slow():
        begun.set()
        return spark.range(0, 64, 1, 64).select(F.expr("java_method('java.lang.Thread', 'sleep', 3000L)").alias("path"))

    assert stage.read() is None and not stage.cancel()
    stage.start(slow)
    assert begun.wait(30)
    time.sleep(1)
    start = time.time()
    assert stage.cancel() and time.time() - start < 20
    stage.wait()
    assert stage.read() is None
    stage.start(slow)
    last = stage.start(lambda: sources.list_files(spark, [str(landed)]))  # overtakes the slow one
    stage.wait()
    assert last == 3 and stage.pointer.numbers() == [3]
    assert stage.read().count() == 9 == stage.read().select("path").distinct().count()
    again = control.Stage(spark, str(tmp_path / "out"))
    assert again.start(lambda: spark.range(1)) == 4
    again.wait()
    assert again.read().count() == 1
    again.start(lambda: spark.range(1).select(F.raise_error(F.lit("no")).alias("x")))
    with pytest.raises(Exception, match="no"):
        again.wait()
    assert again.read().count() == 1


DOCS = [(1, "The cat. THE dog"), (2, ""), (3, None), (4, "dog dog dog"), (5, "Über the 日本"), (6, "a.b%c_d the"), (7, "x" * 5000 + "needle" + "y" * 5000)]


def test_index_finds_what_a_plain_search_finds(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id int, text string")
    needles = [(1, "the"), (2, "b%c_"), (3, "日本"), (4, "D"), (5, ""), (6, None), (7, "needle"), (8, "none such"), (9, "ÜBER"), (10, "THE")]
    asked = spark.createDataFrame(needles, "needle_id int, needle string")
    want = sorted((n, i) for n, needle in needles if needle is not None for i, text in DOCS if needle.lower() in (text or "").lower())
    grams = index.gram_index(docs, "id", "text")
    index.write_index(grams, "gram", "id", str(tmp_path / "grams"), buckets=8)
    for table in (grams, index.read_index(spark, str(tmp_path / "grams"))):
        assert sorted(map(tuple, index.substring_matches(table, docs, asked, "id", "text", buckets=8).collect())) == want
    assert index.substring_matches(grams, docs, asked.limit(0), "id", "text").count() == 0


def test_written_index_gives_the_same_scores_and_reads_its_buckets_alone(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id int, text string")
    plain = index.inverted_index(docs, "id", "text")
    index.write_index(plain, "term", "id", str(tmp_path / "terms"), buckets=8)
    asks = spark.createDataFrame([("q", "THE dog"), ("r", "unknown"), ("s", None), ("t", "日本 dog dog")], "query string, text string")
    found = [sorted(map(tuple, index.lexical_search(t, asks, "id", 2, 8).collect())) for t in (plain, index.read_index(spark, str(tmp_path / "terms")))]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"q", "t"} and max(r[3] for r in found[0]) == 2
    assert [r[1] for r in found[0] if r[0] == "q"] == [1, 4]
    lookup = index.lookup(index.read_index(spark, str(tmp_path / "terms")), spark.createDataFrame([("dog",)], "term string"), "term", 8)
    assert "PartitionFilters: [isnotnull(bucket" in lookup._jdf.queryExecution().toString() and lookup.count() == 2


def below_by_force(links, roots):
    parents, out = dict(links), set()
    for node in parents:
        seen, at = set(), node
        while at is not None and at not in seen and at in parents:
            if at in roots:
                out.add(node)
                break
            seen.add(at)
            at = parents[at]
    return out


@pytest.mark.parametrize("shape", ["chain", "random", "cycle", "wide"])
def test_subtree_equals_a_walk(spark, shape):
    pick = random.Random(shape)
    links = {
        "chain": [(k, k - 1 if k else None) for k in range(300)], "random": [(k, pick.choice([None, 500, *range(k)]) if k else None) for k in range(120)],
        "cycle": [(k, (k + 1) % 7) for k in range(7)] + [(k, (k - 19) % 5 + 20) for k in range(20, 25)] + [(30, 2), (31, 22), (32, 32), (33, 32)], "wide": [(0, None)] + [(k, 0) for k in range(1, 400)],
    }[shape]
    roots = {"chain": {130}, "random": {3, 17, 999}, "cycle": {3}, "wide": {0}}[shape]
    found = trees.subtree(spark.createDataFrame(links, "id int, parent int"), spark.createDataFrame([(r,) for r in roots], "id int"))
    assert sorted(r.id for r in found.collect()) == sorted(below_by_force(links, roots))
    assert trees.subtree(spark.createDataFrame([], "id int, parent int"), spark.createDataFrame([(1,)], "id int")).count() == 0


def test_locale_order_by_letters_accents_case_and_numbers(spark):
    names = ["b", "B", "á", "a", "Á", "A", "z10", "z9", "Z2", "_x", "", None, "z009"]
    rows = spark.createDataFrame([(1, n, k) for k, n in enumerate(names)], "parent int, name string, id int")
    order = [r.name for r in trees.locale_places(rows, "parent", "name", "id").orderBy("place").collect()]
    assert order[:2] == [None, ""] and order[2:9] == ["_x", "a", "A", "á", "Á", "b", "B"]
    numeric = [r.name for r in trees.locale_places(rows, "parent", "name", "id", numeric=True).orderBy("place").collect()]
    assert numeric[9:] == ["Z2", "z009", "z9", "z10"]
    plan = trees.locale_places(rows, "parent", "name", "id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "collat" in plan.lower()
    same = {(r.first, r.n) for r in trees.same_names(rows, "parent", "name", "id").collect()}
    assert same == {("A", 4), ("B", 2)}


def test_moves_collide_with_nothing_and_are_undone(spark):
    pick = random.Random(6)
    rows = [(f"/in/{k}/{pick.choice(['a.txt', 'a (2).txt', 'b', 'b (2)', '.hidden', 'é.tar.gz'])}", pick.choice(["/out", "/out/", "/x", None])) for k in range(60)]
    rows += [("/out/a.txt", None), ("/out/a (3).txt", "/out"), ("/x/b", "/out"), (None, "/out"), ("/in/0/same", "/x"), ("/in/0/same", "/x")]
    files = spark.createDataFrame(rows, "path string, folder string")
    plan = {r.path: r.target for r in moves.plan(files, "folder").collect()}
    paths = {p for p, _ in rows if p}
    staying = paths - set(plan)
    assert len(set(plan.values())) == len(plan) and not set(plan.values()) & staying
    wanted = {p: f for p, f in rows if p}
    assert set(plan) == {p for p, f in wanted.items() if f and f"{f.rstrip('/')}/{p.rsplit('/', 1)[1]}" != p}
    assert all(t.rsplit("/", 1)[0] == wanted[p].rstrip("/") for p, t in plan.items())
    plain = [p for p, t in plan.items() if t.rsplit("/", 1)[1] == p.rsplit("/", 1)[1]]
    assert len(plain) >= 6
    table = files.where("path is not null").dropDuplicates(["path"])
    log = moves.plan(files, "folder")
    after = moves.executed(table, log)
    assert after.select("path").distinct().count() == table.count()
    assert sorted(map(tuple, moves.undone(after, log).collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    assert {r.folder for r in moves.emptied(table, log).collect()} == {p.rsplit("/", 1)[0] for p in plan} - {p.rsplit("/", 1)[0] for p in staying} - {t.rsplit("/", 1)[0] for t in plan.values()}
    assert moves.plan(files.limit(0), "folder").count() == 0
