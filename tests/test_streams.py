"""Answer streams with state, events of landed files, scans over long groups: against their batch forms and plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kelpline.operators import answers, events, scans
from kelpline.sources import event_files
from kelpline.streaming import answers as streamed


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENT = "session string, seq long, type string, data string"


def made_events(seed, sessions=5, length=60):
    """Events of all types, with broken JSON and unknown types, in several batches."""
    pick, out = random.Random(seed), []
    hit = lambda: {"file_id": f"f{pick.randint(0, 9)}", "chunk_id": pick.choice([None, "", f"c{pick.randint(0, 30)}"]), "score": pick.choice([0.5, None]), "metadata": pick.choice([{}, {"index": pick.randint(1, 12)}])}
    verdict = lambda: {"index": pick.randint(1, 15), "chunk_id": pick.choice([None, f"c{pick.randint(0, 30)}"]), "has_answer": pick.random() < 0.5, "comment": "x", "confidence": 0.5}
    for k in range(sessions):
        for seq in range(length):
            kind = pick.choice(["token", "token", "status", "hits", "subquery_hits", "chunk_progress", "chunk_analysis", "thinking_step", "thinking_step", "error", "unknown", "multi_path_end", "user_decision_required"])
            if seq % 29 == 11:
                kind = "multi_path_start" if k % 2 else "token"
            kind = "done" if seq == length - 1 else kind
            data = {
                "token": lambda: pick.choice(["a ", "é", "\n", None]), "error": lambda: "bad", "done": lambda: pick.choice(["end", None]), "status": lambda: pick.choice(["searching", "analyzing_7_chunks", "searching_subquery_1_of_2", "other"]),
                "hits": lambda: json.dumps([hit() for _ in range(pick.randint(0, 4))]), "subquery_hits": lambda: json.dumps({"sub_query_index": 2, "hits": [hit()]}),
                "chunk_progress": lambda: json.dumps({"processed_count": seq, "total_count": 60, "current_file": pick.choice(["f", "", None]), "chunk_result": verdict()}), "chunk_analysis": lambda: json.dumps([verdict() for _ in range(3)]),
                "thinking_step": lambda: json.dumps({"id": f"s{pick.randint(0, 5)}", "title": f"t{seq}", "status": pick.choice(["running", "complete"])} | ({"hits": [1, 2]} if pick.random() < 0.4 else {})),
                "user_decision_required": lambda: json.dumps({"resume_token": f"r{seq}"}),
            }.get(kind, lambda: None)()
            out.append((f"s{k}", seq, kind, "{broken" if pick.random() < 0.03 and kind in ("hits", "chunk_progress") else data))
    return out


def ran(spark, folder, batches, stored=None, before_restart=2):
    """The last row of each session of a stream that stops after some batches and goes on from its checkpoint."""
    streamed.use_state_store(spark)
    where = str(folder)
    for k, rows in enumerate(batches):
        if k == before_restart:
            run_stream(spark, where, stored)
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{where}/in")
    run_stream(spark, where, stored)
    return {r.session: r for r in streamed.last_messages(spark.read.parquet(f"{where}/out")).collect()}


def run_stream(spark, where, stored):
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    rows = streamed.fold_answers(source, stored)
    q = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300)


def cut(rows, parts):
    """Batches that each have a run of every session's events."""
    most = max(r[1] for r in rows) + 1
    return [[r for r in rows if k * most // parts <= r[1] < (k + 1) * most // parts] for k in range(parts)]


def compare_messages(spark, last, log, messages, references):
    for r in messages.collect():
        for name in messages.columns:
            assert last[r.session][name] == r[name], (r.session, name)
    want = {s: [] for s in last}
    for r in references.orderBy("session", "position").collect():
        want[r.session].append(tuple(r)[1:])
    for session, found in want.items():
        assert [tuple(x) for x in last[session].references] == found, session
    steps = {s: [] for s in last}
    for r in answers.thinking_steps(log).orderBy("session", "position").collect():
        steps[r.session].append(tuple(r)[1:])
    return steps


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_answers_equal_the_batch_across_a_restart(spark, tmp_path, seed):
    rows = made_events(seed)
    last = ran(spark, tmp_path, cut(rows, 4))
    log = spark.createDataFrame(rows, EVENT)
    steps = compare_messages(spark, last, log, events.messages(log), events.references(log))
    assert {s: [tuple(x) for x in r.steps] for s, r in last.items()} == steps
    assert all(r.done for r in last.values())


def test_streamed_answers_go_on_from_stored_messages(spark, tmp_path):
    rows = made_events(7)
    hit = lambda n: (n, f"f{n}", f"c{n}" if n % 2 else None, 1.0, None, n if n > 2 else None, None if n < 3 else True, None, None)
    stored = [(f"s{k}", "so far ", k > 1, "token", [hit(n) for n in range(1, 5)], []) for k in range(5)]
    table = spark.createDataFrame(stored, f"session string, {streamed.STORED}")
    last = ran(spark, tmp_path, cut(rows, 3), table, 1)
    log = spark.createDataFrame(rows, EVENT)
    compare_messages(spark, last, log, answers.continued_messages(table, log), answers.continued_references(table, log))


def test_streamed_answers_leave_out_repeated_deliveries_and_take_null_sessions(spark, tmp_path):
    batches = [[("s", 1, "token", "a"), (None, 1, "token", "n")], [("s", 1, "token", "a"), ("s", 2, "done", "b")], [("s", 2, "done", "b")]]
    last = ran(spark, tmp_path, batches)
    assert {s: (r.text, r.done) for s, r in last.items()} == {"s": ("ab", True), None: ("n", False)}


def plain_frames(text, blocks):
    """Frames of a whole file, by a plain reading."""
    out, event, data = [], "message", []
    body = text.replace("\r\n", "\n")
    for line in body.split("\n")[:-1]:
        if line.startswith("event:"):
            event = line[6:].removeprefix(" ").strip()
        if line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
        if not line or not blocks:
            if any(data):
                out.append((event, "\n".join(data)))
            event, data = "message", []
    return out


def event_text(pick, n, ends):
    blocks = []
    for k in range(n):
        lines = [f"event: kind{k % 3}"] * (pick.random() < 0.6) + [f"data: {json.dumps({'k': k, 't': 'é' * pick.randint(0, 20)})}"] * pick.randint(0, 2) + [": comment"] * (pick.random() < 0.2)
        blocks.append("".join(line + ends for line in lines) + ends * pick.randint(1, 3))
    return "".join(blocks)


@pytest.mark.parametrize("split", [1, 7, 40, 10**9])
def test_event_files_are_the_same_for_every_cut(spark, tmp_path, split):
    pick, want = random.Random(split), []
    for name, ends in (("a", "\n"), ("b", "\r\n"), ("c", "\n")):
        text = event_text(pick, 12 if split == 1 else 60, ends) + pick.choice(["", "data: open", "data: open\n"])
        (tmp_path / name).write_bytes(text.encode())
        want += [(name, *frame) for frame in plain_frames(text, True)]
    (tmp_path / "empty").touch()
    found = event_files.event_files(spark, str(tmp_path), splitBytes=split).orderBy("stream", "position").collect()
    assert [(r.stream, r.event, r.data) for r in found] == want
    lines = event_files.event_files(spark, str(tmp_path), splitBytes=split, framing="lines").count()
    assert lines == sum(len(plain_frames((tmp_path / n).read_bytes().decode(), False)) for n in "abc")


def test_event_files_resume_at_their_offset_and_stop_at_complete(spark, tmp_path):
    streamed.use_state_store(spark)
    folder, pick = tmp_path / "in", random.Random(4)
    folder.mkdir()
    whole = {n: "".join(f"event: topic\ndata: {json.dumps({'type': 'complete' if k == last else 'topic', 'k': k})}\n\n" for k in range(30)) for n, last in (("a", 21), ("b", 99))}
    for n, text in whole.items():
        (folder / n).write_text("")

    def run():
        q = event_files.until_complete(event_files.event_files(spark, str(folder), stream=True)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    at = 0
    while at < max(map(len, whole.values())):
        step = pick.randint(500, 900)
        for n, text in whole.items():
            with (folder / n).open("a") as file:
                file.write(text[at : at + step])
        at += step
        run()
    got = sorted((r.stream, r.position, r.event, r.data) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = event_files.until_complete(event_files.event_files(spark, str(folder)))
    assert got == sorted(map(tuple, batch.collect()))
    assert {n: sum(g[0] == n for g in got) for n in whole} == {"a": 22, "b": 30}


@pytest.mark.parametrize("size", [3, 1000])
def test_framed_lines_equal_the_split_of_the_whole_text(spark, size):
    pick = random.Random(size)
    texts = {n: "".join(pick.choice(["ab", "é", "\n", " ", "\n\n"]) for _ in range(300)) for n in ("x", "hot", None)} | {"none": "no break", "empty": ""}
    texts["hot"] *= 20
    rows = [(n, k, text[k * size : (k + 1) * size]) for n, text in texts.items() for k in range(len(text) // size + 1)] + [("x", 10**6, None)]
    chunks = spark.createDataFrame(rows, "stream string, n long, chunk string")
    for last in (False, True):
        want = [(n, k, line) for n, text in texts.items() for k, line in enumerate(text.split("\n") if last else text.split("\n")[:-1]) if line.strip(" ")]
        got = [tuple(r) for r in scans.framed_lines(chunks, last=last).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert scans.framed_lines(chunks.limit(0)).count() == 0


def test_joined_segments_are_the_joined_text(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["hot", "hot", "x", None]), k, pick.choice([None, "", "é", "word " * pick.randint(1, 9)])) for k in range(500)]
    df = spark.createDataFrame(rows, "file string, ordinal long, chunk string")
    want = {f: "|".join(t for g, _, t in rows if g == f and t is not None) for f in ("hot", "x", None)}
    for size in (1, 7, 100, 10**6):
        found = scans.joined_segments(df, "file", "ordinal", "chunk", "|", size).collect()
        for f, text in want.items():
            own = sorted((r.segment, r.start, r.text) for r in found if r.file == f)
            assert "".join(x[2] for x in own) == text
            assert all(len(x[2]) <= size and text[x[1] : x[1] + len(x[2])] == x[2] for x in own)


def test_running_sums_with_ties_nulls_and_repeated_rows(spark):
    rows = [(k, o, v) for k in ("a", None) for o in (1, 1, 2, None) for v in (5, None, 5)]
    got = scans.running(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"], F.col("v")).collect()
    for key in ("a", None):
        own = sorted(r.before for r in got if r.k == key)
        assert len(own) == 12 and own[0] == 0 and own[-1] == 35
    assert re.match("k o v before", " ".join(got[0].__fields__))
