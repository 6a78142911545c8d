"""Answer streams as a stateful stream: one message per session, folded across batches and restarts, resumed from stored ones.

``AnswerFold`` holds typed state per session: a value with what is one of its kind (the last notice, progress, an open resume
token), lists of text parts and of hits, and maps of steps and judgements. A batch touches only what its events change, so a
long answer costs its new events, not its whole text, until its row is made. Stored messages are the initial state of a
stream, so a resumed answer goes on where it stopped. A timer clears sessions that have been done for a while.

The rules are those of ``operators/events`` and ``operators/answers``, and the last row of a session equals what these give
for all its events, as long as batches bring a session's events in order of ``seq``; within a batch they are sorted. Edge
cases: broken JSON counts as null fields; unknown types change nothing; a null session is a session of its own; an event that
is read again after a restart is not applied twice, since state and offsets are committed together, and an event whose
``seq`` is not above the last one applied (a repeated delivery) is left out.

Needs the RocksDB state store (``use_state_store``)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kelpline.functions.labels import STATUS_TEXTS

HIT = "struct<position:long,file_id:string,chunk_id:string,score:double,snippet:string,index:long,has_answer:boolean,comment:string,confidence:double>"
STEP = "struct<position:long,id:string,title:string,status:string,hits:long>"
#: A session's message after a batch.
MESSAGE = f"text string, meta string, is_multi boolean, needs_decision boolean, resume_token string, processed long, total long, complete boolean, done boolean, references array<{HIT}>, steps array<{STEP}>"
#: Stored messages from which sessions go on.
STORED = f"text string, is_multi boolean, resume_token string, references array<{HIT}>, steps array<{STEP}>"

_HEAD = "seq long, meta string, is_multi boolean, needs_decision boolean, resume_token string, processed long, total long, complete boolean, done boolean, resumed boolean, held long, steps long"
_HEAD_NAMES = [x.split()[0] for x in _HEAD.split(", ")]
_HIT_NAMES = ["file_id", "chunk_id", "score", "snippet", "index", "has_answer", "comment", "confidence"]
_OUT = Row("session", *re.findall(r"(?:^|, )(\w+) ", re.sub("<.*?>+", "", MESSAGE)))
_VERDICT = "seq long, has_answer boolean, comment string, confidence double"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _status(code: str) -> str:
    """``labels.status_text`` of one value."""
    chunks, part = re.search(r"analyzing_([0-9]+)_chunks", code), re.search(r"searching_subquery_([0-9]+)_of_([0-9]+)", code)
    if chunks:
        return f"Starting analysis of {chunks[1]} sources..."
    return f"Searching sub-query {part[1]}/{part[2]}..." if part else STATUS_TEXTS.get(code, code)


def _parsed(data: str | None) -> Any:
    try:
        return json.loads(data) if data else None
    except ValueError:
        return None


def _text(value: Any) -> str | None:
    """A JSON value as ``get_json_object`` gives it."""
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def _field(data: Any, name: str) -> Any:
    return data.get(name) if isinstance(data, dict) else None


def _long(value: Any) -> int | None:
    try:
        return None if value is None or isinstance(value, bool) else int(value)
    except (TypeError, ValueError):
        return None


def _length(value: Any) -> int | None:
    return len(value) if isinstance(value, list) else None


class AnswerFold(StatefulProcessor):
    """One row of ``MESSAGE`` per session and batch. ``keep_ms``: a session that is done is forgotten after so long; 0 keeps it."""

    def __init__(self, keep_ms: int = 0):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.parts = handle.getListState("parts", "part string")
        self.hits = handle.getListState("hits", "file_id string, chunk_id string, score double, snippet string, index long, has_answer boolean, comment string, confidence double")
        self.steps = handle.getMapState("steps", "id string", "position long, title string, status string, hits long")
        self.by_chunk = handle.getMapState("by_chunk", "chunk_id string", _VERDICT)
        self.by_place = handle.getMapState("by_place", "place long", _VERDICT)
        # of resumed answers: the last judgement made on the way, which replaces earlier ones
        self.last_of_chunk = handle.getMapState("last_of_chunk", "chunk_id string", _VERDICT)
        self.last_of_place = handle.getMapState("last_of_place", "place long", _VERDICT)

    def _loaded(self) -> dict[str, Any]:
        values = self.head.get() if self.head.exists() else (-(1 << 62), None, False, False, None, None, None, False, False, False, 0, 0)
        return dict(zip(_HEAD_NAMES, values, strict=True))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        stored = initialState
        head = self._loaded() | {"is_multi": bool(stored.is_multi), "resume_token": None, "resumed": True}
        references, steps = (sorted(rows or [], key=lambda r: r["position"]) for rows in (stored.references, stored.steps))
        if stored.text:
            self.parts.appendValue((stored.text,))
        if references:
            self.hits.put([tuple(r[n] for n in _HIT_NAMES) for r in references])
        for step in steps:
            self.steps.updateValue((step["id"] or "",), (step["position"], step["title"], step["status"], step["hits"]))
        head |= {"held": len(references), "steps": max((s["position"] for s in steps), default=0)}
        self.head.update(tuple(head.values()))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        head, said = self._loaded(), []
        for event in sorted(rows, key=lambda r: r.seq):
            if event.seq > head["seq"]:
                head["seq"] = event.seq
                apply = getattr(self, f"_on_{event.type}", None)
                if apply:
                    apply(head, event, said)
        if said:
            self.parts.appendValue(("".join(said),))
        self.head.update(tuple(head.values()))
        if self.keep_ms and head["done"]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield self._row(key[0], head)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.head, self.parts, self.hits, self.steps, self.by_chunk, self.by_place, self.last_of_chunk, self.last_of_place):
            state.clear()
        return iter([])

    # what each type of event changes

    def _on_token(self, head: dict, event: Row, said: list[str]) -> None:
        said.append(event.data or "")

    def _on_done(self, head: dict, event: Row, said: list[str]) -> None:
        said.append(event.data or "")
        head |= {"meta": None, "done": True}

    def _on_error(self, head: dict, event: Row, said: list[str]) -> None:
        if event.data is not None:
            said.append(f"\n[Error: {event.data}]")
        head["meta"] = "Error"

    def _on_status(self, head: dict, event: Row, said: list[str]) -> None:
        if event.data is not None:
            head["meta"] = _status(event.data)

    def _on_user_decision_required(self, head: dict, event: Row, said: list[str]) -> None:
        head |= {"meta": "Waiting for confirmation...", "needs_decision": True, "resume_token": _text(_field(_parsed(event.data), "resume_token"))}

    def _on_multi_path_start(self, head: dict, event: Row, said: list[str]) -> None:
        self.steps.clear()
        head |= {"is_multi": True, "steps": 0}

    def _on_multi_path_end(self, head: dict, event: Row, said: list[str]) -> None:
        for (step,), (position, title, status, hits) in list(self.steps.iterator()) if self.steps.exists() else []:
            if status == "running":
                self.steps.updateValue((step,), (position, title, "complete", hits))

    def _on_thinking_step(self, head: dict, event: Row, said: list[str]) -> None:
        data = _parsed(event.data)
        step = (_text(_field(data, "id")) or "",)
        known = self.steps.getValue(step) if self.steps.exists() and self.steps.containsKey(step) else None
        if known is None:
            head["steps"] += 1
        hits = _length(_field(data, "hits"))
        hits = hits if hits is not None or known is None else known[3]
        self.steps.updateValue(step, (known[0] if known else head["steps"], _text(_field(data, "title")), _text(_field(data, "status")), hits))

    def _on_hits(self, head: dict, event: Row, said: list[str]) -> None:
        data = _parsed(event.data)
        head["meta"] = f"Found {_length(data) or 0} sources"
        self._take(head, data, replaces=not head["is_multi"], merges=head["is_multi"] and head["held"] > 0)

    def _on_subquery_hits(self, head: dict, event: Row, said: list[str]) -> None:
        data = _parsed(event.data)
        found, number = _field(data, "hits"), _text(_field(data, "sub_query_index"))
        if number is not None:
            head["meta"] = f"Sub-query {number}: Found {_length(found) or 0} sources"
        self._take(head, found, replaces=False, merges=False)

    def _take(self, head: dict, data: Any, replaces: bool, merges: bool) -> None:
        """Hits of a list replace what there is, or are added; merging leaves out those that are known: by their number, or in a
        resumed answer by chunk or file."""
        new = []
        for hit in data if isinstance(data, list) else []:
            index = _long(_field(_field(hit, "metadata"), "index"))
            score = _field(hit, "score")
            new.append((_text(_field(hit, "file_id")) or "", _text(_field(hit, "chunk_id")) or None, float(score) if isinstance(score, (int, float)) else 0.0, _text(_field(hit, "snippet")), index, None, None, None))
        if merges:
            held = list(self.hits.get()) if self.hits.exists() else []
            if head["resumed"]:
                known = {h[1] or h[0] for h in held}
                new = [h for h in new if (h[1] or h[0]) not in known]
            else:
                known, fresh = {h[4] for h in held}, []
                for hit in new:
                    if hit[4] is not None and hit[4] not in known:
                        known.add(hit[4])
                        fresh.append(hit)
                new = fresh
        if replaces:
            self.hits.clear()
            head["held"] = 0
        if new:
            self.hits.appendList(new)
        head["held"] += len(new)

    def _on_chunk_progress(self, head: dict, event: Row, said: list[str]) -> None:
        data = _parsed(event.data)
        head["meta"] = f"Analyzing {_text(_field(data, 'current_file')) or 'source'}..."
        head |= {"processed": _long(_field(data, "processed_count")), "total": _long(_field(data, "total_count")), "complete": False}
        self._judge(head, event.seq, [_field(data, "chunk_result")], head["resumed"])

    def _on_chunk_analysis(self, head: dict, event: Row, said: list[str]) -> None:
        data = _parsed(event.data)
        head |= {"processed": _length(data), "total": _length(data), "complete": True}
        self._judge(head, event.seq, data if isinstance(data, list) else [], False)

    def _judge(self, head: dict, seq: int, verdicts: list, again: bool) -> None:
        """Remember the first judgement of a chunk and of a place; with ``again`` the last one."""
        states = (self.last_of_chunk, self.last_of_place) if again else (self.by_chunk, self.by_place)
        for verdict in verdicts:
            if not isinstance(verdict, dict):
                continue
            index, answer, confidence = _long(verdict.get("index")), verdict.get("has_answer"), verdict.get("confidence")
            value = (seq, answer if isinstance(answer, bool) else None, _text(verdict.get("comment")), float(confidence) if isinstance(confidence, (int, float)) else None)
            for state, name in zip(states, (_text(verdict.get("chunk_id")), index), strict=True):
                if name is None or name == "":
                    continue
                if again or not state.exists() or not state.containsKey((name,)):
                    state.updateValue((name,), value)

    def _row(self, session: Any, head: dict) -> Row:
        text = "".join(p[0] for p in self.parts.get()) if self.parts.exists() else ""
        maps = [{k[0]: v for k, v in state.iterator()} if state.exists() else {} for state in (self.by_chunk, self.by_place, self.last_of_chunk, self.last_of_place)]
        references = []
        for position, (file_id, chunk_id, score, snippet, index, *judged) in enumerate(self.hits.get() if self.hits.exists() else [], 1):
            place = position if index is None else index
            first = maps[0].get(chunk_id) or maps[1].get(place)
            last = max((v for v in (maps[2].get(chunk_id), maps[3].get(place)) if v), key=lambda v: v[0], default=None)
            if last or first and judged[0] is None:
                judged = (last or first)[1:]
            references.append((position, file_id, chunk_id, score, snippet, index, *judged))
        steps = sorted((v[0], k[0] or None, *v[1:]) for k, v in self.steps.iterator()) if self.steps.exists() else []
        shown = [head[n] for n in ("meta", "is_multi", "needs_decision", "resume_token", "processed", "total", "complete", "done")]
        return _OUT(session, text, *shown, references, steps)


def fold_answers(events: DataFrame, stored: DataFrame | None = None, keep_ms: int = 0) -> DataFrame:
    """(session, MESSAGE) of a stream of events (session, seq, type, data), a row per session and batch in update mode;
    ``stored`` (session, STORED) are messages that are resumed."""
    kind = events.schema["session"].dataType.simpleString()
    initial = stored.groupBy("session") if stored is not None else None
    return events.groupBy("session").transformWithState(AnswerFold(keep_ms), f"session {kind}, {MESSAGE}", "update", "ProcessingTime" if keep_ms else "None", initialState=initial)


def last_messages(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """The newest row of each session of a landed stream with batch numbers."""
    rest = [c for c in rows.columns if c not in ("session", batch)]
    return rows.groupBy("session").agg(F.max_by(F.struct(*rest), batch).alias("x")).select("session", "x.*")
