"""Stages that can be cancelled, started anew, paused and resumed, and the progress of streams as rows.

A batch stage lands its output in a folder of its generation; a pointer that is renamed into place names the generation that
readers see. A cancelled run, or one that was overtaken by a newer start, never gets the pointer, so its output is never seen."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kelpline.streaming.tables import Pointer


class Stage:
    """One job at a time: a new start cancels the one that runs. Jobs are tagged, so cancelling ends Spark's work on them alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.pointer = Pointer(spark, f"{path}/_pointer")
        self.generation = max(self.pointer.numbers(), default=0)
        self.lock = threading.Lock()
        self.thread: threading.Thread | None = None
        self.tag = ""
        self.error: BaseException | None = None

    def start(self, build: Callable[[], DataFrame]) -> int:
        """Cancel what runs, then write ``build()`` as the next generation in the background; gives the generation."""
        self.cancel()
        with self.lock:
            self.generation += 1
            self.tag, self.error = f"stage-{uuid.uuid4().hex}", None
            self.thread = InheritableThread(target=self._run, args=(self.generation, self.tag, build))
            self.thread.start()
            return self.generation

    def _run(self, generation: int, tag: str, build: Callable[[], DataFrame]) -> None:
        context = self.spark.sparkContext
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            build().write.mode("overwrite").parquet(f"{self.path}/generation={generation}")
            with self.lock:
                if self.tag == tag:
                    self.pointer.publish(generation, {"generation": generation})
        except BaseException as error:  # a cancelled job ends so as well
            with self.lock:
                if self.tag == tag:
                    self.error = error
        finally:
            context.removeJobTag(tag)

    def cancel(self) -> bool:
        """End the run, if there is one; whether there was."""
        with self.lock:
            thread, tag = self.thread, self.tag
            self.tag, self.thread = "", None
        if thread is None:
            return False
        while thread.is_alive():  # a job may begin just after an interruption
            self.spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.2)
        return True

    def wait(self) -> None:
        """Until the run ends; raises what it raised."""
        thread = self.thread
        if thread:
            thread.join()
        if self.error:
            raise self.error

    def read(self) -> DataFrame | None:
        """What the last finished generation wrote; None before the first one."""
        state = self.pointer.read()
        return self.spark.read.parquet(f"{self.path}/generation={state['generation']}") if state else None


class PausedStream:
    """A stream that stops and goes on from its checkpoint. ``begin`` starts the query; it names the checkpoint."""

    def __init__(self, begin: Callable[[], StreamingQuery]):
        self.begin = begin
        self.query: StreamingQuery | None = None

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def resume(self) -> StreamingQuery:
        """Go on; a stream that runs is left alone (single flight)."""
        if not self.running:
            self.query = self.begin()
        return self.query

    def pause(self) -> None:
        """Stop after what is committed; a batch that was under way is done again on resuming."""
        if self.query is not None:
            self.query.stop()


def counted(files: DataFrame, kept: Column, name: str = "scan") -> DataFrame:
    """``files`` with the counters scanned and matched of every batch, under ``name``; nothing is read twice."""
    return files.observe(name, F.count("*").alias("scanned"), F.count_if(F.coalesce(kept, F.lit(False))).alias("matched"))


class ProgressLog(StreamingQueryListener):
    """Lands the named counters of every batch as rows, in order of arrival. A batch that is done again counts once."""

    def __init__(self, name: str = "scan"):
        self.name = name
        self.seen: dict[tuple[str, int], tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.seen[str(event.progress.id), event.progress.batchId] = (found["scanned"], found["matched"])

    def rows(self, spark: SparkSession) -> DataFrame:
        """(query, batch, scanned, matched, skipped): one row a batch; the tail of what a driver has seen, not of the data."""
        rows = [(query, batch, scanned, matched, scanned - matched) for (query, batch), (scanned, matched) in list(self.seen.items())]
        return spark.createDataFrame(rows, "query string, batch long, scanned long, matched long, skipped long")


def totals(progress: DataFrame) -> DataFrame:
    """One row (scanned, matched, skipped) of all batches."""
    return progress.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scanned", "matched", "skipped")))
