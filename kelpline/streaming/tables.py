"""Keyed tables in files that are rewritten by bucket: upserts, deletes and purges of few keys write few buckets.

A table is dealt into hash buckets of its key. A version holds only the buckets that it changed; a pointer, renamed into place
when all is written, names for each bucket the version that counts. Readers see one pointer, so they see whole versions. Rows
are compared with those stored before anything is written: a batch that brings nothing new writes nothing."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Pointer:
    """Numbered JSON files in a folder of any file system; the highest number counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.context = spark.sparkContext
        self.path = path

    def _at(self, name: str = ""):
        return self.context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._at().getFileSystem(self.context._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        system, root = self._system(), self._at()
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self) -> dict[str, Any] | None:
        numbers = self.numbers()
        if not numbers:
            return None
        stream = self._system().open(self._at(str(numbers[-1])))
        try:
            return json.loads(self.context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, state: dict[str, Any]) -> None:
        """Write under another name, then rename; a number that is there already is an error."""
        system, draft = self._system(), self._at(f"draft-{number}")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if not system.rename(draft, self._at(str(number))):
            raise RuntimeError(f"version {number} of {self.path} was published by another writer")

    def forget(self, number: int) -> None:
        self._system().delete(self._at(str(number)), False)


class KeyedTable:
    """One row for each value of ``key``. ``compare`` names the columns that tell whether a row changed (path, time, size and
    digest of a file, say); without it all do. One writer at a time; a second one fails when it publishes."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, compare: list[str] | None = None):
        self.spark, self.path, self.key, self.buckets, self.compare = spark, path, key, buckets, compare
        self.pointer = Pointer(spark, f"{path}/_pointer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def state(self) -> dict[str, Any]:
        return self.pointer.read() or {"version": 0, "batch": -1, "buckets": {}, "schema": None}

    def _stored(self, state: dict[str, Any], only: list[int] | None = None) -> DataFrame | None:
        wanted = [f"{self.path}/version={v}/_b={b}" for b, v in state["buckets"].items() if only is None or int(b) in only]
        if state["schema"] is None:
            return None
        return self.spark.read.schema(state["schema"]).parquet(*wanted) if wanted else self.spark.createDataFrame([], state["schema"])

    def read(self) -> DataFrame | None:
        """The table as it is published; None before the first version."""
        return self._stored(self.state())

    def apply(self, rows: DataFrame | None = None, order: str | None = None, deletes: DataFrame | None = None, batch: int | None = None) -> list[int]:
        """Upsert ``rows``, remove the keys of ``deletes``, publish; gives the buckets that were rewritten.

        Of several rows of one key the latest by ``order`` and then by all columns counts; a key in both is removed. Null keys
        are a key. A ``batch`` number that was applied already, or a lower one, changes nothing. The columns are those of the
        first rows."""
        state = self.state()
        if batch is not None and batch <= state["batch"]:
            return []
        if rows is None and state["schema"] is None:
            return []
        columns = rows.columns if rows is not None else self._stored(state).columns
        schema = state["schema"] or _ddl(rows)
        latest = None
        if rows is not None:
            rest = [c for c in columns if c not in (self.key, order)]
            by = F.struct(*([order] if order and order != self.key else []), *rest)
            latest = rows.groupBy(self.key).agg(F.max(by).alias("_x")).select(self.key, "_x.*").select(columns)
        gone = deletes.select(self.key).distinct() if deletes is not None else None
        if latest is not None and gone is not None:
            latest = latest.alias("a").join(gone.alias("b"), F.col(f"a.{self.key}").eqNullSafe(F.col(f"b.{self.key}")), "left_anti")
        touched = None
        for part in (latest, gone):
            if part is not None:
                own = part.select(self._bucket().alias("_b")).distinct()
                touched = own if touched is None else touched.union(own)
        touched = sorted({r._b for r in touched.collect()})  # at most ``buckets`` numbers
        stored = self._stored(state, touched)
        changed, removed = latest, None
        if stored is not None:
            if latest is not None:
                marks = [c for c in self.compare or columns if c != self.key]
                known = stored.select(F.col(self.key).alias("_key"), F.struct(*marks).alias("_before"))
                changed = latest.join(known, F.col(self.key).eqNullSafe(F.col("_key")), "left").where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*marks))).select(columns)
            if gone is not None:
                removed = gone.alias("a").join(stored.alias("b"), F.col(f"a.{self.key}").eqNullSafe(F.col(f"b.{self.key}")), "left_semi")
        keys = None
        for part in (changed, removed):
            if part is not None:
                own = part.select(F.col(self.key).alias("_key"), self._bucket().alias("_b"))
                keys = own if keys is None else keys.unionByName(own)
        keys = keys.persist() if keys is not None else None
        try:
            dirty = sorted({r._b for r in keys.select("_b").distinct().collect()}) if keys is not None else []
            if not dirty:
                if batch is not None:
                    self.pointer.publish(state["version"] + 1, {**state, "version": state["version"] + 1, "batch": batch})
                return []
            version, out = state["version"] + 1, changed
            if stored is not None:
                before = self._stored(state, dirty)
                left = before.join(keys, before[self.key].eqNullSafe(F.col("_key")), "left_anti")
                out = left if changed is None else left.unionByName(changed)
            target = f"{self.path}/version={version}"
            out.withColumn("_b", self._bucket()).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(target)
            filled = self._filled(target)
            buckets = {b: v for b, v in state["buckets"].items() if int(b) not in dirty} | {str(b): version for b in dirty if b in filled}
            self.pointer.publish(version, {"version": version, "batch": state["batch"] if batch is None else batch, "buckets": buckets, "schema": schema})
            return dirty
        finally:
            if keys is not None:
                keys.unpersist()

    def _filled(self, path: str) -> set[int]:
        """The buckets that a version wrote; one that lost all its rows has none."""
        system, root = self.pointer._system(), self.pointer.context._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return {int(n[3:]) for n in names if n.startswith("_b=")}

    def vacuum(self) -> int:
        """Delete pointers before the current one and buckets that it doesn't name; gives how many buckets went."""
        state, system = self.state(), self.pointer._system()
        path = self.pointer.context._jvm.org.apache.hadoop.fs.Path
        for number in self.pointer.numbers()[:-1]:
            self.pointer.forget(number)
        gone = 0
        for folder in system.listStatus(path(self.path)):
            name = folder.getPath().getName()
            if not name.startswith("version="):
                continue
            for bucket in system.listStatus(folder.getPath()):
                part = bucket.getPath().getName()
                if part.startswith("_b=") and str(state["buckets"].get(part[3:])) != name[8:]:
                    system.delete(bucket.getPath(), True)
                    gone += 1
        return gone


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def upsert_batches(stream: DataFrame, table: KeyedTable, order: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of every key of a stream; a later batch wins over an earlier one, a repeated batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read several times; what is observed in it counts once
        try:
            table.apply(batch, order, batch=number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
