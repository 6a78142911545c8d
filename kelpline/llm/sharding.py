"""Operator 7: shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 63-bit hashes. A row's key is the hash of its text, so equal texts start
at one point; it goes to the first shard clockwise that is not full, and rows that overflow a full shard continue
clockwise. The bounds are exact: n rows give every shard n // shards rows, the first n % shards one more, so the counts
are at most one apart (law ``rows``). When a shard or some rows are added, only rows near the new points, and those
that overflow differently, move.

How far each arc (the keys between two points) overflows depends only on the arcs' row counts, a table as long as the
ring. Rows are put in ring order by a range partitioning on (arc, key, tie), where the tie splits a text that holds a
third of all rows by the id, and equal ids by a row number; a row's place in that order then gives shard and slot. What reaches the driver is one count per arc
and per partition.

Edge cases: a null text counts as no bytes (size 8, the key of an empty text); repeated rows each get their own slot;
ties are ordered by a hash of the id; a null id is placed like any other; an empty table gives an empty result; very
long texts only matter for their size; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import written

SPACE = 1 << 63


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in ring order, and their shards."""
    points = sorted((int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % SPACE, s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def overflow(counts: np.ndarray, owner: np.ndarray, caps: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, first rank in the arc, rows, shard) from the rows of each arc: rows that find a shard full go on clockwise."""
    left = caps.copy()
    out = []
    waiting = [(arc, 0, int(n)) for arc, n in enumerate(counts) if n]
    hop = 0
    while waiting:
        after = []
        for arc, start, n in waiting:
            s = owner[(arc + hop) % len(owner)]
            take = min(n, int(left[s]))
            if take:
                left[s] -= take
                out.append((arc, start, take, int(s)))
            if n > take:
                after.append((arc, start + take, n - take))
        waiting = after
        hop += 1
    return out


def bounded_ring(docs: DataFrame, shards: int = 24, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    positions, owner = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).bitwiseAND(F.lit(SPACE - 1)).alias("key"))

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(positions, batch.column(3).to_numpy()) % len(positions)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc.astype(np.int32))], ["id", "size", "crc", "key", "arc"])

    placed = rows.mapInArrow(arcs, "id long, size long, crc long, key long, arc int").withColumn("tie", F.xxhash64(F.lit(5), "id")).withColumn("row", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("arc", "key", "tie", "row").sortWithinPartitions("arc", "key", "tie", "id", "row")
    ordered = written(ordered.select("id", "size", "crc", "arc", F.monotonically_increasing_id().alias("place")), "ring")
    part = F.shiftright("place", 33)
    counts = np.zeros(len(positions), np.int64)
    before: dict[int, int] = {}
    for r in ordered.groupBy(part.alias("part"), "arc").agg(F.count("*").alias("n")).collect():  # at most partitions + arcs rows
        counts[r.arc] += r.n
        before[r.part] = before.get(r.part, 0) + r.n
    total = int(counts.sum())
    caps = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    arc_start = np.cumsum(counts) - counts
    segments = sorted((int(arc_start[arc]) + start, n, s) for arc, start, n, s in overflow(counts, owner, caps))
    starts, shard_of = np.array([x[0] for x in segments], np.int64), np.array([x[2] for x in segments], np.int32)
    slots, used = [], np.zeros(shards, np.int64)
    for _, n, s in segments:
        slots.append(int(used[s]))
        used[s] += n
    slot_base = np.array(slots, np.int64)
    numbers = sorted(before)
    part_start = np.zeros(numbers[-1] + 1 if numbers else 1, np.int64)
    done = 0
    for p in numbers:
        part_start[p] = done
        done += before[p]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            rank = part_start[at >> 33] + (at & ((1 << 33) - 1))
            k = np.searchsorted(starts, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard_of[k]), pa.array(slot_base[k] + rank - starts[k])], ["id", "size", "crc", "shard", "slot"])

    out = ordered.select("id", "size", "crc", "place").mapInArrow(place, "id long, size long, crc long, shard int, slot long")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
