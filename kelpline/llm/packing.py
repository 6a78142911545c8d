"""Operator 10: best-fit packing of token sequences, improved by swap-based local search.

Documents become ids (operator 1) plus an end id; only documents longer than a sequence are cut. Pieces are dealt by a
hash into groups of about ``group_rows`` pieces. In a group, best fit in falling order of length gives a first packing;
then local search exchanges one piece for one, two for one, or moves a piece between underfull bins whenever that raises
the sum of squared fills, so that full bins get fuller and weak ones drain until they are empty. What lies in bins that
stay below ``settled`` is dealt and packed anew, so the groups' ends are packed together as well, until one group holds it
or a round saves no bin.

Only lengths travel between tasks, never texts or ids, and a group's size does not grow with the input.

Edge cases: a null or empty text is one piece of the end id alone; very long texts are cut into full pieces and a
remainder; ties go to the earlier bin and the smaller (doc_id, piece); repeated rows are separate documents and get
separate pieces; a null id is packed like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.bpe import MEMORY, encoder
from kelpline.llm.common import SLICE_BYTES, discard, resting, slices, task_ends, turn_of, written

LENGTH = 4096
GROUP_ROWS = 4000


class Bins:
    """Bins of one group: the lengths in each bin, and the bins by free space."""

    def __init__(self, lengths: list[int], size: int):
        self.size = size
        self.lengths = lengths
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self._best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]))

    def _best_fit(self, order: list[int]) -> None:
        free: list[list[int]] = [[] for _ in range(self.size + 1)]  # bins by their free space, earliest first
        spaces: list[int] = []  # free spaces that have bins, in order
        for item in order:
            need = self.lengths[item]
            at = bisect.bisect_left(spaces, need)
            if at < len(spaces):
                space = spaces[at]
                b = heapq.heappop(free[space])
                if not free[space]:
                    spaces.pop(at)
            else:
                b, space = len(self.items), self.size
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(item)
            self.fill[b] += need
            left = space - need
            if not free[left]:
                bisect.insort(spaces, left)
            heapq.heappush(free[left], b)

    def improve(self) -> None:
        """Local search between underfull bins. Each accepted step raises the sum of squared fills, so it ends, when
        no bin can be drained; the weaker half is tried first. It ends as well when no fewer bins could hold the lengths."""
        least = -(-sum(self.lengths) // self.size)
        while sum(map(bool, self.items)) > least:
            under = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.size), key=lambda b: self.fill[b])
            half = max(1, len(under) // 2)
            if not any([self._drain(b, under) for b in under[:half]]) and not any([self._drain(b, under) for b in under[half:]]):
                break

    def _drain(self, weak: int, under: list[int]) -> bool:
        """Give pieces of a weak bin to fuller ones: a move, else a one-for-one or two-for-one exchange that fills up more."""
        changed = False
        for item in sorted(self.items[weak], key=lambda i: -self.lengths[i]):
            if item not in self.items[weak]:
                continue
            x, best = self.lengths[item], None
            for b in reversed(under):
                if b == weak or self.fill[b] < self.fill[weak] or not self.items[b]:
                    continue
                space = self.size - self.fill[b]
                if x <= space:
                    gain, out = x, ()
                else:
                    gain, out = self._exchange(b, x, space)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, b, out)
                    if gain == space:
                        break
            if best:
                _, b, out = best
                self.items[weak].remove(item)
                self.items[b] = [i for i in self.items[b] if i not in out] + [item]
                self.items[weak].extend(out)
                moved = sum(self.lengths[i] for i in out)
                self.fill[b] += x - moved
                self.fill[weak] += moved - x
                changed = True
        return changed

    def _exchange(self, b: int, x: int, space: int) -> tuple[int, tuple[int, ...]]:
        """The one or two pieces of a bin whose exchange for a piece of length x fills the bin most: (gain, pieces)."""
        items, best = self.items[b], (0, ())
        for k, i in enumerate(items):
            one = self.lengths[i]
            if best[0] < x - one <= space:
                best = (x - one, (i,))
            for j in items[k + 1 :]:
                two = one + self.lengths[j]
                if best[0] < x - two <= space:
                    best = (x - two, (i, j))
        return best


def pack_group(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers, each with a sum of lengths of at most ``size``; empty bins are left out."""
    full = [[i] for i, x in enumerate(lengths) if x >= size]
    rest = [i for i, x in enumerate(lengths) if x < size]
    bins = Bins([lengths[i] for i in rest], size)
    bins.improve()
    return full + [[rest[i] for i in items] for items in bins.items if items]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, length: int, end_id: int, memory: int = MEMORY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): documents as pieces of at most ``length`` tokens; ``row`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(tokenizer_path, memory), np.uint32(end_id).astype("<u4").tobytes()
        for batch in slices(batches, "text", slice_bytes):
            rows = []
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), bpe.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(resting(run), "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def _sequences(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def pack(found: DataFrame, size: int = LENGTH, group_rows: int = GROUP_ROWS, settled: float = 0.998) -> DataFrame:
    """Add (sequence_id, offset) to a table of pieces with (doc_id, row, piece, length)."""
    schema = found.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long, sequence_fill long"

    def group(before: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            turn_of("packing")  # the encoder's words are not needed any more
            base = (before + int(pdf["_group"].iloc[0])) << 24
            pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
            lengths = pdf["length"].to_numpy()
            bins = pack_group(lengths.tolist(), size)
            sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
            for number, items in enumerate(bins):
                ends = np.cumsum(lengths[items])
                sequence[items], offset[items], fill[items] = base + number, ends - lengths[items], ends[-1]
            task_ends()
            return pdf.drop(columns="_group").assign(sequence_id=sequence, offset=offset, sequence_fill=fill)

        return run

    done, rest, ends, before, salt = None, found, None, 0, 0  # ends: the rest as the round before packed it
    while True:
        groups = max(1, -(-rest.count() // group_rows))
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "row"), F.lit(groups)))
        packed = written(dealt.groupBy("_group").applyInPandas(group(before), schema), "packed")
        before, salt = before + groups, salt + 1
        saved = ends is None or _sequences(packed) < _sequences(ends)
        if not saved or groups == 1:
            last = packed if saved else ends
            return (last if done is None else done.union(last)).drop("sequence_fill")
        settle = F.col("sequence_fill") >= int(settled * size)
        full, ends = packed.where(settle), packed.where(~settle)
        done = full if done is None else done.union(full)
        rest = ends.drop("sequence_id", "offset", "sequence_fill")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 1, memory: int = MEMORY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document. ``memory`` bounds the
    words that an encoder remembers and ``slice_bytes`` the text it takes at once; both change time and memory, not results."""
    found = written(pieces(docs, tokenizer_path, id_col, text_col, length, end_id, memory, slice_bytes), "pieces")
    packed = pack(found, length)
    discard(found)  # every round is written
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").withColumnRenamed("doc_id", id_col)
