"""Operator 13: order-preserving packing by dynamic programming.

Documents, in the order of their ids, are one stream of tokens that windows of at most ``size`` tokens cut. A window may end
at a document's end for nothing, at a sentence's end for ``SENTENCE`` tokens, and inside a sentence of over ``LONG`` tokens
at every ``GRID``-th token for ``INSIDE`` tokens. A window costs its padding up to ``size`` as well, but none where its length
is a power of two. The cuts of least cost (then of fewest windows) come from one pass over the possible cuts: the cheapest
window that ends at a cut begins at a minimum over the cuts at most ``size`` tokens before, which a monotone queue keeps,
or a power of two before. A sentence ends after a word's last character if that is . ! or ?, or at a line end behind a word; in a
text with characters for which words can't be encoded one by one, only if encoding its sentences one by one gives the same ids.

Neither texts nor ids move between tasks: the encoder's pass keeps of each document the places where it may be cut and the
checksum up to each, from which the checksum of any piece follows. Tasks get runs of documents by a range partitioning on
the id, about ``run_tokens`` tokens each, and settle them in blocks, handing on what the last windows of a block hold. So
padding is lost once a run, and memory follows the block, not the run or a long document.

Edge cases: a null or empty text is the end id alone; very long texts are cut like others; repeated rows are documents of
their own; rows of one id keep the order in which they are read; a null id comes first and is packed like any other; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.bpe import LONGEST, _plain
from kelpline.llm.common import resting, slices, turn_of, written

SIZE = 2048
#: What a cut costs, in tokens of padding.
SENTENCE, INSIDE = 8, 64
#: Sentences of more tokens than LONG may be cut at every GRID-th token.
LONG, GRID = 256, 64
#: Tokens of one run (a task's share) and of one block of the search.
RUN_TOKENS, BLOCK_TOKENS = 8_000_000, 400_000
#: Words that a worker remembers; when full, those of the slice at hand stay.
MEMORY = 1_500_000
_POLYNOMIAL = 0xEDB88320
#: Stands for a line end behind a word; texts that hold it, other line ends or special tokens are encoded whole.
_LINE = "\x01 "
_OWN = ("\x01", "\x85", "\xa0", "<|")
_ENDS = ".!?\x01"
_SIGNS = ".,;:!?#$%&*\x01"
_MARK = 1 << 31


def sentences(text: str) -> list[str]:
    """Parts of a text that end at a line end, or after . ! or ? before a space."""
    return text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")


def _marked(ids: bytes, word: str) -> bytes:
    """Ids whose last one carries the mark, its highest bit, if the word ends a sentence."""
    return ids[:-1] + bytes([ids[-1] | 0x80]) if ids and word[-1] in _ENDS else ids


class Cutter:
    """Encodes texts with the tokenizers library and gives the places where they may be cut. Ids of words (runs without
    whitespace) are remembered; the last id of a word that ends a sentence carries a mark, so a text's cuts come from its ids."""

    def __init__(self, path: str, end_id: int, memory: int = MEMORY):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        vocab = self.library.get_vocab()
        self.word_ends = np.zeros(max(vocab.values()) + 1, bool)
        self.word_ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def places(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the ends (in tokens) of its parts and the checksum of its ids up to each; the end id is in the last
        part. An end inside a sentence is given as a negative number."""
        lower = [t.lower().replace("\n", _LINE).split() if t and _plain(t) and not any(c in t for c in _OWN) else None for t in texts]
        words: set[str] = set().union(*(x for x in lower if x is not None))
        long = self._learn(words)
        get = self.known.__getitem__
        for text, parts in zip(texts, lower, strict=True):
            yield self._cut(np.frombuffer(b"".join(map(get, parts)), "<u4") if parts is not None else self._odd(text or ""))
        for word in long:
            del self.known[word]

    def _encoded(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words. Those of letters alone are encoded as one text, whose word ends show in the ids."""
        out: dict[str, bytes] = {}
        letters, rest = [], []
        for word in words:
            (letters if word.isalpha() else rest).append(word)
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.word_ends[ids]) + 4).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                out.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
            else:
                rest.extend(part)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return out

    def _learn(self, words: set[str]) -> list[str]:
        """Remember the words; gives those that are too long to keep."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.memory:
            known = self.known = {w: known[w] for w in words if w in known}
        # letters and the signs behind them are words of their own to the library, so what words share is encoded once
        bases = {w: base for w in new if (base := w.rstrip(_SIGNS)) != w and base.isalpha()}
        signs = {w[len(base) :] for w, base in bases.items()}
        ids_of = self._encoded({s.rstrip("\x01") for s in signs})
        behind = {s: _marked(ids_of[s.rstrip("\x01")], s) for s in signs}
        found = self._encoded({w for w in (*bases.values(), *(w.rstrip("\x01") for w in new if w not in bases)) if w not in known})
        for word in new:
            base = bases.get(word)
            if base is None:
                stem = word.rstrip("\x01")
                known[word] = _marked(found[stem] if stem in found else known[stem], word)
            else:
                sign, ids = behind[word[len(base) :]], found.get(base) or known[base]
                known[word] = ids + sign if sign else _marked(ids, word)
        return [w for w in new if len(w) > LONGEST]

    def _odd(self, text: str) -> np.ndarray:
        """Marked ids of a text whose words the library doesn't take one by one."""
        whole = self.library.encode(text, add_special_tokens=False).ids
        parts = [self.library.encode(s, add_special_tokens=False).ids for s in sentences(text)]
        ids = np.array(whole, "<u4")
        if list(itertools.chain.from_iterable(parts)) == whole:
            ends = np.cumsum([len(p) for p in parts if p], dtype=np.int64)
            ids[ends - 1] |= np.uint32(_MARK)
        return ids

    def _cut(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        marks = (ids[: n - 1] >= _MARK).nonzero()[0] if n else ids  # the last id's mark is not needed
        ends = np.empty(len(marks) + 1, np.int64)
        ends[:-1], ends[-1] = marks, n
        ends += 1
        gaps = ends.copy()
        gaps[1:] -= ends[:-1]
        if gaps.max() > LONG:
            inside = [np.arange(e - g + GRID, e, GRID) for e, g in zip(ends.tolist(), gaps.tolist(), strict=True) if g > LONG]
            ends = np.concatenate([ends, *(-x for x in inside)])
            ends = ends[np.argsort(np.abs(ends))]
        data = memoryview((ids & np.uint32(_MARK - 1)).tobytes() + self.end)
        at, crc, sums, crc32 = 0, 0, [], zlib.crc32
        for end in (4 * np.abs(ends)).tolist():
            crc = crc32(data[at:end], crc)
            sums.append(crc)
            at = end
        return ends, np.array(sums, np.uint32)


@functools.lru_cache(maxsize=1)
def _cutter(path: str, end_id: int) -> Cutter:
    return Cutter(path, end_id)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the checksum's, highest bit first as the checksum has them."""
    out, a, b = np.zeros_like(b), a.astype(np.uint32), b.astype(np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return out


def _shifts(most: int) -> np.ndarray:
    """What moves a checksum on by 0, 1, ... ``most`` tokens: powers of x ** 32."""
    one = 1 << 31
    for _ in range(32):
        one = one >> 1 ^ (_POLYNOMIAL if one & 1 else 0)
    out = np.array([1 << 31], np.uint32)
    step = np.array([one], np.uint32)
    while len(out) <= most:
        out = np.concatenate([out, _times(np.full(len(out), step[0], np.uint32), out)])
        step = _times(step, step)
    return out[: most + 1]


def piece_sums(before: np.ndarray, after: np.ndarray, lengths: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Checksums of pieces from those of the text up to their start and up to their end."""
    return (after.astype(np.uint32) ^ _times(shifts[lengths], before.astype(np.uint32))).astype(np.int64)


def cuts(ends: np.ndarray, penalties: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the cuts of least cost among possible ``ends`` (rising, at most ``size`` apart, from 0); the last is one."""
    n = len(ends)
    at = np.concatenate([[0], ends])
    later, before = [], []  # cuts that are a power of two apart
    k = 1
    while k <= size:
        found = np.searchsorted(at, at - k)
        later.append(np.flatnonzero((at >= k) & (at[np.minimum(found, n)] == at - k)))
        before.append(found[later[-1]])
        k *= 2
    order = np.argsort(np.concatenate(later), kind="stable")
    pairs = zip(np.concatenate(later)[order].tolist(), np.concatenate(before)[order].tolist(), strict=True)
    power, other = next(pairs, (0, 0))
    place = at.tolist()
    # in 2 ** -20 tokens, so that a window more decides a tie
    padding, lifted, fee = ((size - at) << 20).tolist(), (at << 20).tolist(), [0, *((penalties.astype(np.int64) << 20) + 1).tolist()]
    cost, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost less what lies before, cut), rising in both
    for j in range(1, n + 1):
        reach = place[j] - size
        while place[queue[0][1]] < reach:
            queue.popleft()
        least, i = queue[0]
        least += padding[j]
        while power == j:
            if cost[other] < least:
                least, i = cost[other], other
            power, other = next(pairs, (0, 0))
        cost[j] = least = least + fee[j]
        back[j] = i
        least += lifted[j]
        while queue and queue[-1][0] >= least:
            queue.pop()
        queue.append((least, j))
    out, j = [], n
    while j:
        out.append(j - 1)
        j = back[j]
    return np.array(out[::-1], np.int64)


class Stream:
    """Windows of a stream of documents, block by block."""

    def __init__(self, size: int, block: int, first: int):
        self.size, self.block, self.sequence = size, block, first
        self.shifts = _shifts(size)
        self.docs: list[tuple[int | None, int, int]] = []  # (id, tokens, place in the stream) of documents not yet settled
        self.ends, self.sums, self.fees = [], [], []  # possible cuts not yet settled
        self.start, self.crc = 0, 0  # where the next window begins, and the checksum of its document up to there
        self.total = 0

    def add(self, doc: int | None, ends: np.ndarray, sums: np.ndarray) -> Iterator[list[np.ndarray | list]]:
        """Take a document; yields the pieces of what could be settled. A long document is taken block by block."""
        fees, ends = np.where(ends < 0, INSIDE, SENTENCE), np.abs(ends)
        fees[-1] = 0
        self.docs.append((doc, int(ends[-1]), self.total))
        held = 0
        while held < len(ends):
            upto = max(held + 1, int(np.searchsorted(ends, self.start + self.block - self.total, "right")))
            self.ends.append(ends[held:upto] + self.total)
            self.sums.append(sums[held:upto])
            self.fees.append(fees[held:upto])
            held = upto
            if held < len(ends) or self.total + int(ends[-1]) - self.start >= self.block:
                yield self.settle(False)
        self.total += int(ends[-1])

    def settle(self, last: bool) -> list[np.ndarray | list]:
        """(ids, starts, lengths, checksums, tokens, sequences, offsets) of the pieces of all windows, or of all but the last
        ones, whose tokens stay for the next block."""
        ends, sums, fees = map(np.concatenate, (self.ends, self.sums, self.fees))
        found = cuts(ends - self.start, fees, self.size)
        if not last and len(found) > 8:
            found = found[:-4]
        upto, stop = found[-1] + 1, int(ends[found[-1]])
        window_ends = ends[found]
        doc_starts = np.array([d[2] for d in self.docs], np.int64)
        points = np.unique(np.concatenate([[self.start], window_ends, doc_starts[(doc_starts > self.start) & (doc_starts < stop)]]))
        begin, length = points[:-1], np.diff(points)
        doc = np.searchsorted(doc_starts, begin, "right") - 1
        window = np.searchsorted(window_ends, begin, "right")
        window_starts = np.concatenate([[self.start], window_ends])
        crc_after = sums[np.searchsorted(ends, points[1:])]
        crc_before = np.concatenate([[self.crc], crc_after[:-1]])
        crc_before[begin == doc_starts[doc]] = 0
        ids, tokens = [self.docs[d][0] for d in doc.tolist()], [self.docs[d][1] for d in doc.tolist()]
        out = [ids, begin - doc_starts[doc], length, piece_sums(crc_before, crc_after, length, self.shifts), tokens, self.sequence + window, begin - window_starts[window]]
        self.sequence += len(found)
        self.start, self.crc = stop, int(crc_after[-1])
        self.ends, self.sums, self.fees = [ends[upto:]], [sums[upto:]], [fees[upto:]]
        keep = int(np.searchsorted(doc_starts, stop, "right")) - 1
        self.docs = self.docs[keep:] if self.docs[keep][1] + self.docs[keep][2] > stop else self.docs[keep + 1 :]
        return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut_places(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, row, tokens, ends, sums): where each document may be cut and its checksum up to each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("windows", _cutter.cache_clear)
        cutter = _cutter(tokenizer_path, end_id)
        for batch in slices(batches, "text"):
            found = list(cutter.places(batch.column(1).to_pylist()))
            sizes = np.cumsum([0, *(len(e) for e, _ in found)]).astype(np.int32)
            ends = np.concatenate([e for e, _ in found]).astype(np.int32)
            sums = np.concatenate([s for _, s in found]).view(np.int32)
            tokens = ends[sizes[1:] - 1].astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (ends, sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens), *lists], ["doc_id", "row", "tokens", "ends", "sums"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(resting(run), "doc_id long, row long, tokens long, ends array<int>, sums array<int>")


def pack_windows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 1, run_tokens: int = RUN_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every document."""
    found = written(cut_places(docs, tokenizer_path, id_col, text_col, end_id), "cut-places")
    runs = max(1, (found.agg(F.sum("tokens")).first()[0] or 0) // run_tokens)

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = Stream(size, block_tokens, TaskContext.get().partitionId() << 33)
        for batch in batches:
            ends, sums = (batch.column(k) for k in (1, 2))
            at = ends.offsets.to_numpy()
            flat, crcs = ends.values.to_numpy().astype(np.int64), sums.values.to_numpy().view(np.uint32)
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for columns in stream.add(doc, flat[a:b], crcs[a:b]):
                    yield batch_of(columns)
        if stream.docs:
            yield batch_of(stream.settle(True))

    ordered = found.repartitionByRange(runs, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ends", "sums")
    packed = ordered.mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)
