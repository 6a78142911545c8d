"""Operator 12: how far the sources of a language differ in their terms, counted in mergeable radix tries.

A term is a run of ASCII letters and non-ASCII characters, with A-Z lower-cased. Each task counts the terms of its partition
in byte tries, one for each language, whose leaves hold the documents with the term and a counter of occurrences for each source. Tries
that reach ``most`` counters are written out and begun anew. They are merged by prefix range: their leaves are range
partitioned in UTF-8 order, a task merges a range in segments of ``most`` counters and drops terms in too few documents of
the language. With the totals known, a traversal of each segment in UTF-8 order streams the pairs' sums and each source's
best candidates, whose ties are in the order of the traversal.

All arithmetic is in integers; shares are parts of a thousand million, found by long division, so counts up to 9e15 are
exact. What a task holds is bounded by ``most`` counters and the sources of one language, of whose pairs the result has a row
each; with very many sources the pairs of a segment are dealt to several tasks.

Edge cases: null text, language and source count as empty; a group without a term has rows all the same (its shares are
those of no occurrence); a language without kept terms has pairs of value 0 and no terms; a language with one source has no
pairs; ties go by the item's UTF-8 bytes; repeated rows count each; very long texts and terms are counted whole; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import gc
import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.common import slices, written

SMOOTHING = 5
LEAST_DOCUMENTS = 30
TOP = 50
#: Counters of a task's tries at most, unless one term has more.
MOST = 1_000_000
#: Sources whose pairs one task sums.
SOURCES = 1000
#: Lower-cases A-Z, keeps a-z and the bytes of non-ASCII characters, makes everything else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

class Leaf:
    """What a trie knows of a term: the documents that hold it, and its occurrences by source."""

    __slots__ = ("documents", "occurrences")

    def __init__(self) -> None:
        self.documents = 0
        self.occurrences: dict[str, int] = {}


class Trie:
    """A radix trie over bytes. A node is [edge that leads to it, its leaf, its children by first byte], the last two or None."""

    def __init__(self) -> None:
        self.root: list = [b"", None, None]

    def leaf(self, term: bytes) -> Leaf:
        """The leaf of a term, made if need be; an edge that parts from the term on its way is split."""
        node, at, size = self.root, 0, len(term)
        while at < size:
            children = node[2]
            if children is None:
                children = node[2] = {}
            child = children.get(term[at])
            if child is None:
                children[term[at]] = node = [term[at:], None, None]
                break
            edge = child[0]
            if term.startswith(edge, at):
                at += len(edge)
            else:
                same = 1
                while same < len(edge) and at + same < size and edge[same] == term[at + same]:
                    same += 1
                child[:] = [edge[:same], None, {edge[same]: [edge[same:], child[1], child[2]]}]
                at += same
            node = child
        if node[1] is None:
            node[1] = Leaf()
        return node[1]

    def leaves(self, terms: Iterable[bytes]) -> Iterator[Leaf]:
        """The leaves of terms that come in order: each descent begins where the one before was last on its way."""
        path = [(b"", self.root)]
        for term in terms:
            while not term.startswith(path[-1][0]):
                path.pop()
            before, node = path[-1]
            at, size = len(before), len(term)
            while at < size:
                children = node[2]
                if children is None:
                    children = node[2] = {}
                child = children.get(term[at])
                if child is None:
                    children[term[at]] = node = [term[at:], None, None]
                    path.append((term, node))
                    break
                edge = child[0]
                if term.startswith(edge, at):
                    at += len(edge)
                else:
                    same = 1
                    while same < len(edge) and at + same < size and edge[same] == term[at + same]:
                        same += 1
                    child[:] = [edge[:same], None, {edge[same]: [edge[same:], child[1], child[2]]}]
                    at += same
                node = child
                path.append((term[:at], node))
            if node[1] is None:
                node[1] = Leaf()
            yield node[1]

    def merge(self, other: Trie) -> None:
        for term, leaf in other.walk():
            own = self.leaf(term)
            own.documents += leaf.documents
            for source, n in leaf.occurrences.items():
                own.occurrences[source] = own.occurrences.get(source, 0) + n

    def walk(self) -> Iterator[tuple[bytes, Leaf]]:
        """Terms and leaves in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            before, (edge, leaf, children) = stack.pop()
            term = before + edge
            if leaf is not None:
                yield term, leaf
            if children is not None:
                stack.extend([(term, children[c]) for c in (sorted(children, reverse=True) if len(children) > 1 else children)])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys)))


def counted(rows: Iterable[tuple[str, str, bytes]], tries: dict[str, Trie]) -> int:
    """Count the terms of (lang, source, text) rows in tries by language; gives the number of counters that it set. The leaf of
    the empty term, at a root, lists a language's sources."""
    rows = list(rows)
    if not rows:
        return 0
    langs, sources, texts = zip(*rows, strict=True)
    groups = {g: k for k, g in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
    places = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
    names, of_lang = list(groups), [tries.setdefault(lang, Trie()) for lang in places]
    group = np.fromiter(map(groups.get, zip(langs, sources, strict=True)), np.int64, len(texts))
    lang = np.array([places[lang] for lang, _ in names], np.int64)
    # a space before it: each text has the empty term, and its group a counter of it, which stays 0
    found = pc.split_pattern(pa.array([b" " + t.translate(_TERMS) for t in texts], pa.large_binary()), b" ")
    row = np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
    coded = found.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place_of = np.empty(len(order), np.int64)
    place_of[order.to_numpy()] = np.arange(len(order))
    terms, code = coded.dictionary.take(order).to_pylist(), place_of[coded.indices.to_numpy()]
    del found, coded
    keys, occurrences = _distinct(group[row] * len(terms) + code)
    held, _ = _distinct(row * len(terms) + code)
    in_langs, documents = _distinct(lang[group[held // len(terms)]] * len(terms) + held % len(terms))
    del row, code, held
    occurrences[keys % len(terms) == 0], documents[in_langs % len(terms) == 0] = 0, 0  # the empty term is the first
    by_term = np.argsort(lang[keys // len(terms)] * len(terms) + keys % len(terms), kind="stable")  # groups of a term side by side
    of, numbers = [names[g][1] for g in (keys[by_term] // len(terms)).tolist()], occurrences[by_term].tolist()
    ends = np.cumsum(_distinct(lang[keys // len(terms)] * len(terms) + keys % len(terms))[1]).tolist()
    parts = np.searchsorted(in_langs, np.arange(len(of_lang) + 1) * len(terms))
    leaves = (of_lang[p].leaves(map(terms.__getitem__, (in_langs[parts[p] : parts[p + 1]] - p * len(terms)).tolist())) for p in range(len(of_lang)))
    start = 0
    for leaf, n, stop in zip(itertools.chain.from_iterable(leaves), documents.tolist(), ends, strict=True):
        leaf.documents += n
        own = leaf.occurrences
        for source, k in zip(of[start:stop], numbers[start:stop], strict=True):
            own[source] = own.get(source, 0) + k
        start = stop
    pa.default_memory_pool().release_unused()
    return len(keys)


_COUNTS = "lang string, term string, documents long, sources array<string>, occurrences array<long>"
_KEPT = "lang string, segment long, term string, source string, occurrences long"


def _terms(column: list[bytes]) -> pa.Array:
    return pa.array(column, pa.binary()).cast(pa.string())


def _leaves(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_COUNTS``, in order of (lang, term)."""
    for lang in sorted(tries):
        walk = tries[lang].walk()
        while part := list(itertools.islice(walk, 20_000)):
            ends = pa.array(np.cumsum([0, *(len(leaf.occurrences) for _, leaf in part)]), pa.int32())
            sources = pa.array(list(itertools.chain.from_iterable(leaf.occurrences for _, leaf in part)), pa.string())
            counts = pa.array(list(itertools.chain.from_iterable(leaf.occurrences.values() for _, leaf in part)), pa.int64())
            columns = [pa.array([lang] * len(part), pa.string()), _terms([t for t, _ in part]), pa.array([leaf.documents for _, leaf in part], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, counts)], ["lang", "term", "documents", "sources", "occurrences"])


def without_cycles(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` without the search for cycles: a trie is many lists and no cycle."""

    @functools.wraps(run)
    def task(*args: object) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()
        try:
            yield from run(*args)
        finally:
            if collects:
                gc.enable()

    return task


@without_cycles
def count_terms(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Leaves of the tries of (lang, source, text) batches."""
    held: dict[str, Trie] = {}
    counters = 0
    for batch in slices(batches, "text", 16 << 20):
        counters += counted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True), held)
        if counters >= most:
            yield from _leaves(held)
            held, counters = {}, 0
    yield from _leaves(held)


def _without_rare(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """The batch without the terms that begin and end in it and are in fewer than ``least`` documents."""
    if batch.num_rows < 3:
        return batch
    lang, term = batch.column(0), batch.column(1)
    new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, new))
    stays = (np.add.reduceat(batch.column(2).to_numpy(), starts) >= least) | pc.equal(term.take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
    stays[0] = stays[-1] = True
    return batch.filter(pa.array(np.repeat(stays, np.diff(np.append(starts, batch.num_rows)))))


@without_cycles
def merge_terms(batches: Iterator[pa.RecordBatch], least: int, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Merge leaves that come in order of (lang, term) and keep terms in at least ``least`` documents of their language. The
    empty term stays, it lists the sources. A segment is of one language and ends between terms."""
    from pyspark import TaskContext

    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 33
    trie, lang_of, last, documents, counters = Trie(), None, None, 0, 0
    waiting: list[tuple[list[str], list[int], int, int]] = []  # where the counters of the term at hand stand

    def settle() -> int:
        """Merge the counters of the term at hand, if it is in enough documents; gives how many they are."""
        if last is None or last and documents < least:
            return 0
        own = trie.leaf(last).occurrences
        for sources, counts, start, stop in waiting:
            for source, n in zip(sources[start:stop], counts[start:stop], strict=True):
                own[source] = own.get(source, 0) + n
        return len(own)

    def kept() -> Iterator[pa.RecordBatch]:
        walk = ((term, source, n) for term, leaf in trie.walk() for source, n in leaf.occurrences.items())
        while part := list(itertools.islice(walk, 50_000)):
            terms, sources, counts = zip(*part, strict=True)
            columns = [pa.array([lang_of] * len(part), pa.string()), pa.array([number] * len(part), pa.int64()), _terms(list(terms)), pa.array(sources, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "segment", "term", "source", "occurrences"])

    for batch in batches:
        batch = _without_rare(batch, least)
        lists = batch.column(3)
        ends, sources, counts = lists.offsets.to_pylist(), lists.values.to_pylist(), batch.column(4).values.to_pylist()
        rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), ends, ends[1:], strict=False)
        for lang, term, n, start, stop in rows:
            if lang != lang_of or term != last:
                counters += settle()
                if lang != lang_of or counters >= most:
                    yield from kept()
                    trie, number, counters = Trie(), number + 1, 0
                lang_of, last, documents = lang, term, 0
                waiting.clear()
            documents += n
            waiting.append((sources, counts, start, stop))
    settle()
    yield from kept()


def shares(occurrences: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(1000 ** 3 * occurrences / whole) for occurrences of at most ``whole``, by long division in digits of 1000."""
    out, rest = np.zeros_like(occurrences), occurrences
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


_SCORES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def compare_segment(lang: str, block: int, kept: Iterable[tuple[bytes, str, int]], totals: list[tuple[str, int, int, int]], top: int = TOP) -> list[tuple[str, str, str, str, int]]:
    """(lang, source, part, item, value) of one segment: the sums of pairs over the segment's terms, and each source's best
    terms. ``totals`` has every source of the language with its occurrences of kept terms, its block and the number of kept
    terms of the language."""
    totals = sorted(totals)
    names, place = [t[0] for t in totals], {t[0]: k for k, t in enumerate(totals)}
    terms_of_lang = totals[0][3] if totals else 0
    whole = np.array([t[1] for t in totals], np.int64) + SMOOTHING * terms_of_lang
    all_of_lang = sum(t[1] for t in totals) + SMOOTHING * terms_of_lang
    own = [k for k, t in enumerate(totals) if t[2] == block]
    trie = Trie()
    for term, source, occurrences in kept:
        trie.leaf(term).occurrences[source] = occurrences
    sums = np.zeros((len(own), len(names)), np.int64)
    best: list[list[tuple[int, int, bytes]]] = [[] for _ in own]
    walk, order = trie.walk(), 0
    rows = max(1, 2_000_000 // max(1, len(names)))
    while True:
        leaves = list(itertools.islice(walk, rows))
        if not leaves:
            break
        counts = np.zeros((len(leaves), len(names)), np.int64)
        for r, (_, leaf) in enumerate(leaves):
            for source, n in leaf.occurrences.items():
                counts[r, place[source]] = n
        p, q = shares(counts + SMOOTHING, whole), shares(counts.sum(axis=1) + SMOOTHING, all_of_lang)
        for k, s in enumerate(own):
            sums[k] += np.abs(p - p[:, s : s + 1]).sum(axis=0)
            above = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
            found = [(int(p[r, s] - q[r]), -(order + int(r)), leaves[r][0]) for r in above]
            best[k] = heapq.nlargest(top, best[k] + found)  # an earlier term of the traversal wins a tie
        order += len(leaves)
    pairs = [(lang, names[s], "pair", names[o], int(sums[k, o])) for k, s in enumerate(own) for o in range(len(names)) if o != s]
    return pairs + [(lang, names[s], "term", term.decode(), value) for k, s in enumerate(own) for value, _, term in best[k]]


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most: int = MOST, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by the sum of differences
    of shares over all kept terms, part ``term`` the ``top`` terms whose share lies most above the language's."""
    empty = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counts = written(docs.select(*empty).mapInArrow(lambda b: count_terms(b, most), _COUNTS), "divergence-tries")
    ordered = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    merged = written(ordered.mapInArrow(lambda b: merge_terms(b, least, most), _KEPT), "divergence-kept")
    groups, kept = merged.where("term = ''").select("lang", "source").distinct(), merged.where("term <> ''")
    occurring = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    sizes = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    totals = groups.join(occurring, ["lang", "source"], "left").join(sizes, "lang", "left")
    totals = written(totals.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "divergence-totals")
    blocks = 1 + (totals.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // sources
    dealt = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    # segments follow the partitions; what is kept of neighbours goes together, about an eighth of ``most`` counters
    pieces = kept.groupBy("lang", F.col("segment").alias("piece")).agg(F.count("*").alias("counters"))
    before = F.coalesce(F.sum("counters").over(Window.partitionBy("lang").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = written(pieces.select("piece", F.floor(before / (1 + most // 8)).cast("long").alias("segment")), "divergence-segments")
    kept = kept.withColumnRenamed("segment", "piece").join(pieces, "piece").select("lang", "segment", "term", "source", "occurrences")
    segments = kept.select("lang", "segment").distinct().unionByName(totals.select("lang", F.lit(-1).cast("long").alias("segment")).distinct())
    known = totals.withColumn("own", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")).join(segments, "lang").select("*", dealt)
    known = known.select(F.col("lang").alias("of"), F.col("segment").alias("range"), F.col("block").alias("share"), "source", "n", "own", "v")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = zip(left["term"].cast(pa.binary()).to_pylist(), left["source"].to_pylist(), left["occurrences"].to_pylist(), strict=True)
        totals = list(zip(*(right[c].to_pylist() for c in ("source", "n", "own", "v")), strict=True))
        found = compare_segment(key[0].as_py(), key[2].as_py(), rows, totals, top)
        columns = list(map(list, zip(*found, strict=True))) if found else [[] for _ in _SCORES]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)

    scores = kept.select("*", dealt).groupBy("lang", "segment", "block").cogroup(known.groupBy("of", "range", "share")).applyInArrow(compare, "lang string, source string, part string, item string, value long")
    summed = scores.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
