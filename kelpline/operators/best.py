"""The best rows of every query, found block by block: tasks score a block of rows for many queries at once with numpy, keep
each query's best, and give only these to the shuffle.

Queries are sent to the tasks in groups of bounded size; rows are read as they are and never copied for each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows that are scored at once.
QUERIES, ROWS = 256, 4096


def parts_of(rows: DataFrame, count: int, least: int) -> int:
    """Into how many parts ``count`` rows are dealt: of ``least`` rows at least, and some for each core, so what the tasks give
    grows with the queries alone."""
    return max(1, min(count // least, 4 * rows.sparkSession.sparkContext.defaultParallelism))


def groups_of(queries: DataFrame, query: str, groups: int) -> Iterator[DataFrame]:
    """All rows of a query are in one of the groups."""
    for g in range(groups):
        yield queries.where(F.pmod(F.xxhash64(query), F.lit(groups)) == g) if groups > 1 else queries


def ranks(keys: pa.Array) -> np.ndarray:
    """Places of keys of any type in ascending order, null first; equal keys have one place."""
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


class Best:
    """The ``limit`` highest scores of each of ``n`` queries, ties by the smaller key."""

    def __init__(self, n: int, limit: int, kind: pa.DataType):
        self.limit = limit
        self.least = np.full(n, -np.inf)
        self.query, self.score, self.key = np.empty(0, np.int64), np.empty(0), pa.array([], kind)

    def offer(self, scores: np.ndarray, keys: pa.Array) -> None:
        """A block of scores (query, row); those of -inf don't count."""
        self._take(scores, (scores >= self.least[:, None]) & (scores > -np.inf), keys, None)

    def offer_sums(self, sums: np.ndarray, keys: pa.Array, digits: int) -> None:
        """A block of sums, of which those of 0 don't count; only those that may be kept are rounded."""
        self._take(sums, (sums >= (self.least - 0.1**digits)[:, None]) & (sums > 0), keys, digits)

    def _take(self, scores: np.ndarray, passes: np.ndarray, keys: pa.Array, digits: int | None) -> None:
        n, rows = scores.shape
        if rows > self.limit and np.count_nonzero(passes) > 4 * n * self.limit:
            passes &= scores >= np.partition(scores, -self.limit, axis=1)[:, -self.limit][:, None] - (0 if digits is None else 0.1**digits)
        query, row = np.nonzero(passes)
        if not len(query):
            return
        score = np.concatenate([self.score, scores[query, row] if digits is None else np.round(scores[query, row], digits)])
        key = pa.concat_arrays([self.key, keys.take(pa.array(row))])
        query = np.concatenate([self.query, query])
        order = np.lexsort((ranks(key), -score, query))
        query, score = query[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.limit
        self.query, self.score, self.key = query[kept], score[kept], key.take(pa.array(order[kept]))
        counts = np.bincount(self.query, minlength=n)
        full = counts >= self.limit
        self.least[full] = self.score[np.cumsum(counts)[full] - 1]


def ranked(rows: DataFrame, task: Callable, key: str, limit: int, query_kind) -> DataFrame:
    """(query, key, score, rank) of what the tasks of ``task`` keep."""
    kept = rows.mapInArrow(task, f"query {query_kind.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}, score double")
    place: Column = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key)).cast("long")
    return kept.withColumn("rank", place).where(F.col("rank") <= limit)


def batch_of(best: Best, queries: pa.Array, key: str) -> pa.RecordBatch:
    score = np.where(np.isposinf(best.score), np.nan, best.score)
    return pa.RecordBatch.from_arrays([queries.take(pa.array(best.query)), best.key, pa.array(score)], ["query", key, "score"])


def nearest(queries: pa.Array, vectors: pa.Array, key: str, limit: int) -> tuple:
    """What ``nearest_task`` needs of queries, by the length of their vectors."""
    sizes = pc.list_value_length(vectors).to_numpy()
    return {int(size): (queries.filter(pa.array(sizes == size)), matrix(vectors.filter(pa.array(sizes == size)), size)) for size in np.unique(sizes)}, key, limit


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Unit vectors; a vector of zeros becomes one of nulls in the sense of numbers."""
    rows = vectors.flatten().to_numpy().reshape(-1, size)
    with np.errstate(all="ignore"):
        return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def nearest_task(sent) -> Callable:
    """Cosines, rounded to nine places, of all rows (key, v) with the queries of vectors as long, itself left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, key, limit = sent.value
        held: dict[tuple[int, int], Best] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sizes = pc.list_value_length(batch.column(1)).to_numpy()
                for size in np.unique(sizes):
                    if size not in by_size:
                        continue
                    queries, asked = by_size[size]
                    mine = pa.array(sizes == size)
                    keys, rows = batch.column(0).filter(mine), matrix(batch.column(1).filter(mine), size)
                    codes = ranks(pa.concat_arrays([keys, queries]))
                    for first in range(0, len(asked), QUERIES):
                        with np.errstate(all="ignore"):
                            scores = np.round(asked[first : first + QUERIES] @ rows.T, 9)
                        scores[np.isnan(scores)] = np.inf  # no number is the largest, as in Spark
                        scores[codes[len(keys) + first : len(keys) + first + len(scores), None] == codes[: len(keys)]] = -np.inf
                        held.setdefault((size, first), Best(len(scores), limit, keys.type)).offer(scores, keys)
        for (size, first), best in held.items():
            yield batch_of(best, by_size[size][0].slice(first, QUERIES), key)

    return task


def by_term(query: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by term: the terms, where each begins (and all end), the other side's numbers."""
    order = np.argsort(code, kind="stable")
    terms, starts = np.unique(code[order], return_index=True)
    return terms, np.append(starts, len(code)), query[order]


def asked(queries: pa.DictionaryArray, words: pa.DictionaryArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms and who asks for them, by blocks of queries, of rows (query, word)."""
    numbers, codes = queries.indices.to_numpy(), words.indices.to_numpy()
    order = np.argsort(numbers, kind="stable")
    ends = np.searchsorted(numbers[order], np.arange(0, len(queries.dictionary) + QUERIES, QUERIES))
    return [by_term(numbers[own] - n * QUERIES, codes[own]) for n, own in enumerate(order[a:b] for a, b in zip(ends, ends[1:], strict=False))]


class Lexical:
    """Sums of weights, rounded to six places, of blocks of texts for queries of terms."""

    def __init__(self, queries: pa.Array, asked: list, limit: int):
        self.queries, self.asked, self.limit = queries, asked, limit
        self.held: list[Best] = []

    def score(self, keys: pa.Array, text: np.ndarray, code: np.ndarray, weight: np.ndarray) -> None:
        """Offer the texts of ``keys``, whose terms are (number of the text, code of a term, weight)."""
        order = np.argsort(code, kind="stable")
        terms, starts = np.unique(code[order], return_index=True)
        starts, texts, weights = np.append(starts, len(code)), text[order], weight[order]
        rows: dict[int, np.ndarray] = {}  # weights of all texts, of terms that many texts hold
        for i in np.flatnonzero(np.diff(starts) * SPARSE > len(keys)).tolist():
            rows[i] = np.zeros(len(keys))
            rows[i][texts[starts[i] : starts[i + 1]]] = weights[starts[i] : starts[i + 1]]
        for first, (wanted, begins, numbers) in enumerate(self.asked):
            n = min(QUERIES, len(self.queries) - first * QUERIES)
            sums = np.zeros((n, len(keys)))
            _, here, there = np.intersect1d(terms, wanted, True, return_indices=True)
            for i, j in zip(here.tolist(), there.tolist(), strict=True):
                asking = numbers[begins[j] : begins[j + 1]]
                if i in rows:
                    for q in asking.tolist():
                        sums[q] += rows[i]
                else:
                    part = slice(starts[i], starts[i + 1])
                    sums[asking[:, None], texts[part]] += weights[part]
            if first == len(self.held):
                self.held.append(Best(n, self.limit, keys.type))
            self.held[first].offer_sums(sums, keys, 6)

    def found(self, key: str) -> Iterator[pa.RecordBatch]:
        for first, best in enumerate(self.held):
            yield batch_of(best, self.queries.slice(first * QUERIES, QUERIES), key)


def lexical_task(sent) -> Callable:
    """``Lexical`` of texts (key, code of a term, weight; sorted by key)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked, key, limit = sent.value
        search = Lexical(queries, asked, limit)

        def score(block: pa.Table) -> None:
            block = block.combine_chunks()
            keys = block.column(0).combine_chunks()
            codes = ranks(keys)
            new = np.append(True, codes[1:] != codes[:-1])
            search.score(keys.filter(pa.array(new)), np.cumsum(new) - 1, block.column(1).to_numpy(), block.column(2).to_numpy())

        waiting: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= POSTINGS:
                table = pa.Table.from_batches(waiting)
                codes = ranks(table.column(0).combine_chunks())
                cut = int(np.searchsorted(codes, codes[-1]))  # the last text may go on
                if cut:
                    score(table.slice(0, cut))
                waiting = table.slice(cut).combine_chunks().to_batches()
                count = len(table) - cut
        if count:
            score(pa.Table.from_batches(waiting))
        yield from search.found(key)

    return task


#: Rows of texts and terms that are scored at once; a text's own are never parted.
POSTINGS = 1 << 19
#: A term that more than one text in so many holds is added as a row of weights of all texts.
SPARSE = 16
