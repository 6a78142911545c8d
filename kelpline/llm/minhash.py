"""Operator 2: near-duplicates by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): t coordinates start empty; in round i every element of the set is placed in
one of the t bins by the i-th hash and offers the value i + fraction; a bin keeps its minimum, and rounds stop when all
bins are full. Rounds t to 2t - 1 place every element in bin i - t, so each coordinate is sure to fill. The share of
equal coordinates estimates the Jaccard similarity with concentration bounds, in O(n + t log t) time.

Candidates: bands of ``rows`` coordinates. Equal sets are one class, found by a digest of the whole set, and enter the
bands once, under a number of their own. Each band bucket is linked as a star around the member that shares most buckets
with others; these links are verified on the full sets and joined to components. A bucket whose other members then stand
in several components is open. Documents of open buckets are compared across components by an exact prefix and position
filter over their rarest shingles, which gives the pairs that can still reach the threshold and verifies them, so no
bucket of near copies gives a quadratic pair list.

Texts are never shuffled: candidates' sets are made where their texts are read, from a bitmap of candidate ids that has
at most ``common.MOST_BITS`` bits; what it lets through beyond them is dropped by a join on the digest.

Edge cases: null and empty texts, or texts of white space only, have the empty set, zero shingles, and are linked with
nothing; fewer words than ``words`` make one shingle of the whole sequence; very long texts take time in proportion;
repeated rows with the same id are one document to the links, also if their texts differ (it then has the links of each of
them), and stay separate rows of the result; a null id is linked
with nothing (component null, kept true); empty tables give empty results; other columns may have any name, only id and
text are read. Ties (equal sets, equal sizes) go to the smallest id. Sets hold 64-bit hashes of the shingles: two
different shingles of one pair of texts coincide with a chance of about 1e-11.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import Marks, discard, resting, slices, turn_of, written
from kelpline.llm.components import components

BANDS, ROWS = 30, 7
#: Rows that hold one shingle and are compared in one task; more are dealt into blocks.
BLOCK = 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MEMORY = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _word_hashes() -> dict[bytes, int]:
    return {}


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words."""
    parts = (text or "").encode().translate(_ASCII_LOWER).split()  # bytes split at x20 and x09-x0D
    if not parts:
        return np.zeros(0, np.uint64)
    known = _word_hashes()
    fresh = {p for p in parts if p not in known}
    if fresh:
        if len(known) > _MEMORY:
            known.clear()
            fresh = set(parts)
        known.update((p, xxhash.xxh3_64_intdigest(p)) for p in fresh)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * _A + h[i : i + n])
    return np.unique(out)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set as t 64-bit values: round in the high bits, fraction in the low ones."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, start = len(elements), 0
    while start < 2 * t:
        stop = min(2 * t, start + max(1, 2 * t // n)) if start < t else min(2 * t, start + max(1, (1 << 16) // n))
        rounds = np.arange(start, stop, dtype=np.uint64)[:, None]
        h = _mix(elements[None, :] * _B + (rounds + np.uint64(1)) * _C)
        bins = np.where(rounds < t, (h >> np.uint64(40)) % np.uint64(t), rounds - np.uint64(t)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((rounds << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))).ravel())
        start = stop
        if (out != np.iinfo(np.uint64).max).all():
            break
    return out


def band_keys(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sketch(elements, bands * rows).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        out = _mix(out * _A + s[:, j])
    return out.view(np.int64)


def _sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("minhash", _word_hashes.cache_clear)
        for batch in slices(batches, "text"):
            n, key, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                key.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(s, bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "key", "bands"])

    return docs.mapInArrow(resting(run), "id long, n long, key binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(c, s) of the classes ``wanted`` (c, id, key): the set of a text of that id whose digest is the key."""
    marks = Marks(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("minhash", _word_hashes.cache_clear)
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(marks.may_hold(batch.column(0).to_numpy())))]), "text"):
                found = [shingle_set(x, words).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([blake2b(s, digest_size=16).digest() for s in found], pa.binary()), pa.array(found, pa.binary())], ["key", "s"])

    found = docs.select(marks.place("id").alias("place"), "text").mapInArrow(resting(run), "key binary, s binary")
    return found.dropDuplicates(["key"]).join(wanted.select("key", "c"), "key").select("c", "s")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sb"):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(resting(run), "a long, b long")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (c, n, comp) in different components that can still reach the threshold; no pair that
    reaches it is left out.

    Elements are ordered by how many of the members hold them, rare ones first. Two sets with a large enough
    intersection share an element among the first n - ceil(n * percent / 100) + 1 of either, and what comes after the
    first shared one bounds the intersection. An element that one member alone holds only moves the places of the
    others. For each element the most frequent component is not compared with itself. Members of one element are dealt
    into blocks of about ``BLOCK``; those outside its main component go to all of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s"):
            elements = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(elements)), list(map(len, elements))))), pa.array(np.concatenate(elements))], ["c", "e"])

    held = sets.join(members.select("c"), "c", "left_semi").mapInArrow(resting(run), "c long, e long")
    # aggregates that are joined with what they count are written: beside an aggregate a join isn't split where it is skewed
    often = written(held.groupBy("e").agg(F.count("*").alias("often")).where("often > 1"), "often")
    kept = held.join(often, "e").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("known"))
    first = members.join(kept, "c").withColumn("alone", F.col("n") - F.size("known"))
    width = F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 - alone as int)")
    first = first.where(width > 0).select("c", "n", "comp", "alone", F.posexplode(F.slice("known", F.lit(1), width)).alias("at", "x"))
    first = written(first.select("c", "n", "comp", (F.col("alone") + F.col("at")).alias("at"), F.col("x.e").alias("e")), "prefixes")
    discard(often)
    by_class = first.groupBy("e", "comp").agg(F.count("*").alias("k"))
    main = by_class.groupBy("e").agg(F.max(F.struct("k", "comp")).alias("x"), F.sum("k").alias("rows"), F.count("*").alias("classes")).where("classes > 1")
    main = main.select("e", F.col("x.comp").alias("main"), F.expr(f"cast((rows + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    main, prefixes = written(main, "main"), first
    first = prefixes.join(main, "e")
    left = first.where("comp <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("e", "block", *[F.col(k).alias(f"{k}1") for k in ("c", "n", "comp", "at")])
    right = first.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    right = right.select("e", "block", *[F.col(k).alias(f"{k}2") for k in ("c", "n", "comp", "at")], (F.col("comp") != F.col("main")).alias("minor"))
    reach = f"{100 + percent} * least(n1 - at1, n2 - at2) >= {percent} * (n1 + n2)"
    found = left.join(right, ["e", "block"]).where("comp1 <> comp2 and (not minor or c1 < c2)").where(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {reach}")
    found = written(found.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct(), "rest")
    discard(prefixes, main)
    return found


def _clustered(docs: DataFrame, words: int, percent: int, bands: int, rows: int, one_id_one_document: bool) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (id, text): their sketches, and (key, id, least, first) per class: its smallest id, the smallest id of its
    component and whether it is the component's first class. Classes that share an id are linked on demand."""
    sketched = written(_sketched(docs, words, bands, rows), "sketched")
    named = sketched.where("key is not null")
    if one_id_one_document:
        named = named.where("id is not null")
    # a class is numbered once, in the written table: one id may stand for several classes; null ids come last
    classes = named.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n", "bands")).alias("x")).select("key", "x.*")
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("c", "n", F.explode("bands").alias("hash"))  # the hash holds the band's number
    # sizes, pivots and mixed buckets are written, so that the joins with the rows of a hot bucket are split
    sizes = written(buckets.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = written(buckets.join(sizes, "hash").select("hash", "c", "n", "size"), "shared")
    discard(sizes)
    wanted = written(classes.select("c", "id", "key").join(shared.select("c").distinct(), "c", "left_semi"), "wanted")
    sets = written(_sets(docs, wanted, words), "sets")
    links = classes.sparkSession.createDataFrame([], "a long, b long")
    if one_id_one_document:
        several = named.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key < other").select("id")
        several = named.join(several, "id").join(classes.select("key", "c"), "key").select("id", "c").distinct()
        links = several.join(several.groupBy("id").agg(F.min("c").alias("b")), "id").where("c <> b").select(F.col("c").alias("a"), "b")
    links = written(links, "links")

    def grown(links: DataFrame, pairs: DataFrame) -> DataFrame:
        more = written(links.union(_verified(pairs, sets, percent)), "links")
        discard(links, pairs)
        return more

    # the member that stands in the most and largest buckets is nearest to the others; all buckets take it, so pairs repeat
    degree = shared.groupBy("c").agg(F.sum("size").alias("degree"))
    pick = F.max(F.struct("degree", (-F.col("c")).alias("order"), "c", "n")).alias("x")
    pivots = written(shared.join(degree, "c").groupBy("hash").agg(pick).select("hash", F.col("x.c").alias("pivot"), F.col("x.n").alias("pivot_n")), "pivots")
    rays = written(shared.join(pivots, "hash").where("c <> pivot"), "rays")
    discard(pivots)
    near = rays.where(f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)")
    links = grown(links, written(near.select(F.least("c", "pivot").alias("a"), F.greatest("c", "pivot").alias("b")).distinct(), "pairs"))
    found = components(links)
    placed = written(rays.select("hash", "c", "n").join(found, F.col("c") == F.col("node"), "left").select("hash", "c", "n", F.coalesce("component", "c").alias("comp")), "placed")
    mixed = written(placed.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hash"), "mixed")
    members = written(placed.join(mixed, "hash").select("c", "n", "comp").distinct(), "members")
    discard(shared, rays, placed, mixed)
    if not members.isEmpty():
        discard(found)
        links = grown(links, _prefix_pairs(members, sets, percent))
        found = components(links)
    discard(members)
    number = F.struct("no_id", "id", "node")
    joined = found.join(classes.select(F.col("c").alias("node"), "no_id", "id"), "node")
    least = joined.groupBy("component").agg(F.min(number).alias("x")).select("component", F.col("x.id").alias("least"), F.col("x.node").alias("leader"))
    by_class = classes.select("key", "c", "id").join(found.join(least, "component"), F.col("c") == F.col("node"), "left")
    by_class = written(by_class.select("key", "id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"), F.coalesce(F.col("leader") == F.col("c"), F.lit(True)).alias("first")), "by_class")
    discard(links, found, sets, wanted, classes)
    return sketched, by_class


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) per row of ``docs``; linked are texts with a Jaccard similarity of at
    least ``percent`` / 100 over ``words``-word shingles. With 30 bands of 7 rows a pair at 0.85 is missed by all bands
    with a chance of about 1e-5, one at 0.8 of about 9e-4."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched, by_class = _clustered(docs, words, percent, bands, rows, True)
    members = sketched.select("id", "n", "key").join(by_class.select("key", "least"), "key", "left")
    out = members.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each group of near-duplicates does: the one with the
    smallest id. Here every row is a document of its own: of repeated rows one stays, rows of one id with different
    texts are compared as any others, and rows with a null id take part, after those with an id. Rows with an empty set
    all stay. Only ids travel to decide; texts are moved for rows that go and ids that stand on several rows."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched, by_class = _clustered(text, words, percent, bands, rows, False)
    stays = F.col("key").isNull() | (F.col("first") & F.col("own").eqNullSafe(F.col("id")))
    fate = sketched.select("id", "key").join(by_class.select("key", "first", F.col("id").alias("own")), "key", "left").select("id", "key", stays.alias("stays"))
    by_id = fate.groupBy("id").agg(F.count("*").alias("rows"), F.min("stays").alias("all_stay"))
    marked = written(by_id.where("rows > 1 or not all_stay").select(F.col("id").alias("marked_id"), (F.col("rows") > 1).alias("several")), "marked")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    same = F.col("id").eqNullSafe(F.col("marked_id"))
    # most rows are known to stay by their id's place in a bitmap; the others alone are shuffled for the exact answer
    marks = Marks(marked, "marked_id")
    may = F.pandas_udf(lambda x: pd.Series(marks.may_hold(x.to_numpy())), "boolean")(marks.place("id"))
    tested = row.withColumn("may", may)
    alone = tested.where("not may").select("row.*").union(tested.where("may").drop("may").join(marked, same, "left_anti").select("row.*"))
    several = marked.where("several")
    if several.isEmpty():
        return alone

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("minhash", _word_hashes.cache_clear)
        for batch in slices(batches, "text"):
            found = [shingle_set(x, words) for x in batch.column(2).to_pylist()]
            keys = pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], ["row", "id", "key"])

    shape = f"row {row.schema['row'].dataType.simpleString()}, id long, key binary"
    again = row.join(several, same, "left_semi").mapInArrow(resting(digest), shape)
    kept = fate.where("stays and key is not null").select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    chosen = again.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi").dropDuplicates(["key"])
    return alone.union(chosen.select("row.*")).union(again.where("key is null").select("row.*"))
