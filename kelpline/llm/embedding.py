"""Operator 3: near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors are one class. Centroids are fitted on a bounded sample; every class vector joins its two nearest
   clusters, so shards overlap; a shard above ``shard_rows`` is dealt into several by a hash, and its queries into
   blocks of ``block_rows``, so no task gets an unbounded group.
2. Each shard builds a flat graph: neighbours come from the nearest vectors and some random ones, cut by robust pruning
   (a candidate goes if a kept one is closer to it, by the factor alpha, than the node is). A node that no path from the
   medoid reaches gets an edge from its nearest neighbour that is reached, beyond the cap of degrees.
3. The adjacency lists of all shards are united per vector.
4. Every vector is a query in its nearest shards: a greedy search walks from the shard's medoid and from the query's own
   node, then the range expands over all neighbours of hits until no new hit comes. Cosines are computed in double
   precision on the way, so only verified pairs count. A task hands on the number of each query's hits and a forest that
   joins what they join, not the pairs. A hit counts where its own nearest cluster is, or in its second one if the query
   is not sent to the first, so none counts twice.
5. An audit compares a sample of queries with brute force over all vectors; while its recall is below ``target``, the
   search is repeated with more shards and wider beams. The last beam is as wide as a shard and visits every node of it,
   so with all shards nothing can be missed. The sample grows until ``AUDIT_LINKED`` of its queries have true pairs or it
   holds ``AUDIT_MOST`` queries. Without a true pair there is no recall (null), and the effort ``UNMEASURED`` holds.

Vectors of different lengths have no cosine; each length is searched by itself, so a length more is a search more.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; repeated rows with one id count as separate vectors of one
class; ties go to the smallest id; a null id has a null component and is kept; an empty table gives an empty result;
only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import written
from kelpline.llm.components import components

SAMPLE_ROWS = 8192  # for centroids
AUDIT_ROWS, AUDIT_LINKED, AUDIT_MOST = 200, 50, 12_800
DEGREE, NEAREST, RANDOM, ALPHA = 24, 40, 12, 1.2
#: (nearest shards searched, beam width), the first that passes the audit holds
EFFORTS = ((4, 32), (8, 64), (24, 128), (1 << 30, 256), (1 << 30, 1 << 30))
UNMEASURED = EFFORTS[2]  # the last one whose cost is in proportion to the vectors


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _sampled(vectors: DataFrame, total: int, rows: int, salt: int) -> DataFrame:
    """About ``rows`` of ``total`` vectors, by a hash of the id."""
    return vectors.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 40)) < int(min(1, rows / max(total, 1)) * (1 << 40)))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        c = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], c)
    return c


def medoid_of(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def _reached(lists: list[np.ndarray], start: int, seen: np.ndarray) -> None:
    """Mark in ``seen`` every node that a path from ``start`` reaches."""
    seen[start] = True
    front = np.array([start])
    while len(front):
        near = np.unique(np.concatenate([lists[i] for i in front.tolist()]))
        front = near[~seen[near]]
        seen[front] = True


def build_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Robust-pruned out-neighbours of each unit vector, with some of the edges' reverses."""
    m = len(x)
    rng = np.random.default_rng(seed)
    near = min(NEAREST, m - 1)
    out: list[np.ndarray] = []
    if m < 2:
        return [np.zeros(0, np.int64)] * m
    for lo in range(0, m, 512):
        rows = np.arange(lo, min(m, lo + 512))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -9
        cand = np.concatenate([np.argpartition(-s, near - 1, axis=1)[:, :near], rng.integers(0, m, (len(rows), RANDOM))], axis=1)
        sims = np.take_along_axis(s, cand, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        alive = (sims > -2) & np.concatenate([np.ones((len(rows), 1), bool), cand[:, 1:] != cand[:, :-1]], axis=1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ncd,nkd->nck", x[cand], x[cand])))
        kept = np.zeros_like(alive)
        at = np.arange(len(rows))
        for _ in range(DEGREE):
            first = alive.argmax(1)
            some = alive[at, first]
            if not some.any():
                break
            kept[at[some], first[some]] = True
            alive[at, first] = False
            alive &= ~(some[:, None] & (ALPHA * among[at, first] <= dist))
        out += [cand[i][kept[i]] for i in range(len(rows))]
    back: list[list[int]] = [[] for _ in range(m)]
    for i, js in enumerate(out):
        for j in js.tolist():
            if len(back[j]) < DEGREE:
                back[j].append(i)
    lists = [np.unique(np.concatenate([a, np.array(b, np.int64)])) for a, b in zip(out, back, strict=True)]
    seen, sizes = np.zeros(m, bool), np.array([len(js) for js in lists])
    _reached(lists, medoid_of(x), seen)
    while not seen.all():  # every round joins at least one node
        node, known = int(seen.argmin()), np.flatnonzero(seen & (sizes < 4 * DEGREE))
        at = int(known[(x[known] @ x[node]).argmax()])
        lists[at] = np.append(lists[at], node)
        sizes[at] += 1
        _reached(lists, node, seen)
    return lists


def range_search(x: np.ndarray, lists: list[np.ndarray], medoid: int, q: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, node numbers), some 256 queries at a time, of all hits that a greedy search with range expansion finds; ``own`` is a query's own
    node or -1."""
    n, width = len(x), max([1, *map(len, lists)])
    adj = np.full((n, width), -1, np.int64)
    for i, js in enumerate(lists):
        adj[i, : len(js)] = js
    for lo in range(0, len(q), 256):
        part, mine = q[lo : lo + 256], own[lo : lo + 256]
        if beam >= n:  # such a beam drops nothing and every node is reachable, so all are visited
            hit_q, hit_v = np.nonzero(part @ x.T >= threshold)
            yield hit_q + lo, hit_v
            continue
        size, at = len(part), np.arange(len(part))
        seen = np.zeros((size, n), bool)
        seen[:, medoid] = True
        pool = np.full((size, beam), -1, np.int64)
        pool[:, 0] = medoid
        sims = np.full((size, beam), -9.0)
        sims[:, 0] = part @ x[medoid]
        todo = sims > -5
        hit_q, hit_v = [at[sims[:, 0] >= threshold]], [np.full((sims[:, 0] >= threshold).sum(), medoid)]
        who = at[(mine >= 0) & (mine != medoid)]
        what = mine[who]
        seen[who, what] = True
        pool[who, 1], sims[who, 1], todo[who, 1] = what, np.einsum("nd,nd->n", part[who], x[what]), True
        hit_q.append(who)
        hit_v.append(what)
        while todo.any():
            best = np.where(todo, sims, -9).argmax(1)
            live = todo[at, best]
            todo[at, best] = False
            nodes = np.where(live[:, None], adj[pool[at, best]], -1)
            fresh = (nodes >= 0) & ~seen[at[:, None], nodes]
            who, what = np.nonzero(fresh)[0], nodes[fresh]
            seen[who, what] = True
            new = np.full(nodes.shape, -9.0)
            new[fresh] = np.einsum("nd,nd->n", part[who], x[what])
            near = new[fresh] >= threshold
            hit_q.append(who[near])
            hit_v.append(what[near])
            all_s, all_p, all_t = np.concatenate([sims, new], 1), np.concatenate([pool, nodes], 1), np.concatenate([todo, fresh], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims, pool, todo = (np.take_along_axis(z, top, 1) for z in (all_s, all_p, all_t))
        found_q, found_v = [], []
        front_q, front_v = np.concatenate(hit_q), np.concatenate(hit_v)
        while len(front_q):  # the range expands over every neighbour of a hit
            found_q.append(front_q + lo)
            found_v.append(front_v)
            next_q, next_v = [], []
            for k in range(0, len(front_q), 20_000):
                who, what = np.repeat(front_q[k : k + 20_000], width), adj[front_v[k : k + 20_000]].ravel()
                ok = what >= 0
                who, what = who[ok], what[ok]
                ok = ~seen[who, what]
                flat = np.unique(who[ok] * n + what[ok])
                who, what = flat // n, flat % n
                seen[who, what] = True
                near = np.einsum("nd,nd->n", part[who], x[what]) >= threshold
                next_q.append(who[near])
                next_v.append(what[near])
            front_q, front_v = np.concatenate(next_q), np.concatenate(next_v)
        if found_q:
            yield np.concatenate(found_q), np.concatenate(found_v)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest node of each node's set) after the links a-b."""
    while (label[a] != label[b]).any():
        root_a, root_b = label[a], label[b]
        least = np.minimum(root_a, root_b)
        np.minimum.at(label, root_a, least)
        np.minimum.at(label, root_b, least)
        while (label[label] != label).any():
            label = label[label]
    return label


def similar_links(vectors: DataFrame, threshold: float, shard_rows: int = 4096, block_rows: int = 8192, cluster_rows: int = 1000, target: float = 0.97) -> tuple[DataFrame, DataFrame, float | None]:
    """Of ``vectors`` (id, v, copies; distinct finite non-zero vectors): (id, hits, copies) of those with others at
    cosine >= threshold, hits counting vectors and copies their copies; links (a, b) whose components are those of the
    pairs; the audited recall, the least of all lengths (None without a true pair)."""
    lengths = [(r.d, r.n) for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    found = [_links_of_one_length(vectors.where(F.size("v") == d), n, d, threshold, shard_rows, block_rows, cluster_rows, target) for d, n in lengths if n > 1]
    spark = vectors.sparkSession
    degree, links = spark.createDataFrame([], "id long, hits long, copies long"), spark.createDataFrame([], "a long, b long")
    for more_degree, more_links, _ in found:
        degree, links = degree.union(more_degree), links.union(more_links)
    return degree, links, min((x for _, _, x in found if x is not None), default=None)


def _links_of_one_length(vectors: DataFrame, total: int, d: int, threshold: float, shard_rows: int, block_rows: int, cluster_rows: int, target: float) -> tuple[DataFrame, DataFrame, float | None]:
    spark = vectors.sparkSession
    sample = [r.v for r in _sampled(vectors, total, SAMPLE_ROWS, 1).select("v").collect()]
    if not sample:
        sample = [r.v for r in vectors.select("v").limit(SAMPLE_ROWS).collect()]
    vectors = vectors.select("id", "v", "copies")
    kind = vectors.schema["v"].dataType.simpleString()
    k = max(1, min(4096, -(-total // cluster_rows)))
    centroids = fit_centroids(unit(np.array(sample).reshape(-1, d)), k)
    columns = f"cluster int, id long, v {kind}, copies long, clusters array<int>"

    def orders(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Slices of the batches and each row's nearest clusters."""
        most = min(shards, len(centroids))
        step = max(1, min(1000, 24_000 // most))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                yield part, np.argsort(-(_matrix(part.column(1)) @ centroids.T), axis=1, kind="stable")[:, :most].astype(np.int32)

    def nearest(shards: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, order in orders(batches, shards):
                most = order.shape[1]
                rows = pa.array(np.repeat(np.arange(part.num_rows), most))
                named = order[:, : 1 if most == len(centroids) else most]  # who is sent to all clusters needs no names
                ends = np.arange(0, named.size + 1, named.shape[1], dtype=np.int32)
                clusters = pa.ListArray.from_arrays(pa.array(ends), pa.array(named.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), *[c.take(rows) for c in (*part.columns, clusters)]], ["cluster", "id", "v", "copies", "clusters"])

        return run

    def counted(shards: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(centroids), np.int64)
            for _, order in orders(batches, shards):
                n += np.bincount(order.ravel(), minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["cluster", "n"])

        return run

    def dealt(shards: int, most: int) -> Column:
        """Into how many pieces of at most about ``most`` rows the rows sent to a cluster are dealt."""
        sizes = vectors.mapInArrow(counted(shards), "cluster int, n long").groupBy("cluster").agg(F.sum("n").alias("n")).collect()  # a row per cluster
        return F.create_map(*[F.lit(x) for r in sizes for x in (r.cluster, -(-r.n // most))])[F.col("cluster")]

    parts = dealt(2, shard_rows)
    member = vectors.mapInArrow(nearest(2), columns)
    member = written(member.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")), "members")

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")  # as the search has them, so both know one medoid
        ids = pdf["id"].to_numpy()
        lists = build_graph(unit(np.stack(pdf["v"])), int(key[0]))
        return pd.DataFrame({"id": ids, "near": [ids[x] for x in lists]})

    graph = member.select("cluster", "part", "id", "v").groupBy("cluster", "part").applyInPandas(build, "id long, near array<long>")
    graph = written(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    nodes = written(member.join(graph, "id").select("cluster", "part", "id", "v", "copies", "clusters", "near", F.lit(False).alias("asks")), "nodes")

    def search(shards: int, beam: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            cluster, asks = int(pdf["cluster"].iloc[0]), pdf["asks"].to_numpy(bool)
            x_ids, q_ids = pdf["id"].to_numpy()[~asks], pdf["id"].to_numpy()[asks]
            if not len(x_ids) or not len(q_ids):
                return pd.DataFrame({"id": [], "near": [], "hits": [], "copies": []}).astype("int64")
            vs = unit(np.stack(pdf["v"]))
            order = np.argsort(x_ids)
            x_ids, x = x_ids[order], vs[~asks][order]
            copies = pdf["copies"].to_numpy()[~asks][order]
            first = np.array([c[0] for c in pdf["clusters"][~asks]], np.int64)[order]
            sent = [np.asarray(c, np.int64) for c in pdf["clusters"][asks]]
            sent = np.repeat(np.arange(len(sent)), [len(c) for c in sent]) * len(centroids) + np.concatenate(sent)
            lists = []
            for near in pdf["near"][~asks].to_numpy()[order]:
                near = np.asarray(near, np.int64)
                at = np.minimum(np.searchsorted(x_ids, near), len(x_ids) - 1)
                lists.append(at[x_ids[at] == near])  # neighbours that other shards alone hold are searched there
            own = np.minimum(np.searchsorted(x_ids, q_ids), len(x_ids) - 1)
            own = np.where(x_ids[own] == q_ids, own, -1)
            ids = np.union1d(x_ids, q_ids)
            x_at, q_at, label = np.searchsorted(ids, x_ids), np.searchsorted(ids, q_ids), np.arange(len(ids))
            hits, linked = np.zeros(len(q_ids), np.int64), np.zeros(len(q_ids), np.int64)
            for q, v in range_search(x, lists, medoid_of(x), vs[asks], own, threshold, beam):
                other = q_ids[q] != x_ids[v]
                q, v = q[other], v[other]
                label = joined(label, q_at[q], x_at[v])
                here = first[v] == cluster
                if shards < len(centroids):
                    here[~here] = ~np.isin(q[~here] * len(centroids) + first[v[~here]], sent)
                q, v = q[here], v[here]
                hits += np.bincount(q, minlength=len(hits))
                np.add.at(linked, q, copies[v])
            some, moved = hits > 0, label != np.arange(len(ids))
            zero = np.zeros(moved.sum(), np.int64)
            return pd.DataFrame({"id": np.append(q_ids[some], ids[moved]), "near": np.append(q_ids[some], ids[label[moved]]), "hits": np.append(hits[some], zero), "copies": np.append(linked[some], zero)})

        return run

    def audited(rows: int) -> tuple[DataFrame, int, int]:
        """(id, n true pairs) of about ``rows`` queries that have some, the sum and the number of these."""
        audit = [(r.id, r.v) for r in _sampled(vectors, total, rows, 2).collect()]
        if not audit:
            return spark.createDataFrame([], "id long, n long"), 0, 0
        audit_ids, audit_x = np.array([i for i, _ in audit], np.int64), unit(np.array([v for _, v in audit], np.float64))

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(audit_ids), np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    q, v = np.nonzero(audit_x @ _matrix(part.column(1)).T >= threshold)
                    n += np.bincount(q[audit_ids[q] != part.column(0).to_numpy()[v]], minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(audit_ids[n > 0]), pa.array(n[n > 0])], ["id", "n"])

        truth = written(vectors.mapInArrow(brute, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "audit")
        row = truth.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("known"), F.count("*").alias("linked")).first()
        return truth, row.known, row.linked

    rows = AUDIT_ROWS
    truth, known, linked = audited(rows)
    while linked < AUDIT_LINKED and rows < min(total, AUDIT_MOST):
        rows *= 4
        truth, known, linked = audited(rows)
    for shards, beam in EFFORTS:
        blocks = dealt(shards, block_rows)
        held = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
        asks = vectors.mapInArrow(nearest(shards), columns)
        asks = asks.select("*", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"), F.pmod(F.xxhash64(F.lit(3), "id"), blocks).cast("int").alias("block"))
        asks = asks.select(*[c for c in held.columns if c in asks.columns], F.lit(None).cast("array<long>").alias("near"), F.lit(True).alias("asks"))
        found = held.unionByName(asks).groupBy("cluster", "part", "block").applyInPandas(search(shards, beam), "id long, near long, hits long, copies long")
        found = written(found.groupBy("id", "near").agg(F.sum("hits").alias("hits"), F.sum("copies").alias("copies")), "found")
        degree = found.where("id = near").select("id", "hits", "copies")
        hit = truth.join(degree, "id").agg(F.coalesce(F.sum(F.least("n", "hits")), F.lit(0)).alias("n")).first().n
        recall = hit / known if known else None
        if recall >= target if known else (shards, beam) == UNMEASURED or rows >= total:
            break
    return degree, found.where("id <> near").select(F.col("id").alias("a"), F.col("near").alias("b")), recall


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept, audit_recall) per row of ``table``."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = rows.where("id is not null").where(F.coalesce(good & F.exists("v", lambda x: x != 0), F.lit(False)))
    classes = written(usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    degree, links, recall = similar_links(classes.select("id", "v", "copies"), threshold)
    degree = degree.select(F.col("id").alias("a"), F.col("copies").alias("linked"))
    found = components(links)
    known = classes.join(degree, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col("node"), "left")
    known = written(known.select("v", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "known")
    out = rows.join(known, "v", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(recall).cast("double"))
    return out.withColumnRenamed("id", id_col)
