"""The numbered operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from kelpline.llm import bpe, chat, common, components, embedding, language, licenses, minhash, packing, quality, rules, sharding
from kelpline.llm.queries import ORACLE_SQL, QUERIES, tokenizer
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, id string, row int, v double, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 0.5, "y") for i, t in texts], EXTRA)


TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One TWO"), (5, "a b c d e f g " * 4000), (6, "a b c d e f g"), (6, "a b c d e f g"),
    (7, "line\nline\n\n x\nline"), (8, "# * $ | <b> & % word"), (9, "Released under the MIT License. under the mit license, CC BY-NC cc by nc"),
    (10, "don't <|endoftext|> stop <|startoftext|>x"), (11, "É́ ⅔ 日本語 ǅ \x1c\x85\xa0 İ ΣΑΣ 🎉"), (12, "x" * 30_000), (None, "no id here at all"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_has_no_crash_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("source", ["edge", "table"])
def test_bpe_equals_the_library(spark, documents, source):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    docs = frame(spark, TEXTS) if source == "edge" else documents
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in bpe.encode(docs, tokenizer(), decode=True).collect())
    want = []
    for i, t in texts_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer())
    assert sorted(r.text for r in back.collect()) == sorted(x[3] for x in want)


def test_encoder_with_a_small_memory_gives_the_same_ids():
    texts = [f"word{i} shared text é{i % 7}" for i in range(300)]
    small, large = bpe.WordBpe(tokenizer(), memory=20), bpe.WordBpe(tokenizer())
    assert [small.encode(texts[i : i + 10]) for i in range(0, 300, 10)] == [large.encode(texts[i : i + 10]) for i in range(0, 300, 10)]
    assert len(small.chunks) < 100 < len(large.chunks)


def test_a_worker_keeps_the_memory_of_one_operator():
    released = []
    common.turn_of("one", lambda: released.append("one"))
    common.turn_of("one", lambda: released.append("one"))
    assert released == []
    common.turn_of("two", lambda: released.append("two"))
    common.turn_of("two", lambda: released.append("two"))
    assert released == ["one"]
    common.turn_of("one")
    assert released == ["one", "two"]


def test_an_idle_worker_releases_its_memory_and_a_busy_one_keeps_it(monkeypatch):
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.2)
    released = []
    task = common.resting(lambda batches: (x for x in batches))
    common.turn_of("one", lambda: released.append("one"))
    assert list(task(iter([1, 2]))) == [1, 2]
    common.turn_of("one", lambda: released.append("one"))  # the next task begins in time
    time.sleep(0.5)
    assert released == []
    assert list(task(iter([3]))) == [3]
    time.sleep(0.5)
    assert released == ["one"] and not common._held


def components_by_force(sets, percent):
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        common = len(x & y)
        if x and y and 100 * common >= percent * (len(x) + len(y) - common):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i, _ in sets}


def shingles(text, width):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize(("source", "words", "percent"), [("edge", 3, 85), ("table", 3, 85), ("table", 5, 80), ("chain", 3, 85)])
def test_minhash_components_equal_brute_force(spark, documents, source, words, percent):
    if source == "chain":  # near copies that drift apart: each is close to the next, the ends are not
        base = [f"w{i}" for i in range(120)]
        texts = [(i, " ".join(base[: 120 - 2 * i] + [f"n{j}" for j in range(2 * i)])) for i in range(12)]
        docs = frame(spark, texts)
    else:
        docs = frame(spark, TEXTS) if source == "edge" else documents
    sets = [(i, shingles(t, words)) for i, t in texts_of(docs) if i is not None]
    want = components_by_force(sets, percent)
    got = minhash.near_duplicates(docs, words=words, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == Counter((i, len(s)) for i, s in sets)
    if source == "chain":
        assert len(set(want.values())) < 12


BASE = [f"w{i}" for i in range(120)]


def copies_with_noise(rng, count, most):
    """Texts made of the base text by replacing up to ``most`` of its words, so many buckets hold several components."""
    out = []
    for i in range(count):
        words = list(BASE)
        for j in rng.choice(120, rng.integers(0, most), replace=False):
            words[j] = f"n{i}x{j}" if rng.random() < 0.5 else f"m{j}"
        out.append(" ".join(words))
    return out


def test_minhash_of_many_half_similar_texts_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)  # the members of one shingle are dealt into blocks
    texts = copies_with_noise(np.random.default_rng(8), 150, 14)
    sets = [(i, shingles(t, 3)) for i, t in enumerate(texts)]
    want = components_by_force(sets, 85)
    assert 1 < len(set(want.values())) < 150
    names = []
    real = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: names.append(name) or real(df, name))
    got = minhash.near_duplicates(frame(spark, list(enumerate(texts))), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert "rest" in names  # the exact filter had something left


def test_minhash_of_one_id_with_several_texts(spark):
    b = " ".join(BASE)
    docs = frame(spark, [(1, "some other text of its own"), (1, b), (3, b + " end"), (2, None), (None, b)])
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == {(1, 4): (1, True), (1, 118): (1, True), (3, 119): (1, False), (2, 0): (2, True), (None, 118): (None, True)}


def test_one_of_each_keeps_a_row_of_every_group(spark):
    b = " ".join(BASE)
    rows = [(1, "some other text of its own"), (1, b), (1, b), (3, b + " end"), (2, None), (2, None), (None, b + " last"), (None, "alone with no id here"), (4, "one more text that is alone"), (5, "a copy of two words"), (6, "A copy of two words")]
    got = minhash.one_of_each(frame(spark, rows), words=3, percent=85)
    assert got.columns == frame(spark, []).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([rows[0], rows[1], rows[4], rows[5], rows[7], rows[8], rows[9]])
    plain = minhash.one_of_each(frame(spark, rows[3:5] + rows[8:]), words=3, percent=85)
    assert sorted(r.doc_id for r in plain.collect()) == [2, 3, 4, 5]
    assert minhash.one_of_each(frame(spark, [])).count() == 0


def test_marks_hold_every_value(spark, monkeypatch):
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(common, "MOST_BITS", bits)
        marks = common.Marks(spark.range(0, 3000, 3).selectExpr("nullif(id, 9) as x"), "x")
        places = spark.range(3000).selectExpr("nullif(id, 9) as x").select("x", marks.place("x").alias("p")).collect()
        held = marks.may_hold(np.array([r.p for r in places]))
        assert all(h for r, h in zip(places, held, strict=True) if r.x is None or r.x % 3 == 0)
        assert held.sum() < (1080 if bits > 1 << 15 else 1150)


def test_discarded_tables_are_deleted(spark):
    import os

    kept = common.written(spark.range(5), "kept")
    path = common._paths[kept]
    other = kept.where("id > 1")
    common.discard(other)
    assert os.path.isdir(path) and other.count() == 3
    common.discard(common.carries(other, kept))
    assert not os.path.isdir(path)


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    for n in (1, 2, 50, 900):
        assert (minhash.sketch(a[:n], 210) != np.iinfo(np.uint64).max).all()
    same = (minhash.sketch(a[:800], 2100) == minhash.sketch(a[100:], 2100)).mean()
    assert abs(same - 700 / 900) < 0.05


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199), (200, 199)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    hub = components.components(spark.range(1, 100_001).selectExpr("id as a", "if(id % 3 = 0, id - 1, 77) as b"))
    assert hub.count() == 100_000 and hub.where("component <> 1").isEmpty()


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x = np.concatenate([x, x[:200] + 0.08 * rng.normal(size=(200, 16)), np.repeat(x[:1], 150, 0), x[:3] * 7])
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(9001, None, "a"), (9002, [0.0] * 16, "a"), (9003, [float("nan")] * 16, "a"), (9004, [None] * 16, "a"), (9005, [1.0, 2.0], "a"), (9006, [], "a"), (None, x[1].tolist(), "a")]
    got = embedding.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")).collect()
    assert len(got) == len(rows)
    y = embedding.unit(x)
    near = y @ y.T >= 0.9
    found = sum(r.n_links for r in got)
    assert found >= 0.97 * (near.sum() - len(x))
    by_id = {r.vec_id: r for r in got}
    for i in range(len(x)):
        assert by_id[i].n_links <= near[i].sum() - 1
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept for i in range(9001, 9007))
    links = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    parent = list(range(len(x)))
    for i, j in links * 2:  # small ids win; twice over ordered links settles these groups
        least = min(parent[i], parent[j])
        parent[i] = parent[j] = least
    assert all(parent[i] == parent[j] for i, j in links)
    assert np.mean([by_id[i].component_id == parent[i] and by_id[i].kept == (parent[i] == i) for i in range(len(x))]) >= 0.97
    assert np.mean([by_id[i].n_links == near[i].sum() - 1 for i in range(len(x))]) >= 0.97
    assert got[0].audit_recall >= 0.97
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding.near_duplicate_vectors(empty).count() == 0


def test_embedding_compares_vectors_of_every_length(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)) + [9, 0, 0])] + [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, [-2.0, 1.0]), (103, [1.0])]
    got = {r.vec_id: r for r in embedding.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in (100, 101, 102, 103)] == [(1, 100), (1, 100), (0, 102), (0, 103)]
    x = embedding.unit(np.array([v for _, v in rows[:40]]))
    assert [got[i].n_links for i in range(40)] == ((x @ x.T >= 0.9).sum(1) - 1).tolist()


def test_embedding_effort_rises_on_recall_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x = np.concatenate([x, x[:50] + 0.02 * rng.normal(size=(50, 8))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    names = []
    real = embedding.written
    monkeypatch.setattr(embedding, "written", lambda df, name: names.append(name) or real(df, name))
    embedding.similar_links(vectors.selectExpr("id", "v", "1L as copies"), 0.9, target=2.0)
    assert names.count("found") == len(embedding.EFFORTS)  # one cluster, and yet every beam is tried


def test_embedding_audit_measures_rare_links(spark):
    x = np.random.default_rng(3).normal(size=(2500, 24))
    x[2499] = 2 * x[0] + 0.001
    for n, links, recall in ((2500, 2, 1.0), (2499, 0, None)):
        got = embedding.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "vec_id long, embedding array<double>")).collect()
        assert sum(r.n_links for r in got) == links and {r.audit_recall for r in got} == {recall}


def test_embedding_graph_reaches_every_node():
    rng = np.random.default_rng(4)
    hub = rng.normal(size=(1, 8)) + 1e-3 * rng.normal(size=(300, 8))
    x = embedding.unit(np.concatenate([hub, rng.normal(size=(60, 8)), -hub[:90]]))
    lists = embedding.build_graph(x)
    seen, front = set(), [embedding.medoid_of(x)]
    while front:
        seen.update(front)
        front = list({j for i in front for j in lists[i].tolist()} - seen)
    assert len(seen) == len(x)
    ((q, v),) = embedding.range_search(x, [np.zeros(0, np.int64)] * len(x), 0, x[-1:], np.array([len(x) - 1]), 0.9, 32)
    assert (len(x) - 1) in v.tolist()  # without an edge, the own node is still known


@pytest.mark.parametrize("skewed", [True, False])
def test_embedding_counts_without_pairs(spark, monkeypatch, skewed):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1 if skewed else 150, 16)).repeat(400 if skewed else 4, 0)
    x = x + (0.01 if skewed else 0.1) * rng.normal(size=x.shape)
    y = embedding.unit(x)
    near = y @ y.T >= 0.9
    sizes = {}
    real = embedding.written
    monkeypatch.setattr(embedding, "written", lambda df, name: sizes.setdefault(name, real(df, name)))
    vectors = spark.createDataFrame([(i, v.tolist(), 2) for i, v in enumerate(x)], "id long, v array<double>, copies long")
    rows = {"shard_rows": 64, "block_rows": 48, "cluster_rows": 10**6} if skewed else {"cluster_rows": 40}
    degree, links, recall = embedding.similar_links(vectors, 0.9, **rows)
    got = {r.id: (r.hits, r.copies) for r in degree.collect()}
    found = sum(h for h, _ in got.values())
    assert all(h <= near[i].sum() - 1 and c == 2 * h for i, (h, c) in got.items())
    assert found >= 0.97 * (near.sum() - len(x)) and recall >= 0.97
    assert all(near[r.a].any() for r in links.collect())
    if skewed:
        assert sizes["found"].count() < near.sum() / 8  # no list of pairs
        assert {r.component for r in components.components(links).collect()} == {0}


def license_force(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("source", ["edge", "table"])
def test_license_base_equals_brute_force(spark, documents, source):
    more = [(20, "under the mit license under the mit license"), (21, "Apache License, Version 2.0 and GPLv3; see SPDX-License-Identifier: BSD-3-Clause"), (22, "submit licensed"), (23, "cc by nc cc by nc " * 50)]
    docs = frame(spark, TEXTS + more) if source == "edge" else documents
    got = licenses.summary(licenses.scan(docs)).collect()
    assert Counter((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == Counter((i, license_force(t)) for i, t in texts_of(docs))
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    if source == "edge":
        assert {r.doc_id: r.labels for r in got}[21] == "apache-2,bsd-3-clause,gpl-3"


def test_license_suppression_and_rule_count(spark):
    assert len(licenses.signatures()) >= 200
    row = licenses.scan(frame(spark, [(1, "Licensed under the Apache License, Version 2.0")])).collect()[0]
    assert [(d.label, d.first, d.last, d.priority) for d in row.detections] == [("apache-2", 0, 7, 80)]  # eight words


def spelled(tree):
    """All strings that a parsed regex of literals, sets, groups and optional parts matches."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(c) for kind, c in arg if str(kind) == "LITERAL"]
        elif op == "SUBPATTERN":
            more = spelled(arg[3])
        elif op == "BRANCH":
            more = [x for branch in arg[1] for x in spelled(branch)]
        else:
            assert op == "MAX_REPEAT" and arg[:2] == (0, 1), op
            more = ["", *spelled(arg[2])]
        out = [a + b for a in out for b in more]
    return out


def test_license_keywords_lose_nothing(spark):
    rules = [(kws, re.compile(rx), conf) for _, _, kws, rx, _, conf in licenses.signatures()]
    names = {label: spelled(re._parser.parse(name)) for label, (_, name) in licenses.NAMES.items()}
    for label, (keywords, _) in licenses.NAMES.items():
        for name in names[label]:
            assert any(f" {kw} " in f" {name} " for kw in keywords.split("|")), (label, name)
    forms = ["spdx license identifier {}", "released under {}", "distributed under the {}", "under the terms of the {} licence", "{} public license", "{}"]
    texts = [(i, "this is " + form.format(name) + " as is") for i, (form, name) in enumerate((f, n) for some in names.values() for n in some[:: max(1, len(some) // 12)] for f in forms)]
    texts += [(10**6, "Released under Apache 2.0"), (10**6 + 1, "distributed under MIT"), (10**6 + 2, "published under Creative Commons Attribution"), (10**6 + 3, "under the Expat license")]
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(frame(spark, texts))).collect()}
    assert [got[10**6 + i].labels for i in range(4)] == ["apache-2", "mit", "cc-by", "mit"]
    for i, text in texts:
        norm = " " + re.sub(r"[^a-z0-9]+", " ", text.lower()).strip() + " "
        assert got[i].score == max([conf for _, rx, conf in rules if rx.search(norm)], default=0.0), text


def detections_force(text):
    """Every rule on every text, without keywords, then suppression by comparing all with all."""
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())) + " "
    found = []
    for i, label, _, rx, priority, conf in licenses.signatures():
        for m in re.finditer(rx, norm) if priority < 100 else ():
            first = norm[: m.start()].count(" ") - 1
            found.append((i, label, priority, conf, first, first + m[0].count(" ")))

    def beats(e, d):
        inside = e[4] <= d[4] and e[5] >= d[5]
        return inside and (e[2], e[5] - e[4], -e[0]) > (d[2], d[5] - d[4], -d[0])

    return Counter(d for d in found if not any(beats(e, d) for e in found))


BODIES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("Neither the name of the Foo Project nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("do what the fuck you want to public license", "wtfpl"), ("distributed under GFDL license", "gfdl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), ("apache 2.0", "apache-2"), ("the permission of the mitigated gap", ""),
]


@pytest.mark.parametrize("source", ["edge", "table"])
def test_license_detections_equal_rules_without_keywords(spark, documents, source):
    more = [(100 + i, t) for i, (t, _) in enumerate(BODIES)] + [(200, " and ".join(t for t, _ in BODIES) + " under the MIT License " * 40)]
    docs = frame(spark, TEXTS + more) if source == "edge" else documents
    scanned = licenses.scan(docs)
    for (i, t), r in zip(sorted(texts_of(docs), key=lambda x: (x[0] is None, x)), sorted(scanned.collect(), key=lambda r: (r.doc_id is None, r.doc_id)), strict=True):
        assert i == r.doc_id
        assert Counter(tuple(d) for d in r.detections) == detections_force(t), t[:200]
    if source == "edge":
        labels = {r.doc_id: r.labels.split(",") for r in licenses.summary(scanned).collect()}
        for i, (text, label) in enumerate(BODIES):
            assert label in labels[100 + i], (text, labels[100 + i])


def test_license_families_without_a_version(spark):
    cases = [
        ("this is GPL software", "gpl"), ("GNU General Public License", "gpl"), ("GNU Lesser General Public License", "lgpl"), ("the AGPL", "agpl"), ("licensed under apache", "apache"), ("a BSD-style license", "bsd"),
        ("All rights reserved.", "all-rights-reserved"), ("Proprietary and confidential", "proprietary"), ("Redistributions of source code must retain the above copyright notice", "bsd"),
        ("Everyone is permitted to copy and distribute verbatim copies of this license document", "gpl"),
        ("licensed under the Apache License 2.0", "apache-2"), ("GNU LGPL v2.1", "lgpl-2"), ("GNU General Public License version 3", "gpl-3"), ("Mozilla Public License 2.0", "mpl-2"), ("an apache helicopter, a mozilla, a cc and the artistic touch", ""),
    ]
    got = licenses.summary(licenses.scan(frame(spark, list(enumerate(t for t, _ in cases))))).collect()
    assert {cases[r.doc_id]: r.labels for r in got} == {case: case[1] for case in cases}
    names = {label: (keywords, spelled(re._parser.parse(name))) for label, (keywords, name, _) in licenses.FAMILIES.items()}
    assert all(any(f" {kw} " in f" {name} " for kw in keywords.split("|")) for keywords, some in names.values() for name in some)


def test_license_long_text_of_thousands_of_detections(spark):
    text = "Released under Apache License 2.0, mit license, GPL; " * 700 + "x " * 30 + "GPLv3 " * 1000
    row = licenses.scan(frame(spark, [(1, text), (2, "mit license x " * 20_000)])).orderBy("doc_id").collect()
    assert Counter(tuple(d) for d in row[0].detections) == detections_force(text)
    assert [(d.first, d.last) for d in row[1].detections] == [(3 * k, 3 * k + 1) for k in range(20_000)]


def test_license_body_keywords_are_in_every_match():
    for label, keywords, rx in licenses.BODIES:
        rx = rx.replace("(?:[^ ]+ ){1,24}?", "x ").replace("(?! provided)", "")
        for text in spelled(re._parser.parse(rx)):
            assert any(f" {kw} " in f" {text} " for kw in keywords.split("|")), (label, text)
    assert len(licenses.signatures()) > 300


def test_scans_take_empty_tables(spark):
    assert licenses.summary(licenses.scan(frame(spark, []))).count() == 0
    assert rules.ledger(frame(spark, [])).count() == 0
    assert bpe.encode(frame(spark, []), tokenizer(), decode=True).count() == 0


def rules_force(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.mark.parametrize("source", ["edge", "table"])
def test_rules_equal_brute_force(spark, documents, source):
    docs = frame(spark, TEXTS) if source == "edge" else documents
    rows = rules.ledger(docs).withColumn("failed", ~rules.passes("base")).withColumn("kept", rules.passes("v2")).collect()
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed)) for r in rows) == Counter((i, rules_force(t)) for i, t in texts_of(docs))
    assert not any(r.kept and r.failed for r in rows)
    table = {r.without: r for r in rules.ablations(rules.ledger(docs), "v2").collect()}
    assert table[None].kept == sum(r.kept for r in rows)
    for name in rules.RULES:
        left = rules.mask(rules.POLICIES["v2"]) & ~rules.mask((name,))
        assert table[name].kept == sum(not r.failures & left for r in rows)


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
        for i, k in enumerate(path):
            total[i, k] += weight
    got = language.marginals(e, t, np.array([0]), np.array([5]))
    assert np.allclose(got, total / total.sum(1, keepdims=True))


def test_language_held_out_accuracy_and_edges(spark):
    rows = QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    model = language.fit([("the and of", "en"), ("de la que", "es")])
    out = language.predict(frame(spark, TEXTS), model).collect()
    assert len(out) == len(TEXTS)
    assert {r.row.doc_id: r.lang_pred for r in out}[0] == "und"
    assert {r.row.doc_id: r.lang_pred for r in out}[2] == "und"
    none = language.predict(frame(spark, TEXTS), language.fit([])).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_code_switched_text_is_labelled_word_by_word():
    model = language.fit([("the of and that with this from have " * 5, "en"), ("de la que los para con una por " * 5, "es")] * 30)
    words = ["the", "of", "and", "that", "de", "la", "que", "los"]
    p = language.marginals(model.emissions(words), model.transitions.astype(float), np.array([0]), np.array([8]))
    assert [model.labels[k] for k in p.argmax(1)] == ["en"] * 4 + ["es"] * 4


@pytest.mark.parametrize("source", ["edge", "table", "empty"])
def test_sharding_is_balanced_gapless_and_keeps_copies_together(spark, documents, source):
    docs = {"edge": frame(spark, TEXTS), "table": documents, "empty": frame(spark, [])}[source]
    rows = sharding.bounded_ring(docs, shards=24).collect()
    n = docs.count()
    assert len(rows) == n
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts_of(docs))
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_equals_a_walk_of_single_rows(spark):
    """Rows wait at their arcs; in round k those that wait try the shard k points on, arc by arc in ring order."""
    rows = [(i, f"text {i % 90}") for i in range(400)] + [(i, "hot") for i in range(400, 700)] + [(7, "same row")] * 60 + [(None, None)] * 5
    docs = frame(spark, rows)
    got = sharding.bounded_ring(docs, shards=5, vnodes=8).collect()
    key = {r.text: r.key % sharding.SPACE for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) as key").distinct().collect()}
    positions, owner = sharding.ring(5, 8)
    by_key = Counter(key[t] for _, t in rows)
    room = [len(rows) // 5 + (s < len(rows) % 5) for s in range(5)]
    waiting = [(int(np.searchsorted(positions, k)) % 40, k) for k in by_key for _ in range(by_key[k])]
    waiting, want, hop = sorted(waiting), Counter(), 0
    while waiting:
        after = []
        for arc, k in waiting:
            s = int(owner[(arc + hop) % 40])
            if room[s]:
                room[s] -= 1
                want[k, s] += 1
            else:
                after.append((arc, k))
        waiting, hop = after, hop + 1
    crc = {k: zlib.crc32((t or "").encode()) for t, k in key.items()}
    assert Counter((r.text_crc32, r.shard) for r in got) == Counter({(crc[k], s): n for (k, s), n in want.items()})
    for shard in range(5):  # equal texts of a shard that come from one walk stand in adjacent slots
        slots = [r.text_crc32 for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)]
        assert sum(a != b for a, b in itertools.pairwise(slots)) + 1 <= len(set(slots)) + 8
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_ring_overflow_goes_clockwise_and_a_new_shard_moves_little():
    positions, owner = sharding.ring(4, 1)
    counts = np.array([10, 0, 0, 2])
    placed = sharding.overflow(counts, owner, np.array([3, 3, 3, 3]))
    assert sum(n for _, _, n, _ in placed) == 12
    first = [s for arc, _, _, s in placed if arc == 0]
    assert first == [owner[k] for k in range(len(first))]
    keys = np.random.default_rng(0).integers(0, 1 << 62, 20_000) * 2

    def home(shards):
        p, o = sharding.ring(shards, 64)
        at = np.searchsorted(p, keys) % len(p)
        counts = np.bincount(at, minlength=len(p))
        caps = np.full(shards, int(1.1 * len(keys) / shards) + 1)
        out = {}
        rank = np.zeros(len(keys), int)
        for arc in np.unique(at):
            rank[at == arc] = np.arange(counts[arc])
        for arc, start, n, s in sharding.overflow(counts, o, caps):
            out.setdefault(arc, []).append((start, start + n, s))
        return np.array([next(s for lo, hi, s in out[a] if lo <= r < hi) for a, r in zip(at, rank, strict=True)])

    assert (home(24) != home(25)).mean() < 0.25


def test_quality_gradient_held_out_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op8_quality"](spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    net = quality.fit([("clean words here", 1), ("### $$$ ###", 0)] * 8)
    out = quality.predict(frame(spark, TEXTS), net).collect()
    assert len(out) == len(TEXTS)
    assert quality.fit([]).score(["x", None]) == [0.5, 0.5]


def test_training_gets_bounded_chunks_of_whole_texts(spark):
    long = "".join(chr(97 + i % 26) * 200 for i in range(2000))
    cut = quality.training_chunks(long)
    assert cut.shape == (quality.TRAIN_POOL, quality.CHUNK) and (cut == quality.training_chunks(long)).all()
    every = {c.tobytes() for c in quality.chunks_of(long.encode())}
    assert all(c.tobytes() in every for c in cut)
    assert (quality.training_chunks("short") == quality.chunks_of(b"short")).all() and quality.training_chunks(None).shape == (1, quality.CHUNK)
    texts = [(i, ("clean words here " if i % 2 else "### $$$ ") * (1 + i % 7 * 900)) for i in range(40)] + [(40, None), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(42)], "doc_id long, quality int, text string")  # a clashing column
    net = quality.train(frame(spark, texts), labels)
    assert [s > 0.5 for s in net.score(["clean words here " * 9, "### $$$ " * 9])] == [True, False]
    assert quality.train(frame(spark, []), labels).score(["x"]) == [0.5]


def test_network_equals_plain_loops_and_numeric_gradients():
    net = quality.fit([("clean words here " * 60, 1), ("### $$$ ### " * 70, 0)] * 4)
    for text in ("", "short", "words and ### " * 120):
        pooled = []
        for chunk in quality.chunks_of(text.encode()):
            e = [net.embed[b] for b in chunk]
            best = np.full(quality.FILTERS, -np.inf)
            for at in range(0, quality.CHUNK - quality.GROUP, quality.GROUP):
                window = np.concatenate(e[at : at + 2 * quality.GROUP])
                best = np.maximum(best, [sum(float(a) * float(b) for a, b in zip(window, f, strict=True)) for f in net.filters.T])
            pooled.append(np.maximum(best + net.bias, 0))
        x = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)]) @ net.out + net.base
        assert abs(net.score([text])[0] - 1 / (1 + np.exp(-x))) < 1e-4
    rng = np.random.default_rng(1)
    for name in ("embed", "filters", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.train = True
    parts = [quality.chunks_of(t.encode()) for t in ("words and ### " * 120, "other", "clean text of some length " * 30)]
    chunks, sizes, y, weight = np.concatenate(parts), np.array([len(p) for p in parts]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    grads, _ = quality.gradients(net, chunks, sizes, y, weight)
    for name, grad in zip(("embed", "filters", "bias", "out"), grads, strict=False):
        values = getattr(net, name)
        for flat in rng.choice(values.size, 12, replace=False):
            at = np.unravel_index(flat, values.shape)
            if name == "embed" and at[0] == quality.PAD:
                continue
            old, loss = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = old + step
                loss.append(quality.gradients(net, chunks, sizes, y, weight)[1])
            values[at] = old
            assert abs((loss[0] - loss[1]) / 2e-6 - grad[at]) < 1e-4 * (1 + abs(grad[at])), (name, at)


def test_chunks_cover_all_bytes():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(i % 251 for i in range(n))
        chunks = quality.chunks_of(data)
        step = quality.CHUNK - quality.OVERLAP
        assert bytes(x for k, c in enumerate(chunks) for x in c[(quality.OVERLAP if k else 0) :] if x != quality.PAD) == data
        assert len(chunks) == max(1, -(-max(0, n - quality.OVERLAP) // step))


def test_chat_round_trip_and_digests(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<\\|end|>", "<|turn|><|text|><|end|>", "", "a\nb", "[/INST]\\[INST]", "🎉" * 3000]
    for text in nasty:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
    turns = [(c, t, r, x, 0) for c in (1, 2) for t, (r, x) in enumerate(zip(itertools.cycle(["user", "assistant", "<|text|>", None]), [*nasty, None]))] + [(3, 1, "assistant", "b", 0), (3, 1, "assistant", "a", 0), (3, None, "user", "first", 0), (None, 0, "user", "lost", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in (1, 2, 3, None):
        own = sorted((x for x in turns if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x, _ in own)
        loss = "".join(x or "" for _, _, r, x, _ in own if r == "assistant")
        row = got[c]
        assert (row.n_turns, row.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts_become_ordered_placeholders(spark):
    parts = [("image", None, "a.png", 28, 15, None, None), ("text", "see <|image|>", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", "hi ", parts), (1, 1, "assistant", None, None)], f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>")
    row = chat.format_turns(df, parts_col="parts").where("turn = 0").collect()[0]
    assert row.segment == "<|turn|>user<|text|>hi <|image|>see <\\|image|><|audio|><|document|><|end|>"
    assert [(a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 768)]
    assert row.expanded_tokens == 3 + 62 + 767


@pytest.mark.parametrize("source", ["edge", "table", "empty"])
def test_packing_is_whole_gapless_and_tight(spark, documents, source):
    from tokenizers import Tokenizer

    docs = {"edge": frame(spark, TEXTS), "table": documents, "empty": frame(spark, [])}[source]
    rows = packing.pack_documents(docs, tokenizer()).collect()
    library = Tokenizer.from_file(tokenizer())
    want = Counter()
    for i, t in texts_of(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * total / 4096 + 1


def test_packing_search_ends_only_without_a_step():
    rng = np.random.default_rng(6)
    for _ in range(6):
        bins = packing.Bins(rng.integers(900, 2600, 300).tolist(), 4096)
        bins.improve()
        under = sorted((b for b in range(len(bins.items)) if 0 < bins.fill[b] < 4096), key=lambda b: bins.fill[b])
        fewest = sum(map(bool, bins.items)) == -(-sum(bins.lengths) // 4096)
        assert fewest or not any(bins._drain(b, under) for b in under)


def test_packing_deals_the_rest_until_no_bin_is_saved(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, i, 0, int(n)) for i, n in enumerate(rng.integers(1900, 2300, 400))]
    names = []
    real = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: names.append(name) or real(df, name))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, row long, piece int, length long"), group_rows=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(400)) and len(names) > 2
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_local_search_empties_bins():
    lengths = [2000, 2000, 2096, 2096, 1500, 1500, 1096, 900, 3196]
    found = packing.pack_group(lengths, 4096)
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in found)
    assert len(found) == -(-sum(lengths) // 4096)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == ""
