"""What queries must also do on tables larger than the test data: large keys, ties, spread work."""

import re

import duckdb
import numpy as np
import pytest

from kelpline.operators import index, listing, retrieval, texts
from kelpline.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def late_orders(tmp_path_factory):
    """The smallest tables with the order keys of a table of 60 million orders."""
    where = tmp_path_factory.mktemp("late_orders")
    for name in TABLES:
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(name)
        duckdb.sql(f"copy (select * {f'replace ({key} + 60000000 as {key})' if key else ''} from '{SF}/{name}.parquet') to '{where}/{name}.parquet'")
    return str(where)


@pytest.mark.parametrize("name", ["thinking_steps", "continued_references", "continued_messages"])
def test_places_of_events_hold_large_order_keys(spark, late_orders, name):
    sql = ORACLE_SQL[name]
    places = "(((l_orderkey * 10 "
    assert places in sql
    with pytest.raises(duckdb.Error):  # a long overflows in SQL, too, so the test widens it there
        compare(QUERIES[name](spark, SF), sql, late_orders)
    assert compare(QUERIES[name](spark, late_orders), sql.replace(places, "(((l_orderkey::hugeint * 10 "), late_orders) == ""


def test_the_first_item_of_a_queue_leaves_no_tie(spark, tmp_path):
    """Items of one place in the queue, and a folder that is listed twice."""
    for name in TABLES:
        rows = f"from '{SF}/{name}.parquet'"
        duckdb.sql(f"copy (select * {'replace (l_orderkey // 50 as l_orderkey, 3 as l_linenumber)' if name == 'lineitem' else ''} {rows} {f'union all select * {rows}' if name == 'supplier' else ''}) to '{tmp_path}/{name}.parquet'")
    assert compare(QUERIES["folder_queue"](spark, str(tmp_path)), ORACLE_SQL["folder_queue"], str(tmp_path)) == ""


def test_nearest_rows_copy_neither_rows_nor_queries(spark):
    """Ties by key, vectors of two lengths, no vector without numbers, queries in several groups; queries are in no shuffle."""
    pick = np.random.default_rng(5)
    made = [(f"k{n:03}", [float(x) for x in pick.integers(-2, 3, 3 if n % 5 else 2)]) for n in range(300)]
    made += [("none", None), ("hole", [1.0, None, 2.0]), ("zero", [0.0, 0.0, 0.0]), ("void", [])]
    rows = spark.createDataFrame(made, "id string, v array<double>")
    asks = rows.where("id like '%5' or id = 'zero'")
    held = {k: np.array(v) for k, v in made if v and None not in v and any(v)}
    want = []
    for query in sorted(k for k in held if k.endswith("5")):
        q = held[query]
        near = sorted((-round(float(v @ q) / float(np.sqrt(v @ v) * np.sqrt(q @ q)), 9), k) for k, v in held.items() if k != query and len(v) == len(q))
        want += [(query, k, s, place) for place, (s, k) in enumerate(near[:7], 1)]
    for options in ({}, {"slot_rows": 20, "values": 30}):
        found = listing.nearest_rows(rows, asks, "id", "v", 7, **options)
        assert [(r.query, r.id, -r.score, r.rank) for r in found.orderBy("query", "rank").collect()] == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert listing.nearest_rows(rows, asks.limit(0), "id", "v", 7).count() == 0


def test_scores_of_blocks_equal_sums_of_terms(spark):
    """Queries in groups, several texts a block, and no join of texts with queries."""
    pick = np.random.default_rng(6)
    made = [(f"d{n:03}", " ".join(f"w{int(w)}" for w in pick.integers(0, 40, n % 30) ** 2 // 30)) for n in range(200)]
    asked = [(n, " ".join(f"W{int(w)}" for w in pick.integers(0, 60, 4))) for n in range(300)]
    texts = {}
    for key, text in made:
        texts.setdefault(key, []).append(text.split())
    words = {k: sum(v, []) for k, v in texts.items() if any(v)}
    long = {k: max(map(len, texts[k])) for k in words}
    mean, want = sum(long.values()) / len(long), []
    for query, text in asked:
        scores = dict.fromkeys(words, 0.0)
        for term in set(text.lower().split()):
            having = [k for k in words if term in words[k]]
            for k in having:
                f = words[k].count(term)
                scores[k] += np.log(1 + (len(words) - len(having) + 0.5) / (len(having) + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * long[k] / mean))
        best = sorted((-round(s, 6), k) for k, s in scores.items() if s > 0)[:5]
        want += [(query, k, place, -s) for place, (s, k) in enumerate(best, 1)]
    docs, asks = spark.createDataFrame(made, "id string, text string"), spark.createDataFrame(asked, "query long, text string")
    for entries in (1 << 20, 500):
        found = index.lexical_search(index.inverted_index(docs, "id", "text"), asks, "id", 5, entries=entries)
        rows = found.orderBy("query", "rank").collect()
        assert [(r.query, r.id, r.rank) for r in rows] == [w[:3] for w in want]
        assert np.allclose([r.score for r in rows], [w[3] for w in want], atol=1.5e-6)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hybrid_search", "inverted_search"])
def test_searches_of_texts_shuffle_no_terms(spark, name):
    assert "hashpartitioning(doc_id" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_search_of_texts_finds_what_that_of_an_index_finds(spark):
    """Rows of one key, also null, are one text; several batches and blocks, queries in groups, letters beyond ASCII."""
    pick = np.random.default_rng(7)
    made = [(int(k) if k else None, " ".join(f"{'Wß日'[int(w) % 3]}{int(w)}," for w in pick.integers(0, 40, n % 30) ** 2 // 30)) for n, k in enumerate(pick.integers(0, 900, 1500))]
    made += [(5000, None), (5001, ""), (5002, "x" * 9_000_000 + " w1")]
    asks = spark.createDataFrame([(n, " ".join(f"{'wSSß日'[int(w) % 5]}{int(w)}" for w in pick.integers(0, 60, 4))) for n in range(300)], "query long, text string")
    for rows in (made, [(n, t) for n, (_, t) in enumerate(made)]):
        docs = spark.createDataFrame(rows, "id long, text string").coalesce(2)
        want = sorted(map(tuple, index.lexical_search(index.inverted_index(docs, "id", "text"), asks, "id", 5).collect()), key=lambda r: (r[0], r[3]))
        for entries in (1 << 20, 500):
            found = texts.search(docs, asks, "id", "text", 5, entries).collect()
            assert [r[:3:2] + r[3:] for r in sorted(map(tuple, found), key=lambda r: (r[0], r[3]))] == [r[:3:2] + r[3:] for r in want]
    assert texts.search(docs, asks.limit(0), "id", "text").count() == 0 == texts.search(docs.limit(0), asks, "id", "text").count()


def test_stages_of_a_search_shuffle_no_terms(spark):
    assert "hashpartitioning(doc_id" not in QUERIES["four_stage_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_substrings_are_found_without_a_shuffle_of_their_runs(spark):
    """Needles in groups, of less than a run, empty, null and alike, whose runs stand in texts apart, and rows of one key."""
    assert "gram" not in QUERIES["substring_matches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pick = np.random.default_rng(8)
    made = [(n % 700, "".join("abAé日 "[int(c)] for c in pick.integers(0, 6, n % 50))) for n in range(1400)] + [(900, None), (901, "abc" * 3_000_000 + "q"), (902, "abx cab")]
    needles = [(n, "".join("aBbÉ日 "[int(c)] for c in pick.integers(0, 6, n % 7))) for n in range(60)] + [(60, None), (61, "bcq"), (62, "BCQ"), (62, "日"), (63, "abcab"), (64, "none")]
    want = sorted({(n, k) for n, needle in needles if needle is not None for k, text in made if needle.lower() in (text or "").lower()})
    docs, asked = spark.createDataFrame(made, "id int, text string").coalesce(2), spark.createDataFrame(needles, "needle_id int, needle string")
    for options in ({}, {"entries": 20, "rarest": 1}):
        assert sorted(map(tuple, texts.substring_matches(docs, asked, "id", "text", **options).collect())) == want
    assert texts.substring_matches(docs, asked.limit(0), "id", "text").count() == 0


def test_parts_of_references_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART_ROWS", 300)
    df = QUERIES["qa_references"](spark, SF)
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())) == {str(parts)}
    assert compare(df, ORACLE_SQL["qa_references"], SF) == ""
