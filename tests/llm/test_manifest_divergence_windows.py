"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpline.llm import divergence, merkle, windows
from kelpline.llm.queries import ORACLE_SQL, QUERIES, tokenizer
from tests.llm.test_operators import TEXTS
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, id string, place int, `group` string, term string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "n", "i", 1, "g", "t") for r in rows], SCHEMA)


def test_manifest_and_divergence_equal_their_sql(spark):
    for name in ("op11_merkle", "op12_divergence"):
        assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == ""


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_by_force(nodes, fan_out):
    """The last node, and for each leaf the (left, right) digests by level."""
    paths, level = [[] for _ in nodes], list(nodes)
    span = 1
    while len(level) > 1:
        for k, path in enumerate(paths):
            at = k // span
            run = level[at // fan_out * fan_out : at // fan_out * fan_out + fan_out]
            path.append(("".join(run[: at % fan_out]), "".join(run[at % fan_out + 1 :])))
        level = [sha("".join(level[i : i + fan_out])) for i in range(0, len(level), fan_out)]
        span *= fan_out
    return level[0], paths


def manifest_by_force(rows, fan_out):
    def leaf(row, lower=False):
        row = [*row[:4], re.sub("[A-Z]+", lambda m: m[0].lower(), row[4]) if lower and row[4] else row[4]]
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree_by_force([leaf(r) for r in groups[name]], fan_out)
    root, above = tree_by_force([trees[n][0] for n in names], fan_out)
    for name, up in zip(names, above, strict=True):
        for row, path in zip(groups[name], trees[name][1], strict=True):
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf(row, struck)
            for left, right in path + up:
                node = sha(left + node + right)
            out.append((row[0], leaf(row), trees[name][0], root, sha("".join(a + b for a, b in path + up)), node))
    return Counter(out)


@pytest.mark.parametrize("fan_out", [2, 3, 16])
def test_manifest_equals_brute_force(spark, fan_out):
    pick = random.Random(5)
    rows = [(i, pick.choice(["hot", "hot", "é", "z", "Z", "", None]), pick.choice([None, "en"]), pick.choice([None, i]), t) for i, t in TEXTS]
    rows += [(i, "hot", "en", 3, f"Text {i}") for i in range(300)] + [(7, "hot", None, None, None)] * 20 + [(None, None, None, None, None)] * 3 + [(9, "alone", "", 0, "")]
    docs = documents(spark, rows)
    received = [F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in FIELDS]
    found = merkle.manifest(docs, FIELDS, fan_out=fan_out, tampered=received, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    assert Counter(map(tuple, found.collect())) == manifest_by_force(rows, fan_out)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.manifest(documents(spark, []), FIELDS).count() == 0
    (one,) = merkle.manifest(documents(spark, [(1, "s", None, None, "t")]), FIELDS).collect()
    assert one.leaf == one.subroot == one.root == sha("1:11:s--1:t") and one.path == [] and one.tampered_leaf is None


def divergence_by_force(rows, least, top):
    rows = [((lang or ""), (source or ""), [t.decode() for t in (text or "").encode().translate(divergence._TERMS).split()]) for lang, source, text in rows]
    want = Counter()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        documents = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in documents.items() if n >= least]
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if documents[t] >= least) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())

        def share(of, term, kept=kept):
            return 1 + 10**9 * (of[term] + 5) // (sum(of.values()) + 5 * len(kept))

        for s, of in counts.items():
            pairs = [(-sum(abs(share(of, t) - share(counts[o], t)) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(share(whole, t) - share(of, t), t.encode()) for t in kept if of[t] and share(of, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                want.update((lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1))
    return want


@pytest.mark.parametrize("most,sources,least,top", [(200_000, 1000, 3, 50), (7, 2, 2, 3), (1, 1, 1, 2), (50, 1000, 10_000, 5)])
def test_divergence_equals_brute_force(spark, most, sources, least, top):
    pick = random.Random(most)
    words = ["the", "The", "of", "ab", "abc", "abd", "b", "über", "日本", "𝛼", "z" * 3000, "a'b", "12c"]
    rows = [(pick.choice(["en", "en", "de", None]), pick.choice(["s0", "s0", "s0", "s1", "é", "", None]), " ".join(pick.choices(words[: pick.randint(2, 13)], k=pick.randint(0, 30)))) for _ in range(250)]
    rows += [("en", "s0", None), ("xx", "none", ""), ("xx", "none2", "1 2"), ("yy", "one", "the the " * 5000)] + [("de", "s1", "same words here")] * 40
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "lang string, source string, text string, term string, segment int")
    found = divergence.divergence(docs, least=least, top=top, most=most, sources=sources)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == divergence_by_force(rows, least, top)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_tries_merge_split_and_walk_in_byte_order():
    pick = random.Random(1)
    terms = [bytes(pick.choices(b"ab\xc3\xa9\xff", k=pick.randint(0, 6))) for _ in range(2000)] + [b"x" * n for n in range(2000)]
    tries = [divergence.Trie() for _ in range(3)]
    want, documents = Counter(), Counter()
    for k, term in enumerate(terms):
        leaf = tries[k % 3].leaf(term)
        leaf.documents += 1
        leaf.occurrences[f"s{k % 5}"] = leaf.occurrences.get(f"s{k % 5}", 0) + k
        want[term, f"s{k % 5}"] += k
        documents[term] += 1
    for other in tries[1:]:
        tries[0].merge(other)
    walked = list(tries[0].walk())
    assert [t for t, _ in walked] == sorted(set(terms))
    assert {(t, s): n for t, leaf in walked for s, n in leaf.occurrences.items()} == dict.fromkeys(want, 0) | want
    assert {t: leaf.documents for t, leaf in walked} == documents


def test_shares_are_exact():
    pick = random.Random(2)
    whole = [pick.randint(1, 9 * 10**15) for _ in range(500)] + [1, 7]
    part = [pick.randint(1, w) for w in whole[:-2]] + [1, 7]
    assert divergence.shares(np.array(part), np.array(whole)).tolist() == [1 + 10**9 * a // b for a, b in zip(part, whole, strict=True)]


def cost(ends, fees, chosen, size):
    padding = [0 if x & (x - 1) == 0 else size - x for x in np.diff([0, *ends[chosen]]).tolist()]
    return sum(padding) + sum(fees[chosen].tolist()), len(chosen)


@pytest.mark.parametrize("seed", range(40))
def test_cuts_have_the_least_cost(seed):
    pick = random.Random(seed)
    size = pick.choice([8, 13, 32, 64])
    ends = np.cumsum([pick.randint(1, pick.choice([3, size])) for _ in range(pick.randint(1, 60))])
    fees = np.array([pick.choice([0, 0, 3, 16]) for _ in ends])
    best = [(0, 0)]
    for j, end in enumerate(ends.tolist()):
        options = []
        for i in range(j + 1):
            length = end - (int(ends[i - 1]) if i else 0)
            if length <= size:
                options.append((best[i][0] + (0 if length & (length - 1) == 0 else size - length) + int(fees[j]), best[i][1] + 1))
        best.append(min(options))
    chosen = windows.cuts(ends, fees, size)
    assert chosen[-1] == len(ends) - 1 and max(np.diff([0, *ends[chosen]])) <= size
    assert cost(ends, fees, chosen, size) == best[-1]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [1]


def hold(found, docs, size):
    """Every id in one piece, right checksums and tokens, sequences gapless and at most ``size`` long; returns the padding."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(library_ids(t))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in ids.items():
        want, got = Counter(), Counter(x for x in pieces[i])
        for sequence in own:
            cuts = sorted({a for a, _, _, n in pieces[i] if n == len(sequence)} | {len(sequence)})
            if len(own) == 1:
                want.update((a, b - a, zlib.crc32(np.array(sequence[a:b], "<u4").tobytes()), len(sequence)) for a, b in itertools.pairwise(cuts))
        if len(own) == 1:
            assert got == want
        assert sum(x[1] for x in pieces[i]) == sum(map(len, own))
    padding = 0
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        length = sum(n for _, n in own)
        assert 0 < length <= size
        padding += 0 if length & (length - 1) == 0 else size - length
    return padding


@pytest.mark.parametrize("size,block", [(2048, 400_000), (64, 2000), (100, 1500)])
def test_windows_hold_every_id_once(spark, size, block):
    pick = random.Random(3)
    texts = [*TEXTS[:-1], (20, "Is it? Yes! No. a 3.14 b\n\nend. "), (21, "word " * 9000), (22, "A short sentence stands here. " * 2000), (23, "É́ ends. ⅔ 日本語 ends. " * 40), (None, "no id. here")]
    texts = [(i if i != 6 else 600 + k, t) for k, (i, t) in enumerate(texts)] + [(100 + k, " ".join("word" + "." * (pick.random() < 0.1) for _ in range(pick.randint(0, 300)))) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in texts], "doc_id long, text string, ends string, row int, tokens double").repartition(3)
    found = windows.pack_windows(docs, tokenizer(), size=size, block_tokens=block, run_tokens=10**9).collect()
    padding = hold(found, texts, size)
    total = sum(r.length for r in found)
    assert padding < 0.08 * total
    whole = windows.pack_windows(docs, tokenizer(), size=size, run_tokens=20_000).collect()
    hold(whole, texts, size)


def test_windows_of_the_table_have_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op13_windows"](spark, SF).collect()
    padding = hold(found, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert padding < 0.02 * sum(r.length for r in found)
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_windows_keep_repeated_rows_and_take_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text here.")] * 50 + [(1, None)] * 3, "doc_id long, text string")
    found = windows.pack_windows(docs, tokenizer(), size=64).collect()
    tokens = len(library_ids("same text here."))
    assert sum(r.length for r in found) == 50 * tokens + 3
    assert Counter(r.doc_tokens for r in found if r.start == 0) == {tokens: 50, 1: 3}
    assert windows.pack_windows(docs.limit(0), tokenizer()).count() == 0


def test_cut_places_do_not_depend_on_what_a_worker_remembers():
    texts = ["One two. Three " + "y" * 60 + " four! " + "z" * 70 + ".", None, "", "  \n ", "plain\nlines \nhere", "odd é́ text. more", "<|endoftext|> x. y", "a\x01b. c\xa0d", "w " * 700 + "."]
    first, again = (list(windows.Cutter(tokenizer(), 1, memory).places(texts)) for memory in (1000, 2))
    for text, (ends, sums), (same, as_before) in zip(texts, first, again, strict=True):
        ids = library_ids(text)
        assert ends[-1] == len(ids)
        assert sums.tolist() == [zlib.crc32(np.array(ids[: abs(e)], "<u4").tobytes()) for e in ends.tolist()]
        assert ends.tolist() == same.tolist() and sums.tolist() == as_before.tolist()
    assert first[0][0].tolist() == [3, *first[0][0].tolist()[1:]] and len(first[0][0]) == 3
    assert len(first[4][0]) == 2 and (first[8][0] < 0).sum() == 10


def test_rare_terms_of_a_batch_are_dropped_before_they_are_merged():
    """Only terms that begin and end in the batch; the empty term and those of enough documents stay."""
    terms = ["a", "", "b", "b", "c", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "y", "y", "y", "y"]), pa.array(terms), pa.array([1, 0, 1, 2, 2, 1])], ["lang", "term", "documents"])
    assert divergence._without_rare(batch, 3).column(1).to_pylist() == ["a", "", "b", "b", "d"]


def test_leaves_of_sorted_terms_are_those_of_single_descents():
    one, other = divergence.Trie(), divergence.Trie()
    for terms in ([b"", b"a", b"abc", b"abd", b"b"], [b"ab", b"abcd", b"ax", b"b", b"\xc3\xa9"]):
        for term, leaf in zip(terms, one.leaves(terms), strict=True):
            leaf.documents += 1
            other.leaf(term).documents += 1
    assert [(t, x.documents) for t, x in one.walk()] == [(t, x.documents) for t, x in other.walk()]
