"""SQL of the queries that SQL can express. The others (learned models, the encoder, packing, sharding, the license method's
own labels, a graph search of recall below 1) are held against brute force, round trips or held-out rows in tests."""

from __future__ import annotations

import re

from kelpline.llm.chat import CONTROL, END, TEXT, TURN
from kelpline.llm.rules import POLICIES, RULES, mask

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')".format
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MINHASH = f"""with recursive w as (select doc_id, {_WORDS(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
s as (select doc_id, unnest(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(id, r) as (select doc_id, doc_id from documents union select reach.id, links.b from reach join links on links.a = reach.r),
c as (select id, min(r) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d left join n using (doc_id) join c on c.id = d.doc_id"""

RULES_SQL = rf"""with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, {_WORDS(t='t')} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2), k as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from g),
p as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from k where c > 1) group by 1),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words,
 len(l) as n_lines, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) as n_letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) as n_upper, len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]\s'))) as n_bullet_lines from w left join p using (doc_id)),
f as (select *, cast({' + '.join(f'case when {rule} then {1 << k} else 0 end' for k, rule in enumerate(RULES.values()))} as bigint) as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, failures & {mask(POLICIES['v2'])} = 0 as kept, failures from f"""


def _escaped(text: str) -> str:
    """Length of a text whose control strings are escaped: a backslash more for each of them and for each backslash."""
    pattern = "|".join(re.escape(c).replace("'", "''") for c in sorted(CONTROL, key=len, reverse=True))
    return f"(length({text}) + length({text}) - length(replace({text}, '\\', '')) + len(regexp_extract_all({text}, '{pattern}')))"


CHAT = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum({len(TURN + TEXT + END)} + {_escaped('role')} + {_escaped('text')}) as bigint) as formatted_chars from t group by 1"""

def _crc32(text: str) -> str:
    """Checksum of an ASCII text by bytes, from the table t of the polynomial's remainders."""
    steps = f"list_concat([cast(4294967295 as bigint)], list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint)))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def _leaf(text: str) -> str:
    fields = [f"coalesce(cast(strlen(cast({f} as varchar)) as varchar) || ':' || cast({f} as varchar), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _levels(nodes: str, to: str, count: int) -> str:
    """Levels ``to``0, ``to``1, ... of (g, i, d, n): nodes of a group, each level's size n; a group of one node stays as it is."""
    out = [f"{to}0 as (select *, count(*) over (partition by g) as n from {nodes})"]
    for k in range(count):
        out.append(f"{to}r{k} as (select g, i // 16 as i, n, list(d order by i) as run from {to}{k} group by g, i // 16, n)")
        out.append(f"{to}{k + 1} as (select g, i, case when n > 1 then sha256(array_to_string(run, '')) else run[1] end as d, (n + 15) // 16 as n from {to}r{k})")
    return ",\n".join(out)


def _folds(start: str, levels: str, to: str, count: int) -> str:
    """Proofs and folded digests of rows (id, g, i, fold, proof) through the levels, as ``to``1, ``to``2, ..."""
    out, before = [], start
    for k in range(count):
        place = f"(f.i // {16**k}) % 16"
        left, right = f"array_to_string(run[1:{place}], '')", f"array_to_string(run[{place} + 2:], '')"
        out.append(f"{to}{k + 1} as (select f.* exclude (fold, proof), case when n > 1 then sha256({left} || fold || {right}) else fold end as fold, case when n > 1 then proof || {left} || {right} else proof end as proof from {before} f join {levels}r{k} r on r.g = f.g and r.i = f.i // {16 ** (k + 1)})")
        before = f"{to}{k + 1}"
    return ",\n".join(out)


#: Six levels reach 16 ** 6 rows of a source and as many sources.
_DEEP = 6
MERKLE = f"""with c as ({_CRC_TABLE}), d as (select *, row_number() over () as k, coalesce('=' || source, '') as g, {_leaf('text')} as leaf,
 case when {_crc32('cast(doc_id as varchar)')} % 5 = 0 then {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} else {_leaf('text')} end as tampered from documents, c),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, k) - 1 as i from d), a as (select g, i, leaf as d from p),
{_levels('a', 'a', _DEEP)},
s as (select g as source, d as subroot, row_number() over (order by g) - 1 as i from a{_DEEP}), b as (select '' as g, i, subroot as d from s),
{_levels('b', 'b', _DEEP)},
f0 as (select k, g, i, tampered as fold, '' as proof from p), {_folds('f0', 'a', 'f', _DEEP)},
h0 as (select f.k, '' as g, s.i, fold, proof from f{_DEEP} f join s on s.source = f.g), {_folds('h0', 'b', 'h', _DEEP)}
select doc_id, leaf, subroot, b{_DEEP}.d as root, sha256(proof) as proof_sha256, fold as folded_root, fold = b{_DEEP}.d as verified from p join h{_DEEP} h using (k) join s on s.source = p.g cross join b{_DEEP}"""

DIVERGENCE = rf"""with t as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
w as (select k, lang, source, unnest(regexp_extract_all(t, '[a-z\x{{80}}-\x{{10FFFF}}]+')) as term from t),
kept as (select lang, term, count(*) as of_lang from w group by 1, 2 having count(distinct k) >= 30), v as (select lang, count(*) as v, sum(of_lang) as n from kept group by 1),
g as (select distinct lang, source from t), c as (select lang, source, term, count(*) as c from w join kept using (lang, term) group by 1, 2, 3),
n as (select lang, source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by 1, 2),
p as (select n.lang, n.source, term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (n.n::hugeint + 5 * v) as p, 1 + (1000000000::hugeint * (of_lang + 5)) // (v.n::hugeint + 5 * v) as q
 from n join kept using (lang) join v using (lang) left join c using (lang, source, term)),
pairs as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
r as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
 union all select lang, source, 'term', term, cast(p - q as bigint) from p where c > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value, cast(rank as int) as rank from o where part = 'pair' or rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op2_minhash": MINHASH, "op5_rules": RULES_SQL, "op9_chat": CHAT, "op11_merkle": MERKLE, "op12_divergence": DIVERGENCE}
