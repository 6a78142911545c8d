"""Queries on texts, hits, conversations and redaction; every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import labels, redaction
from kelpline.operators import events, memory, retrieval
from kelpline.plans.files_queries import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _duck(rules) -> list[tuple[str, str]]:
    return [(p.replace(r"\x{1F4DD}", "\U0001f4dd"), r) for p, r in rules]


@query("select doc_id, lang from documents where lower(coalesce(source, '')) like '%src1%' or contains(lower(coalesce(text, '')), 'mit license')")
def substring_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(retrieval.contains_any("src1", "source") | retrieval.contains_any("MIT License", "text")).select("doc_id", "lang")


@query(f"select doc_id, sha256({redaction.oracle('text', _duck(redaction.log_rules()))}) as redacted from documents")
def redact_log(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redaction.redact("text", redaction.log_rules()), 256).alias("redacted"))


@query(f"select doc_id, sha256({redaction.oracle('text', _duck(redaction.log_rules(True)))}) as redacted from documents")
def redact_log_addresses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redaction.redact("text", redaction.log_rules(True)), 256).alias("redacted"))


@query(f"select page_id, sha256({redaction.oracle('html', _duck(redaction.EXPORT_RULES))}) as redacted from pages")
def redact_export(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(redaction.redact("html", redaction.EXPORT_RULES), 256).alias("redacted"))


def _counts_sql() -> str:
    rules = _duck(redaction.EXPORT_RULES)
    steps = ["s0 as (select page_id, html as t, 0 as n from pages)"]
    for i, rule in enumerate(rules):
        pattern = rule[0].replace("'", "''")
        steps.append(f"s{i + 1} as (select page_id, {redaction.oracle('t', [rule])} as t, n + len(regexp_extract_all(t, '{pattern}')) as n from s{i})")
    return f"with {', '.join(steps)} select page_id, cast(n as bigint) as redactions from s{len(rules)}"


@query(_counts_sql())
def redaction_counts(spark, sf_dir):
    return redaction.redacted(table(spark, sf_dir, "pages").select("page_id", "html"), "html", redaction.EXPORT_RULES, "redactions").select("page_id", "redactions")


@query("select c_custkey, regexp_replace(regexp_replace('/Users/u' || c_custkey % 9 || '/x /home/u3/y C:\\Users\\u3\\z /Users/u33/', '/Users/u3/', '/Users/[USER]/', 'g'), '/home/u3/', '/home/[USER]/', 'g').replace('C:\\Users\\u3\\', 'C:\\Users\\[USER]\\') as path from customer")
def redact_user_paths(spark, sf_dir):
    path = F.concat(F.lit("/Users/u"), (F.col("c_custkey") % 9).cast("string"), F.lit("/x /home/u3/y C:\\Users\\u3\\z /Users/u33/"))
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.redact_user(path, "u3").alias("path"))


@query("""with c as (select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 500) / 400), 0) as int) + 1)) as ordinal from documents where length(text) > 0)
select doc_id, ordinal, ordinal * 400 as start, sha256(substring(text, ordinal * 400 + 1, 500)) as chunk from c""")
def chunk_windows(spark, sf_dir):
    rows = retrieval.chunk_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("start").cast("long").alias("start"), F.sha2("chunk", 256).alias("chunk"))


_COSINE = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


@query(f"select e.vec_id, round({_COSINE}, 9) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.vec_id <> 0 order by {_COSINE} desc, vec_id limit 20")
def cosine_topk(spark, sf_dir):
    return retrieval.vector_hits(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0).withColumn("score", F.round("score", 9))


_LEX = "(case when contains(lower({t}), 'license') then 1 else 0 end + case when contains(lower({t}), 'under') then 1 else 0 end + case when contains(lower({t}), 'version') then 1 else 0 end)"


@query(f"select doc_id, {_LEX.format(t='text')} as matched, {_LEX.format(t='text')} / 3 as score from documents where {_LEX.format(t='text')} > 0 order by matched desc, doc_id limit 10")
def lexical_topk(spark, sf_dir):
    return retrieval.lexical_hits(table(spark, sf_dir, "documents"), "doc_id", "text", "License under VERSION")


_STAGES = f"""a as (select doc_id as file_id, 1.0 as score, 'filename' as stage, 0 as arrival from documents where source = 'src3'),
b as (select doc_id, 0.5, 'metadata', 1 from documents where lang = 'de'), c as (select doc_id, {_LEX.format(t='text')} / 10, 'hybrid', 2 from documents where {_LEX.format(t='text')} > 0),
u as (select * from a union all select * from b union all select * from c)"""


def _stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexical = sum((F.lower(F.coalesce("text", F.lit(""))).contains(t).cast("int") for t in ("license", "under", "version")), F.lit(0))
    hits = lambda rows, score: rows.select(F.col("doc_id").alias("file_id"), score.alias("score"))
    return retrieval.stages_union([("filename", hits(docs.where("source = 'src3'"), F.lit(1.0))), ("metadata", hits(docs.where("lang = 'de'"), F.lit(0.5))), ("hybrid", hits(docs.where(lexical > 0), lexical / 10))])


@query(f"with {_STAGES} select file_id, score, stage, arrival from u")
def progressive_union(spark, sf_dir):
    return _stages(spark, sf_dir)


@query(f"with {_STAGES} select file_id, max(score) as best, count(*) as hits, min(arrival) as first_arrival, max(score) < 0.3 as is_low from u group by 1")
def best_score_by_file(spark, sf_dir):
    return retrieval.best_by_file(_stages(spark, sf_dir))


_COMMENT = "case l_partkey % 5 when 0 then 'Yes. It does not mention more.' when 1 then 'This does not mention it. No.' when 2 then 'no_answer' when 3 then null else 'Good match' end"
_HAS = "case when l_suppkey % 4 = 0 then null else l_suppkey % 4 > 1 end"
_DENY = "(contains(upper(coalesce(c, '')), 'NO_ANSWER') or regexp_matches(regexp_extract(upper(coalesce(c, '')), '^(.*?)([.?!]\\s|$)', 1), '{p}'))"


@query(f"with x as (select l_orderkey, l_linenumber, l_partkey, {_HAS} as h, {_COMMENT} as c from lineitem) select l_orderkey, l_linenumber, l_partkey, coalesce(h and not {_DENY.format(p='DOES NOT MENTION')}, false) as strict, coalesce(h and not {_DENY.format(p='DOES NOT')}, false) as lenient, case when h is null then 'unanalysed' when h and not {_DENY.format(p='DOES NOT MENTION')} then 'relevant' else 'not_relevant' end as class from x")
def relevance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_HAS).alias("h"), F.expr(_COMMENT).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", labels.relevant("h", "c").alias("strict"), labels.relevant("h", "c", strict=False).alias("lenient"), labels.answer_class("h", "c").alias("class"))


@query("""with h as (select o_orderkey, o_custkey % 40 as session, row_number() over (partition by o_custkey % 40 order by o_orderkey) as position, case when o_orderkey % 3 > 0 then 'c' || o_orderkey end as chunk_id from orders),
j as (select p_partkey as seq, p_partkey % 40 as session, p_size as index, 'c' || p_partkey * 3 as chunk_id, p_size > 25 as has_answer, p_retailprice / 3000 as confidence from part),
jc as (select session, chunk_id, arg_min((has_answer, confidence), (seq, index)) as v from j group by 1, 2), jp as (select session, index, arg_min((has_answer, confidence), (seq, index)) as v from j group by 1, 2)
select o_orderkey, coalesce(jc.v, jp.v)[1] as has_answer, round(coalesce(jc.v, jp.v)[2], 6) as confidence from h left join jc using (session, chunk_id) left join jp on jp.session = h.session and jp.index = h.position""")
def priority_join(spark, sf_dir):
    none = {"has_answer": F.lit(None).cast("boolean"), "comment": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}
    orders = table(spark, sf_dir, "orders").withColumns({"session": F.col("o_custkey") % 40, **none})
    hits = orders.select("o_orderkey", "session", F.row_number().over(Window.partitionBy("session").orderBy("o_orderkey")).cast("long").alias("position"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))).alias("chunk_id"), *none)
    verdicts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 40).alias("session"), F.col("p_size").alias("index"), F.concat(F.lit("c"), (F.col("p_partkey") * 3).cast("string")).alias("chunk_id"), (F.col("p_size") > 25).alias("has_answer"), F.lit(None).cast("string").alias("comment"), (F.col("p_retailprice") / 3000).alias("confidence"))
    return retrieval.judge(hits, verdicts, ["session"], retrieval.parts_of(orders)).select("o_orderkey", "has_answer", F.round("confidence", 6).alias("confidence"))


@query("select count(*) as judged, count(*) filter (where p_size > 25 and p_retailprice / 2000 >= 0.8) as high_quality from part")
def high_quality(spark, sf_dir):
    return retrieval.high_quality(table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("has_answer"), (F.col("p_retailprice") / 2000).alias("confidence")))


@query("""with t as (select o_orderkey, [cast(l as bigint) for l in [o_orderkey % 7, o_custkey % 5, o_orderkey % 3]] as ns from orders)
select o_orderkey, cast(generate_subscripts(ns, 1) - 1 as int) as place, unnest(ns) as number, case when unnest(ns) < 5 then 'ref' || unnest(ns) end as target from t""")
def citation_links(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("As said [ "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" , "), (F.col("o_custkey") % 5).cast("string"), F.lit("], and ["), (F.col("o_orderkey") % 3).cast("string"), F.lit("] [x].")).alias("text"))
    refs = orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("number")).withColumn("target", F.concat(F.lit("ref"), F.col("number").cast("string")))
    return retrieval.cited(orders, "o_orderkey", "text", refs)


@query("select l_orderkey as file_id, coalesce(nullif(l_linenumber % 4, 0), 1) as page, count(*) as chunks, min(l_linenumber) as first, max(l_linenumber) as last from lineitem group by 1, 2")
def page_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 4).alias("page"), F.col("l_linenumber").alias("ordinal"))
    return retrieval.page_groups(rows, "file_id")


@query("select conv_id as file_id, sha256(string_agg(text, chr(10) order by turn)) as text from conversations group by 1")
def page_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("ordinal"), F.col("text").alias("chunk"))
    return retrieval.page_text(rows, "file_id").withColumn("text", F.sha2("text", 256))


@query("""select 'episode' as kind, cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as parent_id, o_orderpriority as text, o_orderdate as at from orders
union all select 'event', cast(l_orderkey * 10 + l_linenumber as varchar), cast(l_orderkey as varchar), l_returnflag, l_shipdate from lineitem
union all select 'foresight', cast(c_custkey as varchar), cast(c_nationkey as varchar), c_name, timestamp '1970-01-01' from customer""")
def timeline_union(spark, sf_dir):
    one = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_memcell_id"), F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    two = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("parent_episode_id"), F.col("l_returnflag").alias("atomic_fact"), F.col("l_shipdate").cast("timestamp").alias("timestamp"))
    three = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent_episode_id"), F.col("c_name").alias("content"))
    return memory.timeline(one, two, three).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select n_nationkey as id, coalesce(list_sort(list(s_name) filter (where s_name is not null)), []) as items from nation left join supplier on s_nationkey = n_nationkey group by 1")
def children_lists(spark, sf_dir):
    return memory.children(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf_dir, "supplier"), "id", "s_nationkey", "s_name")


@query("""with t as (select conv_id, cast(turn // 2 % 1440 as int) as minute, turn, case when role = 'assistant' then 'other' when role = 'user' then 'self' end as speaker, text from conversations where text is not null and trim(text) <> '' and not contains(text, '[BLANK_AUDIO]'))
select conv_id, minute, sha256(coalesce(string_agg(text, ' ' order by turn) filter (where speaker is distinct from 'other'), '')) as human, sha256(coalesce(string_agg(text, ' ' order by turn) filter (where speaker = 'other'), '')) as computer from t group by 1, 2""")
def minute_transcript(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.timestamp_seconds(F.col("turn") * 30).alias("start_time"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "other").when(F.col("role") == "user", "self").alias("speaker"), "text")
    return memory.by_minute(rows, ["conv_id"]).select("conv_id", "minute", F.sha2("human", 256).alias("human"), F.sha2("computer", 256).alias("computer"))


@query("""select conv_id as session, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as text, arg_max(text, turn) filter (where role = 'user' and text is not null) as meta from conversations group by 1""")
def qa_event_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "token").when(F.col("role") == "user", "status").otherwise("note").alias("type"), F.col("text").alias("data"))
    return events.messages(rows).select("session", F.sha2("text", 256).alias("text"), "meta")


@query("""with r as (select l_orderkey as session, l_linenumber as position, 'f' || l_partkey as file_id, l_linenumber as index from lineitem),
j as (select distinct on (l_orderkey) l_orderkey as session, l_linenumber as index, l_quantity > 25 as has_answer from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey)
select session, count(*) as hits, count(distinct file_id) as files, count(has_answer) as judged, count(*) filter (where has_answer) as answers from (select r.*, j.has_answer from r left join j using (session, index)) group by 1""")
def qa_references(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = retrieval.parts_of(items)
    hit = F.struct(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_id"), F.struct(F.col("l_linenumber").alias("index")).alias("metadata"))
    sessions = items.repartition(parts, "session").groupBy("session")
    found = sessions.agg(F.to_json(F.sort_array(F.collect_list(hit))).alias("data"))
    first = sessions.agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    verdict = F.struct(F.struct(F.col("x.l_linenumber").alias("index"), (F.col("x.l_quantity") > 25).alias("has_answer")).alias("chunk_result"))
    log = found.select("session", F.lit(1).alias("seq"), F.lit("hits").alias("type"), "data").union(first.select("session", F.lit(2), F.lit("chunk_progress"), F.to_json(verdict)))
    refs = events.references(log, parts).repartition(parts, "session")
    return refs.groupBy("session").agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"), F.count("has_answer").alias("judged"), F.count_if("has_answer").alias("answers"))


@query("select user_id, event_id from events e where cast(props->>'k' as int) = (select max(cast(props->>'k' as int)) from events x where x.user_id = e.user_id)")
def latest_request(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("request_id"))
    return events.latest_request(rows, "user_id").select("user_id", "event_id")


@query("""select conv_id, turn, case when len(string_split(text, ' ')) > 15 then array_to_string(string_split(text, ' ')[1:15], ' ') || '...' else text end as words,
case when coalesce(text, '') = '' then 'No preview available yet.' else array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:2], ' ') end as lines, regexp_extract(text, '^((?s).*?)([.?!]\\s|$)', 1) as sentence from conversations""")
def text_previews(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", labels.first_words("text").alias("words"), labels.first_lines("text").alias("lines"), labels.first_sentence("text").alias("sentence"))


@query("""select p_partkey, case p_partkey % 6 when 0 then 'Found 3 of ' || p_partkey when 1 then 'Searching...' when 2 then 'Starting analysis of ' || p_size || ' sources...' when 3 then 'Searching sub-query 1/' || p_size || '...' when 4 then 'other' else null end as status,
case when p_partkey % 6 = 2 then cast(ceil(p_size / 5) as bigint) end as batches, case p_size % 4 when 0 then null when 1 then 'vision' when 2 then 'semantic' else 'keyword' end as stage, cast(least(greatest(floor(p_retailprice - 900 + 0.5), 0), 100) as int) as percent, cast(case when p_size % 3 = 0 then null else p_size % 3 end as int) as page from part""")
def status_texts(spark, sf_dir):
    code = F.expr("case p_partkey % 6 when 0 then concat('Found 3 of ', p_partkey) when 1 then 'searching' when 2 then concat('analyzing_', p_size, '_chunks') when 3 then concat('searching_subquery_1_of_', p_size) when 4 then 'other' end")
    stage = F.expr("case p_size % 4 when 0 then '' when 1 then 'Deep_pass' when 2 then 'fast_embed' else 'fast_text' end")
    page = labels.page_number((F.col("p_size") % 3), F.lit(0), F.lit(None).cast("int"), F.array().cast("array<int>"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.status_text(code).alias("status"), labels.analysis_batches(code).alias("batches"), labels.processing_stage(stage).alias("stage"), labels.clamp_percent(F.col("p_retailprice") - 900).alias("percent"), page.alias("page"))
