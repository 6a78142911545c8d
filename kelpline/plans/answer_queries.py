"""Queries on answer streams, hit and queue lookups, orders and fused search; every query reads its whole tables. Streams are
made from ``lineitem``, files from ``orders``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import answers, listing, retrieval
from kelpline.plans.files_queries import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: In both dialects: an event of every line, several sessions, several runs.
_STEPS = """select l_orderkey % 97 as session, (((l_orderkey * 10 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint) as seq,
case when l_orderkey % 53 = 0 and l_linenumber = 1 then 'multi_path_start' when l_orderkey % 31 = 0 and l_linenumber = 2 then 'multi_path_end' else 'thinking_step' end as type,
concat('{"id": "s', l_partkey % 6, '", "title": "t', l_suppkey % 9, '", "status": "', case when l_linenumber % 3 = 0 then 'complete' else 'running' end, '"', case when l_quantity > 25 then ', "hits": [1, 2]' when l_quantity > 20 then ', "hits": []' else '' end, '}') as data from lineitem"""


def _made(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    for name in names:
        sql = sql.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    # ``sql`` of spark formats braces, so JSON's own are doubled first
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def _escaped(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


def _wide(sql: str) -> str:
    """``sql`` with places in 38 digits: in a long they overflow from about 4.6 million orders on."""
    return sql.replace("l_orderkey * 10 ", "cast(l_orderkey as decimal(38, 0)) * 10 ")


@query(f"""with e as ({_STEPS}), b as (select session, max(seq) filter (where type = 'multi_path_start') as s, max(seq) filter (where type = 'multi_path_end') as t from e group by 1),
x as (select session, seq, data ->> 'id' as id, data ->> 'title' as title, data ->> 'status' as status, json_array_length(data, '$.hits') as hits, t from e join b using (session) where type = 'thinking_step' and (s is null or seq > s)),
g as (select session, id, min(seq) as first, max(seq) as last, arg_max(title, seq) as title, arg_max(status, seq) as status, arg_max(hits, seq) filter (where hits is not null) as hits, any_value(t) as t from x group by 1, 2)
select session, row_number() over (partition by session order by first) as position, id, title, case when status = 'running' and last < t then 'complete' else status end as status, cast(hits as bigint) as hits from g""")
def thinking_steps(spark, sf_dir):
    return answers.thinking_steps(_made(spark, sf_dir, _wide(_escaped(_STEPS)), "lineitem"))


_KNOWN = "select l_orderkey % 50 as session, case when l_partkey % 4 > 0 then concat('c', l_partkey % 300) else '' end as chunk_id, concat('f', l_suppkey % 20) as file_id from lineitem where l_linenumber = 1"
_NEW = _KNOWN.replace("l_linenumber = 1", "l_linenumber > 1")


@query(f"with o as ({_KNOWN}), n as ({_NEW}) select * from o union all select * from n where not exists (select 1 from o where o.session = n.session and coalesce(nullif(o.chunk_id, ''), o.file_id) = coalesce(nullif(n.chunk_id, ''), n.file_id))")
def resumed_references(spark, sf_dir):
    return answers.resumed_references(_made(spark, sf_dir, _KNOWN, "lineitem"), _made(spark, sf_dir, _NEW, "lineitem"))


#: Stored hits, and events of resumed answers: an event of every line.
_STOPPED = """select o_custkey % 60 as session, row_number() over (partition by o_custkey % 60 order by o_orderkey) as position, concat('f', o_orderkey % 20) as file_id, case when o_orderkey % 5 > 0 then concat('c', o_orderkey % 300) end as chunk_id, case when o_orderkey % 3 = 0 then o_orderkey % 2 = 0 end as has_answer from orders"""
_RESUMED = """select l_orderkey % 61 as session, (((l_orderkey * 10 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint) as seq,
case l_linenumber when 1 then 'hits' when 2 then 'subquery_hits' when 3 then 'chunk_progress' when 4 then 'chunk_analysis' when 5 then case when l_orderkey % 400 = 7 then 'multi_path_start' else 'token' end when 6 then 'status' else 'user_decision_required' end as type,
case l_linenumber when 1 then concat('[{"file_id": "f', l_partkey % 40, '", "chunk_id": "c', l_partkey % 700, '", "score": 0.5}, {"file_id": "f', l_suppkey % 40, '"}]')
 when 2 then concat('{"sub_query_index": 1, "hits": [{"file_id": "g", "chunk_id": "d', l_partkey % 90, '"}]}')
 when 3 then concat('{"current_file": "x", "chunk_result": {"index": ', l_partkey % 50, ', "chunk_id": "c', l_partkey % 700, '", "has_answer": ', case when l_quantity > 25 then 'true' else 'false' end, '}}')
 when 4 then concat('[{"index": ', l_suppkey % 400, ', "chunk_id": "c', l_partkey % 700, '", "has_answer": true}]') when 6 then concat('code', l_partkey % 5) when 7 then concat('{"resume_token": "t', l_partkey, '"}') else concat(l_partkey, ' ') end as data from lineitem"""


def stopped(rows: DataFrame) -> DataFrame:
    """Stored messages of stored hits: even sessions were multi-path runs."""
    hit = F.struct("position", "file_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("long").alias("index"), "has_answer", F.lit(None).cast("string").alias("comment"), F.lit(None).cast("double").alias("confidence"))
    return rows.groupBy("session").agg(F.sort_array(F.collect_list(hit)).alias("references")).selectExpr("session", "'stored ' as text", "session % 2 = 0 as is_multi", "'t' as resume_token", "references")


@query(f"""with st as ({_STOPPED}), s as (select distinct session, session % 2 = 0 as is_multi from st), e as ({_RESUMED}),
l as (select session, seq, type, case type when 'hits' then cast(data as json[]) when 'subquery_hits' then cast(cast(data as json) -> 'hits' as json[]) else [] end as hits from e where type in ('hits', 'subquery_hits', 'multi_path_start')),
r as (select session, cast(-1 as bigint) as seq, case when is_multi then 'multi_path_start' else 'stored' end as type, [] as hits from s union all select l.* from l semi join s using (session)),
m as (select *, max(cast(type = 'multi_path_start' as int)) over (partition by session order by seq) as multi from r), n as (select *, sum(cast(type = 'hits' and multi = 0 as int)) over (partition by session order by seq) as era from m),
k as (select * from n qualify era = max(era) over (partition by session)),
x as (select session, seq, type = 'hits' and multi = 1 as merges, generate_subscripts(hits, 1) as pl, unnest(hits) as h from k where len(hits) > 0),
h as (select session, seq, merges, pl, h ->> 'file_id' as file_id, h ->> 'chunk_id' as chunk_id, cast(null as boolean) as has_answer from x union all select session, -1, false, position, file_id, chunk_id, has_answer from st where exists (select 1 from k where k.session = st.session and k.seq = -1)),
f as (select *, row_number() over (partition by session order by seq, pl) as position from (select * from h qualify not merges or min(seq) over (partition by session, coalesce(chunk_id, file_id)) = seq)),
v as (select session, seq, type, case type when 'chunk_progress' then cast(data as json) -> 'chunk_result' else cast(data as json) -> 0 end as j from e where type in ('chunk_progress', 'chunk_analysis')),
u as (select session, seq, type, j ->> 'chunk_id' as chunk_id, cast(j ->> 'index' as bigint) as position, cast(j ->> 'has_answer' as boolean) as a from v),
pc as (select session, chunk_id, max(seq) as cs, arg_max(a, seq) as ca from u where type = 'chunk_progress' group by 1, 2), pp as (select session, position, max(seq) as ps, arg_max(a, seq) as pa from u where type = 'chunk_progress' group by 1, 2),
fc as (select session, chunk_id, arg_min(a, seq) as fca from u where type = 'chunk_analysis' group by 1, 2), fp as (select session, position, arg_min(a, seq) as fpa from u where type = 'chunk_analysis' group by 1, 2)
select session, position, file_id, chunk_id, case when ps is null and cs is null then coalesce(has_answer, fca, fpa) when ps is null or cs >= ps then ca else pa end as has_answer
from f left join pc using (session, chunk_id) left join pp using (session, position) left join fc using (session, chunk_id) left join fp using (session, position)""")
def continued_references(spark, sf_dir):
    stored = stopped(_made(spark, sf_dir, _STOPPED, "orders"))
    found = answers.continued_references(stored, _made(spark, sf_dir, _wide(_escaped(_RESUMED)), "lineitem"), retrieval.parts_of(table(spark, sf_dir, "lineitem")))
    return found.select("session", "position", "file_id", "chunk_id", "has_answer")


@query(f"""with s as (select distinct session from ({_STOPPED})), e as ({_RESUMED}), m as (select session, string_agg(data, '' order by seq) filter (where type = 'token') as text, bool_or(type = 'multi_path_start') as multi, bool_or(type = 'user_decision_required') as decides,
 arg_max(case when type = 'user_decision_required' then cast(data as json) ->> 'resume_token' end, seq) as token, max(seq) filter (where type not in ('token', 'multi_path_start', 'chunk_analysis')) as last from e group by 1),
n as (select m.*, case e.type when 'hits' then 'Found 2 sources' when 'subquery_hits' then 'Sub-query 1: Found 1 sources' when 'chunk_progress' then 'Analyzing x...' when 'status' then e.data else 'Waiting for confirmation...' end as meta from m left join e on e.session = m.session and e.seq = m.last)
select session, sha256('stored ' || coalesce(text, '')) as text, meta, session % 2 = 0 or coalesce(multi, false) as is_multi, coalesce(decides, false) as needs_decision, token as resume_token from s left join n using (session)""")
def continued_messages(spark, sf_dir):
    stored = stopped(_made(spark, sf_dir, _STOPPED, "orders"))
    found = answers.continued_messages(stored, _made(spark, sf_dir, _wide(_escaped(_RESUMED)), "lineitem"))
    return found.withColumn("text", F.sha2("text", 256))


_HITS = "select o_custkey % 60 as session, row_number() over (partition by o_custkey % 60 order by o_orderkey) as position, case when o_orderkey % 3 > 0 then concat('c', o_orderkey) end as chunk_id from orders"
_JUDGED = """select p_partkey % 60 as session, p_partkey as seq, case when p_partkey % 4 = 0 then 'chunk_analysis' else 'chunk_analysis_item' end as type,
concat(case when p_partkey % 4 = 0 then '[' else '' end, '{"index": ', p_size, ', "chunk_id": "c', p_partkey * 3, '", "has_answer": ', case when p_size > 25 then 'true' else 'false' end, ', "confidence": ', p_size / 100.0, '}', case when p_partkey % 4 = 0 then concat(', {"index": ', p_size + 1, ', "has_answer": true, "confidence": 0.5}, {"index": ', p_size, ', "has_answer": true, "confidence": 0.25}]') else '' end) as data from part"""


@query(f"""with h as ({_HITS}), e as ({_JUDGED}), i as (select session, seq, 0 as place, cast(data as json) as j, true as item from e where type = 'chunk_analysis_item'),
b as (select session, seq, generate_subscripts(a, 1) as place, unnest(a) as j, false as item from (select session, seq, cast(data as json[]) as a from e where type = 'chunk_analysis')),
u as (select session, seq, -place as pl, j ->> 'chunk_id' as chunk_id, cast(j ->> 'index' as bigint) as index, cast(j ->> 'has_answer' as boolean) as has_answer, cast(j ->> 'confidence' as double) as confidence, item from (select * from i union all select * from b)),
c as (select session, chunk_id, max(seq) as seq, arg_max((has_answer, confidence), (seq, pl)) as v from u where item group by 1, 2), p as (select session, index as position, max(seq) as seq, arg_max((has_answer, confidence), (seq, pl)) as v from u group by 1, 2)
select session, position, chunk_id, (case when p.seq is null or c.seq >= p.seq then c.v else p.v end)[1] as has_answer, round((case when p.seq is null or c.seq >= p.seq then c.v else p.v end)[2], 6) as confidence from h left join c using (session, chunk_id) left join p using (session, position)""")
def judged_last(spark, sf_dir):
    events = _made(spark, sf_dir, _escaped(_JUDGED), "part")
    return answers.judged_last(_made(spark, sf_dir, _HITS, "orders"), events).select("session", "position", "chunk_id", "has_answer", F.round("confidence", 6).alias("confidence"))


@query("select l_orderkey as session, concat('c', l_suppkey % 3) as chunk_id, max(l_quantity) as score, count(distinct l_linenumber % 2) as sub_queries, count(*) as times from lineitem group by 1, 2")
def merged_sub_queries(spark, sf_dir):
    hit = F.struct((F.col("l_linenumber") % 2).alias("sub_query"), F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("chunk_id"), F.col("l_quantity").alias("score"))
    return answers.merged_sub_queries(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.array(hit).alias("hits")))


_META = "case when l_orderkey % 5 = 0 then concat('/m/', l_partkey % 7, '/n', l_suppkey, '.MD') when l_orderkey % 5 = 1 then '' end"


@query(f"""with h as (select l_orderkey, l_linenumber, l_partkey as file_id, {_META} as meta from lineitem), f as (select p_partkey as id, concat('n', p_size, case when p_size % 3 = 0 then '.txt' else '' end) as name, concat('/files/', p_size % 4, '/n', p_size) as path from part where p_partkey % 2 = 0),
j as (select l_orderkey, l_linenumber, file_id, coalesce(nullif(f.name, ''), case when l_orderkey % 5 = 0 then 'hit' end, 'Untitled') as name, coalesce(nullif(f.path, ''), nullif(meta, ''), '') as path, f.id is not null as known from h left join f on f.id = file_id)
select l_orderkey, l_linenumber, file_id, name, path, case when contains(name, '.') then lower(split_part(name, '.', -1)) else 'other' end as extension, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') as location, known from j""")
def hit_files(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("file_id"), F.create_map(F.lit("path"), F.expr(_META), F.lit("file_name"), F.expr("case when l_orderkey % 5 = 0 then 'hit' end")).alias("metadata"))
    files = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("p_partkey as id", "concat('n', p_size, case when p_size % 3 = 0 then '.txt' else '' end) as name", "concat('/files/', p_size % 4, '/n', p_size) as path")
    return listing.hit_files(hits, files).drop("metadata")


@query("""with m as (select c_nationkey as folder_id, max(c_custkey) as account_id from customer where c_nationkey % 3 = 0 group by 1), n as (select n_nationkey as folder_id from nation where contains(lower(concat('/x/Notes', n_nationkey % 4)), 'notes1'))
select s_suppkey, folder_id, case when account_id is not null then 'email' when exists (select 1 from n where n.folder_id = i.folder_id) then 'notes' else 'general' end as part, account_id from (select s_suppkey, s_nationkey as folder_id from supplier) i left join m using (folder_id)""")
def queue_split(spark, sf_dir):
    items = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey as folder_id")
    accounts = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").selectExpr("c_nationkey as folder_id", "c_custkey as account_id")
    return listing.queue_split(items, accounts, table(spark, sf_dir, "nation").selectExpr("n_nationkey as folder_id", "concat('/x/Notes', n_nationkey % 4) as path"), "notes1")


@query("""with q as (select l_orderkey as path, max(l_linenumber) as seq from lineitem where l_returnflag <> 'N' group by 1)
select o_orderkey as path, q.path is not null as is_processing, case when q.path is not null then 'stage' || seq end as stage from orders left join q on q.path = o_orderkey""")
def processing_stage(spark, sf_dir):
    queue = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as path", "l_linenumber as seq", "concat('stage', l_linenumber) as stage", "case l_returnflag when 'N' then 'done' when 'A' then 'pending' else 'processing' end as status")
    return listing.processing_stage(table(spark, sf_dir, "orders").selectExpr("o_orderkey as path"), queue)


_KINDS = ["O", "F", "P", "none"]


@query("select 'kind' as part, key, coalesce(n, 0) as files from (select unnest(['O', 'F', 'P', 'none']) as key) k full join (select o_orderstatus as key, count(*) as n from orders group by 1) f using (key) union all select 'location', cast(o_custkey % 30 as varchar), count(*) from orders group by 2")
def snapshot(spark, sf_dir):
    return listing.snapshot(table(spark, sf_dir, "orders").selectExpr("o_orderstatus as kind", "cast(o_custkey % 30 as string) as location"), _KINDS)


_NODES = "select p_partkey, p_size as parent, concat(case when p_partkey % 2 = 0 then 'File' else 'file' end, p_partkey % 40, '-', p_partkey) as name, p_partkey % 3 = 0 as is_folder, case when p_partkey % 5 = 0 then 'never' else concat('2024-01-', 10 + p_partkey % 19) end as latest from part"


@query(f"select *, row_number() over (partition by parent order by is_folder desc, lower(name), name) as by_name, row_number() over (partition by parent order by try_cast(latest as timestamp) desc nulls last, name) as by_latest from ({_NODES})")
def sibling_places(spark, sf_dir):
    return listing.sibling_places(_made(spark, sf_dir, _NODES, "part"))


@query("with f as (select o_orderstatus as kind, o_custkey as folder from orders), k as (select kind, count(*) as n from f group by 1) select cast(null as varchar) as project, cast(sum(n) as bigint) as files, arg_max(kind, (n, kind)) as kind, (select count(distinct folder) from f) as folders from k")
def scattered_insights(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_orderstatus as kind", "o_custkey as folder")
    nothing = spark.createDataFrame([], "project string, files long, kind string")
    return listing.insights_or_scatter(nothing, files, F.col("folder"))


@query("with r as (select l_orderkey * 10 + l_linenumber as seq, l_orderkey as path, case l_returnflag when 'A' then 'pending' when 'R' then 'processing' else 'done' end as status from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 2 = 0)) select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'processing') as processing, arg_min(path, seq) filter (where status = 'processing') as first_processing from r")
def queue_overview(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as seq", "l_orderkey as path", "case l_returnflag when 'A' then 'pending' when 'R' then 'processing' else 'done' end as status")
    return listing.queue_overview(items, table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").selectExpr("o_orderkey as path"))


@query("select c_custkey as account_id, count(*) filter (where o_orderstatus = 'P') as processing, count(*) filter (where o_orderstatus = 'O') as pending from customer left join orders on o_custkey = c_custkey group by 1")
def account_counts(spark, sf_dir):
    items = table(spark, sf_dir, "orders").selectExpr("o_custkey as account_id", "case o_orderstatus when 'P' then 'processing' when 'O' then 'pending' else 'done' end as status")
    return listing.account_counts(table(spark, sf_dir, "customer").selectExpr("c_custkey as account_id"), items)


@query("select p_partkey, case when p_size % 3 = 1 then [cast(p_size as bigint)] when p_size % 2 = 0 then [cast(p_partkey as bigint)] else [] end as boxes from part")
def page_boxes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "array(named_struct('page_num', p_size % 3, 'bbox', cast(p_size as bigint)), named_struct('page_num', 1, 'bbox', cast(null as bigint))) as regions", "case when p_size % 2 = 0 then cast(p_partkey as bigint) end as bbox")
    return parts.select("p_partkey", listing.page_boxes("regions", "bbox", F.lit(1)).alias("boxes"))


@query("select cast(o_orderdate as date) as day, count(*) as files, arg_max(path, (o_orderdate, path)) as newest from (select o_orderdate, concat('/notes', o_custkey % 3, '/', o_orderkey) as path, case when o_orderkey % 2 = 0 then 'md' else 'txt' end as extension from orders) where contains(path, 'notes1') and extension = 'md' group by 1")
def summary_files(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_orderdate as created_at", "concat('/notes', o_custkey % 3, '/', o_orderkey) as path", "case when o_orderkey % 2 = 0 then 'md' else 'txt' end as extension")
    return listing.summary_files(files, "notes1")


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'PDF' when 1 then 'txt' when 2 then 'png' end as extension, case when o_orderkey % 4 = 2 then 'Image' end as kind, o_orderkey % 4 = 0 as pdfs, o_orderkey % 4 = 2 as images, o_orderkey % 4 = 1 as docs from orders")
def type_filters(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case o_orderkey % 4 when 0 then 'PDF' when 1 then 'txt' when 2 then 'png' end as extension", "case when o_orderkey % 4 = 2 then 'Image' end as kind")
    return files.select("*", *[listing.of_type(k).alias(k) for k in ("pdfs", "images", "docs")])


_NEAR = """with e as (select vec_id, cast(embedding as double[]) as v from embeddings), p as (select q.vec_id as query, e.vec_id, round(list_cosine_similarity(e.v, q.v), 9) as score from e join e q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from p)"""


@query(f"{_NEAR} select query, vec_id, score, rank from r where rank <= 10")
def cosine_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return listing.nearest_rows(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


