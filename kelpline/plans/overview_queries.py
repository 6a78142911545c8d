"""Queries on mapped payloads and overviews; every query reads its whole tables. Payloads are made by SQL of both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import mappers, overview
from kelpline.plans.answer_queries import _escaped, _made
from kelpline.plans.files_queries import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_FILES = """select o_orderkey as k, concat('{"id": ', o_orderkey, case when o_orderkey % 2 = 0 then ', "folder_id": ' else ', "folderId": ' end, o_custkey % 23, case when o_orderkey % 3 = 0 then '' else concat(', "name": "f', o_orderkey, '"') end, case when o_orderkey % 5 = 0 then ', "filename": "g"' else '' end, ', "size": ', o_custkey, case when o_orderkey % 4 = 0 then ', "index_status": "error"' when o_orderkey % 4 = 1 then ', "indexStatus": "pending"' else '' end, case when o_orderkey % 3 = 0 then ', "deepStage": 2' else '' end, '}') as payload from orders"""


@query(f"""select k, payload ->> 'id' as id, coalesce(payload ->> 'folder_id', payload ->> 'folderId', '') as folder_id, coalesce(payload ->> 'name', payload ->> 'filename', 'Unnamed') as name,
cast(payload ->> 'size' as bigint) as size, coalesce(payload ->> 'index_status', payload ->> 'indexStatus', 'indexed') as index_status, cast(coalesce(payload ->> 'deepStage', '0') as bigint) as deep_stage, 'normal' as privacy_level, 'other' as kind, '' as full from ({_FILES})""")
def mapped_files(spark, sf_dir):
    rows = mappers.mapped(_made(spark, sf_dir, _escaped(_FILES), "orders"), "payload", mappers.FILE, ["k"])
    return rows.select("k", "id", "folder_id", "name", "size", "index_status", "deep_stage", "privacy_level", "kind", F.coalesce("full_path", F.lit("")).alias("full"))


_FOUND = """select l_orderkey as k, l_linenumber as n, concat('{', case when l_partkey % 2 = 0 then '"file_id": ' else '"fileId": ' end, l_partkey, case when l_suppkey % 2 = 0 then ', "hasAnswer": true' when l_suppkey % 3 = 0 then ', "has_answer": false' else '' end, case when l_linenumber > 2 then concat(', "chunkId": "c', l_linenumber, '"') else '' end, case when l_linenumber > 1 then ', "score": 0.5' else '' end, '}') as payload from lineitem"""


@query(f"""select k, n, coalesce(payload ->> 'file_id', payload ->> 'fileId') as file_id, coalesce(payload ->> 'chunk_id', payload ->> 'chunkId') as chunk_id, cast(coalesce(payload ->> 'score', '0') as double) as score, cast(coalesce(payload ->> 'has_answer', payload ->> 'hasAnswer') as boolean) as has_answer, '{{}}' as metadata from ({_FOUND})""")
def mapped_hits(spark, sf_dir):
    return mappers.mapped(_made(spark, sf_dir, _escaped(_FOUND), "lineitem"), "payload", mappers.HIT, ["k", "n"]).select("k", "n", "file_id", "chunk_id", "score", "has_answer", "metadata")


_MAIL = """select c_custkey as k, concat('{', case when c_custkey % 2 = 0 then '"id": "a"' else '"account_id": "b"' end, case when c_custkey % 3 = 0 then ', "useSsl": false' else '' end, case when c_custkey % 5 = 0 then ', "total_messages": 7' when c_custkey % 5 = 1 then ', "totalMessages": 8' else '' end, case when c_custkey % 7 = 0 then ', "port": "x"' else ', "port": 993' end, '}') as payload from customer"""


@query(f"""select k, coalesce(payload ->> 'id', payload ->> 'account_id') as id, 'Email account' as label, 'imap' as protocol, coalesce(cast(payload ->> 'useSsl' as boolean), true) as use_ssl, cast(coalesce(payload ->> 'total_messages', payload ->> 'totalMessages', '0') as bigint) as total_messages, coalesce(try_cast(payload ->> 'port' as bigint), 0) as port from ({_MAIL})""")
def mapped_accounts(spark, sf_dir):
    return mappers.mapped(_made(spark, sf_dir, _escaped(_MAIL), "customer"), "payload", mappers.ACCOUNT, ["k"]).select("k", "id", "label", "protocol", "use_ssl", "total_messages", "port")


_STEPS = """select o_orderkey as k, concat('{', case o_orderkey % 4 when 0 then '"steps": []' when 1 then '"steps": [{"id": 5}, {"step_id": "s", "title": "T", "durationMs": 2.5}, {"status": "running"}]' when 2 then '"steps": []' else '"other": 1' end, case when o_orderkey % 3 = 0 then ', "summary": "done"' else '' end, '}') as payload from orders"""


@query(f"""with p as ({_STEPS}), d as (select k, payload ->> 'summary' as summary, cast(payload -> 'steps' as json[]) as s from p),
e as (select k, summary, i - 1 as position, s[i] as x from (select k, summary, s, unnest(range(1, len(s) + 1)) as i from d where len(s) > 0))
select k, summary, cast(position as bigint) as position, coalesce(x ->> 'id', x ->> 'step_id', concat('step-', position)) as id, coalesce(x ->> 'title', 'Step') as title, coalesce(x ->> 'status', 'complete') as status, cast(x ->> 'durationMs' as double) as duration_ms from e
union all select k, summary, null, null, null, null, null from d where coalesce(len(s), 0) = 0 and summary <> ''""")
def agent_diagnostics(spark, sf_dir):
    rows = mappers.diagnostics(_made(spark, sf_dir, _escaped(_STEPS), "orders"), "payload", "k")
    return rows.select("k", "summary", F.col("position").cast("long").alias("position"), "id", "title", "status", "duration_ms")


_CHUNKS = """select l_orderkey as k, l_linenumber as n, concat('{"chunk_id": ', l_partkey, ', "file_id": "f"', case when l_linenumber % 2 = 0 then ', "ordinal": 3' else '' end, case when l_linenumber % 3 = 0 then ', "page_num": 2, "text": "t"' else '' end, '}') as payload from lineitem"""


@query(f"select k, n, payload ->> 'chunk_id' as chunk_id, 'f' as file_id, cast(coalesce(payload ->> 'ordinal', '0') as bigint) as ordinal, coalesce(payload ->> 'text', '') as text, '' as snippet, cast(payload ->> 'page_num' as bigint) as page_num from ({_CHUNKS})")
def chunk_rows(spark, sf_dir):
    return mappers.mapped(_made(spark, sf_dir, _escaped(_CHUNKS), "lineitem"), "payload", mappers.CHUNK, ["k", "n"]).select("k", "n", "chunk_id", "file_id", "ordinal", "text", "snippet", "page_num")


@query("""with m as (select p_partkey as k, case when p_partkey % 3 = 0 then 'n' when p_partkey % 3 = 1 then '' end as name, case p_partkey % 4 when 0 then 'C:\\a\\b.txt' when 1 then '/x/y.md' when 2 then '' end as path from part)
select k, nullif(name, '') as source_name, nullif(path, '') as source_path, coalesce(nullif(name, ''), case k % 4 when 0 then 'b.txt' when 1 then 'y.md' end, concat('File ', k)) as name, coalesce(path, '') as location from m""")
def reference_labels(spark, sf_dir):
    name = F.expr("case when p_partkey % 3 = 0 then 'n' when p_partkey % 3 = 1 then '' end")
    path = F.when(F.expr("p_partkey % 4 = 0"), "C:\\a\\b.txt").when(F.expr("p_partkey % 4 = 1"), "/x/y.md").when(F.expr("p_partkey % 4 = 2"), "")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.create_map(F.lit("name"), name, F.lit("path"), path).alias("m"))
    label, source = mappers.reference_label("k", "m"), mappers.source("m")
    return rows.select("k", source["name"].alias("source_name"), source["path"].alias("source_path"), label["name"].alias("name"), label["location"].alias("location"))


_LISTED = "select o_orderkey, case o_orderkey % 4 when 0 then 'code' when 1 then 'image' when 2 then 'document' end as kind, case o_custkey % 5 when 0 then 'error' when 1 then 'not_indexed' when 2 then 'fast' when 3 then 'deep' else 'pending' end as status from orders"


@query(f"select o_orderkey, 'none' as part from ({_LISTED}) where coalesce(kind, '') <> 'code' and status in ('error', 'not_indexed') union all select o_orderkey, 'indexed' from ({_LISTED}) where kind = 'image' and status in ('fast', 'deep', 'pending')")
def category_and_status(spark, sf_dir):
    rows = _made(spark, sf_dir, _LISTED, "orders")
    one = overview.of_status(overview.of_category(rows), "not_indexed").select("o_orderkey", F.lit("none").alias("part"))
    return one.union(overview.of_status(overview.of_category(rows, "image"), "indexed").select("o_orderkey", F.lit("indexed")))


_SAID = "select o_orderkey as k, o_custkey % 7 as account_id, case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then 'h' end as human, case when o_orderkey % 2 = 0 then 'c' else '' end as computer from orders"


@query(f"select k from ({_SAID}) where human <> '' and account_id <> 3")
def shown_paragraphs(spark, sf_dir):
    return overview.without_account(overview.shown(_made(spark, sf_dir, _SAID, "orders"), "human"), 3).select("k")


_QUEUE = "select l_suppkey % 20 as folder_id, l_orderkey * 10 + l_linenumber as seq, concat('p', l_partkey) as path, case l_linenumber % 3 when 0 then 'processing' when 1 then 'pending' else 'done' end as status from lineitem"


@query(f"select folder_id, seq, path, status from ({_QUEUE}) q where not exists (select 1 from partsupplied s where s.path = q.path and s.folder_id = q.folder_id)".replace("partsupplied", "(select o_custkey % 20 as folder_id, concat('p', o_orderkey % 500) as path from orders)"))
def pending_outside_tree(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 as folder_id", "concat('p', o_orderkey % 500) as path")
    return overview.not_in_tree(_made(spark, sf_dir, _QUEUE, "lineitem"), files).select("folder_id", "seq", "path", "status")


@query(f"select s_suppkey as folder_id, count(*) filter (where status = 'processing') as processing, count(*) filter (where status = 'pending') as pending, count(path) as queued, arg_min(path, (seq, path)) filter (where status = 'processing') as first_processing from (select distinct s_suppkey from supplier) left join ({_QUEUE}) q on q.folder_id = s_suppkey group by 1")
def folder_queue(spark, sf_dir):
    return overview.folder_queue(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("folder_id")), _made(spark, sf_dir, _QUEUE, "lineitem"))


@query("with r as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as number, o_orderkey as target from orders), c as (select l_suppkey as k, cast(l_linenumber as bigint) as number from lineitem) select c.k, c.number, r.target from c left join r using (k, number)")
def nth_results(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("long").alias("number"))
    results = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("target"))
    return overview.nth_results(cited, results.withColumn("o", F.col("target")), "k", "o", "target").select("k", "number", "target")


@query("select o_custkey, o_orderkey, place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as place from orders) where place <= 5")
def newest_cells(spark, sf_dir):
    return overview.newest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 5).select("o_custkey", "o_orderkey", "place")


@query("with u as (select o_custkey % 50 as u, 'cells' as t from orders union all select o_custkey % 50, 'episodes' from orders where o_orderkey % 2 = 0 union all select l_suppkey % 70, 'facts' from lineitem union all select p_partkey % 60, 'foresights' from part) select u, count(*) filter (where t = 'cells') as cells, count(*) filter (where t = 'episodes') as episodes, count(*) filter (where t = 'facts') as facts, count(*) filter (where t = 'foresights') as foresights from u group by 1")
def memory_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 as u", "o_orderkey")
    tables = {"cells": orders, "episodes": orders.where("o_orderkey % 2 = 0"), "facts": table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 70 as u"), "foresights": table(spark, sf_dir, "part").selectExpr("p_partkey % 60 as u")}
    return overview.memory_summary(tables, "u")


@query("select o_orderkey, o_orderkey % 3 + o_custkey % 4 as errors from orders")
def stage_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "named_struct('error', o_orderkey % 3) as fast_text", "named_struct('error', cast(null as long)) as fast_embed", "named_struct('error', o_custkey % 4) as deep")
    return rows.select("o_orderkey", overview.stage_errors(rows, ["fast_text", "fast_embed", "deep"]).alias("errors"))


_PATHS = "select concat('/a', o_custkey % 9, '/b', o_orderkey % 4, '/', o_orderkey) as path from orders"


@query(f"select regexp_extract(path, '^(.*)/[^/]*$', 1) as parent_path, count(*) as files, min(path) as first from ({_PATHS}) group by 1")
def files_by_parent(spark, sf_dir):
    return overview.by_parent(_made(spark, sf_dir, _PATHS, "orders"))


_ASSETS = "select p_partkey, case p_partkey % 5 when 0 then 'x-vlm' when 1 then 'mmproj' when 2 then 'embedding-q' when 3 then 'bge-1' else 'whisper' end as id, case when p_partkey % 7 > 0 then p_partkey end as size, p_partkey % 5 <> 2 as exists_ from part"


@query(f"select case when id in ('x-vlm', 'mmproj') then 'vlm' when id = 'embedding-q' then 'embedding' when id = 'bge-1' then 'reranker' else 'other' end as \"group\", count(*) as assets, cast(sum(coalesce(size, 0)) as bigint) as bytes, bool_and(exists_) as ready from ({_ASSETS}) group by 1")
def asset_sizes(spark, sf_dir):
    return overview.asset_sizes(_made(spark, sf_dir, _ASSETS, "part").withColumnRenamed("exists_", "exists"))


@query("select o_orderkey, concat('f', i) as file, cast(j as bigint) as place, concat('e', i, '-', j) as text from orders, range(1, 3) a(i), range(0, 2) b(j) where i <= o_orderkey % 3")
def evidence_items(spark, sf_dir):
    items = "transform(if(o_orderkey % 3 > 0, sequence(1, cast(o_orderkey % 3 as int)), array()), i -> named_struct('file', concat('f', i), 'evidence', array(concat('e', i, '-0'), concat('e', i, '-1')))) as items"
    return overview.evidence(table(spark, sf_dir, "orders").selectExpr("o_orderkey", items), "o_orderkey").withColumn("place", F.col("place").cast("long"))


@query("""with r as (select o_orderkey as k, o_orderkey % 7 = 0 as d, o_orderkey % 3 = 0 as f, case o_orderkey % 5 when 0 then 2 when 1 then 0 end as p, case when o_orderkey % 11 = 0 then 'reindex' end as mode from orders),
m as (select *, coalesce(mode, case when d or coalesce(p, 0) > 0 then 'reindex' else 'rescan' end) as m, case when f then 'folder' else 'global' end as s from r)
select k, m as mode, s as scope, cast(coalesce(p, case when m = 'reindex' and s <> 'global' then 1 end, -1) as bigint) as purged from m""")
def index_plan(spark, sf_dir):
    purge = "case o_orderkey % 5 when 0 then array('p', 'q') when 1 then cast(array() as array<string>) end as purge_folders"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_orderkey % 7 = 0 as drop_collection", "if(o_orderkey % 3 = 0, array('f'), null) as folders", purge, "if(o_orderkey % 11 = 0, 'reindex', null) as mode", "cast(null as string) as scope")
    return overview.index_plan(rows).select("k", "mode", "scope", F.when(F.col("purge_folders").isNull(), -1).otherwise(F.size("purge_folders")).cast("long").alias("purged"))


@query("select cast(o_orderdate as date) as day, o_orderstatus as kind, count(*) as rows, min(o_orderdate) as first, max(o_orderdate) as last from orders where o_orderdate between timestamp '1995-03-01' and timestamp '1997-03-01' group by 1, 2")
def timeline_between(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderstatus").alias("kind"))
    found = overview.daily_summary(overview.between(rows, "at", "1995-03-01", "1997-03-01"), "at", "kind")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})
