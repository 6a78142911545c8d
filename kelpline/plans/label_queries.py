"""Queries on labels of rows, lookups with a fallback, first rows and groups; every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import labels
from kelpline.operators import catalog, listing, memory, records, retrieval
from kelpline.plans.files_queries import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then case o_orderkey % 4 when 0 then 'vision_processing' when 1 then 'semantic_processing' else 'keyword_processing' end
when o_orderkey % 7 = 0 then 'error' when o_custkey % 5 > 3 then 'vision_done' when o_custkey % 3 = 2 then 'semantic_done' when o_custkey % 3 = 1 then 'keyword_done' when o_orderkey % 7 = 1 then 'none'
when o_orderkey % 5 = 0 then 'vision_done' when o_orderkey % 5 = 1 then 'semantic_done' when o_orderkey % 13 = 0 then 'vision_done' when o_orderkey % 13 = 1 or o_orderkey % 5 = 2 then 'semantic_done' else 'none' end as mode from orders""")
def index_modes(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderkey % 11 = 0 as processing",
        "case o_orderkey % 4 when 0 then 'deep_scan' when 1 then 'embedding' when 2 then '' end as stage",
        "case o_orderkey % 7 when 0 then 'error' when 1 then 'pending' else 'indexed' end as status",
        "o_custkey % 5 - 3 as deep",
        "o_custkey % 3 as fast",
        "case o_orderkey % 5 when 0 then 'v1_fine' when 1 then 'v1_fast' when 2 then 'other' else '' end as strategy",
        "case o_orderkey % 13 when 0 then 'deep' when 1 then 'fast' else '' end as vision",
    )
    fields = ("processing", "stage", "status", "deep", "fast", "strategy", "vision")
    return files.select("o_orderkey", labels.index_mode(*map(F.col, fields)).alias("mode"))


@query(r"select doc_id, md5(text) as text, nullif(regexp_extract(concat(case doc_id % 3 when 0 then 'Page  ' when 1 then 'see PAGE ' else 'p.' end, doc_id, ': ', coalesce(text, '')), '(?i)page\s+(\d+)', 1), '') as label from documents")
def page_labels(spark, sf_dir):
    text = F.expr("concat(case doc_id % 3 when 0 then 'Page  ' when 1 then 'see PAGE ' else 'p.' end, doc_id, ': ', coalesce(text, ''))")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), labels.page_label(text).alias("label"))


@query("""select o_orderkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as date,
case when o_orderkey % 5 <> 0 then concat(lpad(cast(o_orderkey % 24 as varchar), 2, '0'), ':', lpad(cast(o_custkey % 60 as varchar), 2, '0')) end as time from orders""")
def summary_times(spark, sf_dir):
    name = F.expr("case when o_orderkey % 5 = 0 then concat('notes_', o_orderkey, '.md') else concat('Activity_Summary_', date_format(o_orderdate, 'yyyy-MM-dd'), '_', lpad(o_orderkey % 24, 2, '0'), '-', lpad(o_custkey % 60, 2, '0'), '.md') end")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.summary_file_time(name).alias("x")).select("o_orderkey", "x.date", "x.time")


@query("select doc_id, concat(array_to_string(string_split(text, ' ')[1:15], ' '), case when len(string_split(text, ' ')) > 15 then '...' else '' end) as start from documents where text is not null")
def text_starts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", labels.first_words("text").alias("start"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'Unknown recipients' when 1 then concat('u', c_custkey) else concat('u', c_custkey, ' +', c_custkey % 4 - 1) end as recipients from customer")
def recipient_labels(spark, sf_dir):
    names = F.expr("slice(array(concat('u', c_custkey), 'v', 'w'), 1, cast(c_custkey % 4 as int))")
    return table(spark, sf_dir, "customer").select("c_custkey", labels.recipients_label(names).alias("recipients"))


@query("select doc_id, case doc_id % 4 when 0 then substring(coalesce(text, ''), 1, 300) when 1 then substring(concat('text: ', coalesce(text, '')), 1, 300) else '' end as preview from documents")
def json_previews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    listed = F.to_json(F.array(F.struct(F.col("text").alias("content"))))
    raw = F.when(F.col("doc_id") % 4 == 0, listed).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("text: "), F.coalesce("text", F.lit("")))).when(F.col("doc_id") % 4 == 2, F.to_json(F.struct("text")))
    return docs.select("doc_id", labels.json_preview(raw).alias("preview"))


@query("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def first_orders(spark, sf_dir):
    return catalog.first_by_id(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("""select l_returnflag as group_name, bool_and(l_orderkey % 500 <> 0 or l_returnflag = 'A') as ready, cast(sum(case when l_linenumber < 3 then l_partkey else 0 end) as bigint) as bytes,
cast(case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end as bigint) as place from lineitem group by 1""")
def asset_group_order(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as group_name", "l_orderkey % 500 <> 0 or l_returnflag = 'A' as present", "case when l_linenumber < 3 then l_partkey end as size")
    return catalog.asset_groups(parts, ["R", "A"])


@query("""with r as (select case when o_orderkey % 5 > 0 then o_custkey end as file, o_orderkey as place, o_orderkey % 3 = 0 as old from orders),
n as (select file, place from r where not old and file is not null and file not in (select file from r where old and file is not null) qualify row_number() over (partition by file order by place) = 1)
select file, place from r where old union all select file, place from n""")
def merged_references(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("case when o_orderkey % 5 > 0 then o_custkey end as file", "o_orderkey as place", "o_orderkey % 3 = 0 as old")
    return retrieval.new_references(rows.where("old").drop("old"), rows.where("not old").drop("old"), ["file"], "place")


@query("select l_orderkey, l_linenumber, o_orderpriority as episode_subject from lineitem left join orders on o_orderkey = l_orderkey and o_custkey % 4 > 0 where l_linenumber not in (3, 4)")
def facts_with_episode(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case l_linenumber when 3 then '' when 4 then null else cast(l_orderkey as string) end as parent_episode_id")
    episodes = table(spark, sf_dir, "orders").where("o_custkey % 4 > 0").selectExpr("cast(o_orderkey as string) as id", "o_orderpriority as subject")
    return memory.with_episode(facts, episodes, linked_only=True).drop("parent_episode_id")


@query("""with k as (select concat('key', c_custkey % 40) as name, min(c_custkey) as id from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 0 group by 1)
select name, id, id is null as created from (select distinct concat('key', o_custkey % 45) as name from orders) left join k using (name)""")
def keys_or_new(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "concat('key', c_custkey % 40) as name", "c_custkey % 2 = 0 as is_active", "c_custkey % 3 = 0 as is_system")
    return records.keys_or_new(keys, table(spark, sf_dir, "orders").selectExpr("concat('key', o_custkey % 45) as name"))


@query("select c_custkey, coalesce(n_name, cast(c_nationkey as varchar)) as strategy from customer left join nation on n_nationkey = c_nationkey and n_nationkey % 3 > 0")
def strategy_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return listing.with_name(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "strategy").select("c_custkey", "strategy")
