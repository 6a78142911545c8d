"""Queries on keys, assets, steps, cards and logs; every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import records
from kelpline.plans.files_queries import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("select p_partkey, p_partkey % 4 in (0, 1) as image from part")
def image_paths(spark, sf_dir):
    path = F.expr("concat('/a.b/x', p_partkey, case p_partkey % 4 when 0 then '.PNG' when 1 then '.jpeg' when 2 then '.pdf' else '' end)")
    return table(spark, sf_dir, "part").select("p_partkey", records.is_image(path).alias("image"))


_KEYS = "select c_custkey as id, concat('key', c_custkey % 11) as name, c_custkey % 2 = 0 as is_active, c_custkey % 3 = 0 as is_system from customer"


@query(f"select id, name from ({_KEYS}) where name = 'key4' and is_active and not is_system order by id limit 1")
def active_key(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "concat('key', c_custkey % 11) as name", "c_custkey % 2 = 0 as is_active", "c_custkey % 3 = 0 as is_system")
    return records.active_key(keys, "key4").select("id", "name")


@query(f"select name, is_active, count(*) as n from ({_KEYS}) where not is_system group by 1, 2")
def external_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").selectExpr("concat('key', c_custkey % 11) as name", "c_custkey % 2 = 0 as is_active", "c_custkey % 3 = 0 as is_system")
    return records.external_keys(keys).groupBy("name", "is_active").agg(F.count("*").alias("n"))


@query("with k as (select o_custkey as id, bool_or(o_orderkey % 7 = 0) as here from orders group by 1) select c_custkey as id, not coalesce(here, false) as to_download, not coalesce(here, false) and c_custkey % 4 <> 0 as missing from customer left join k on k.id = c_custkey")
def assets(spark, sf_dir):
    known = table(spark, sf_dir, "orders").selectExpr("o_custkey as id", "o_orderkey % 7 = 0 as exists")
    return records.assets(table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey % 4 = 0 as optional"), known)


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'private' when 1 then 'normal' end as privacy from orders where o_orderkey % 3 <> 0")
def visible_rows(spark, sf_dir):
    return records.visible(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case o_orderkey % 3 when 0 then 'private' when 1 then 'normal' end as privacy"), False)


@query("select c_nationkey, cast(greatest(0, d - m - n) as bigint) as documents, cast(greatest(0, d - m - n) + greatest(0, p) as bigint) as total, cast(greatest(0, o) as bigint) as others from (select c_nationkey, count(*) as d, count(*) filter (where c_custkey % 2 = 0) as m, count(*) filter (where c_custkey % 3 = 0) * 2 as n, count(*) - 20 as p, 3 * count(*) as o from customer group by 1)")
def card_counts(spark, sf_dir):
    sums = [F.count("*").alias("document"), F.count_if(F.col("c_custkey") % 2 == 0).alias("mail"), (2 * F.count_if(F.col("c_custkey") % 3 == 0)).alias("notes"), (F.count("*") - 20).alias("pending"), *[F.count("*").alias(k) for k in ("other", "archive", "presentation")]]
    return records.card_counts(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(*sums), "c_nationkey")


@query("select o_custkey as session, coalesce(arg_max(o_orderkey % 5, o_orderkey) filter (where o_orderstatus = 'F' and o_orderkey % 5 <> 0), 0) as time from orders group by 1")
def last_completed(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").selectExpr("o_custkey as session", "o_orderkey as position", "case when o_orderstatus = 'F' then 'complete' else 'running' end as status", "o_orderkey % 5 as time")
    return records.last_completed(steps)


@query("select o_orderkey, row_number() over (partition by o_custkey order by coalesce(case when o_orderkey % 4 > 0 then o_orderkey % 4 / 4 end, 0) desc, o_orderkey) as place from orders")
def by_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "case when o_orderkey % 4 > 0 then o_orderkey % 4 / 4 end as confidence")
    return records.by_confidence(rows, ["o_custkey"], "o_orderkey").select("o_orderkey", "place")


_LINES = "list_transform(range(0, p_size * 3), lambda i: 'line ' || ((i * p_partkey) // 7 % 9))"


@query(f"""with l as (select p_partkey, {_LINES} as a from part), k as (select p_partkey, a, list_filter(a, lambda x, i: i = 1 or x <> a[i - 1]) as k from l)
select p_partkey, array_to_string(k[-60:], '|') as tail, array_to_string(list_reverse(a[-4:]), '|') as newest from k""")
def log_tails(spark, sf_dir):
    a = F.expr("transform(if(p_size > 0, sequence(0, p_size * 3 - 1), array()), i -> concat('line ', (i * p_partkey) div 7 % 9))")
    rows = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"))
    return rows.select("p_partkey", F.array_join(records.log_tail("a"), "|").alias("tail"), F.array_join(records.last_reversed("a"), "|").alias("newest"))


@query("select o_orderkey, (o_orderkey % 2 > 0)::bigint + 1 as topics, (o_custkey % 2 = 0)::bigint as relevant from orders")
def nested_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array('', 'a', null, if(o_orderkey % 2 > 0, 'b', '')) as topics", "array(named_struct('relevant', o_custkey % 2 = 0), named_struct('relevant', cast(null as boolean))) as results")
    return rows.select("o_orderkey", F.size(records.named("topics")).cast("long").alias("topics"), records.relevant_count("results").alias("relevant"))


@query("select count(*) filter (where n_nationkey % 3 <> 0) as normal, count(*) filter (where n_nationkey % 3 = 0) as private from nation")
def privacy_counts(spark, sf_dir):
    return records.privacy_counts(table(spark, sf_dir, "nation").selectExpr("case n_nationkey % 3 when 0 then 'private' when 1 then 'normal' end as privacy"))


@query("select distinct o_orderdate as time, date_trunc('day', o_orderdate + interval 9 hour) - interval 9 hour as first, date_trunc('day', o_orderdate + interval 9 hour) - interval 9 hour + interval '23 hours 59 minutes' as last from orders")
def day_bounds(spark, sf_dir):
    first, last = records.day_bounds("time", "+09:00")
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("time")).distinct().select(*[c.cast("timestamp_ntz").alias(n) for n, c in (("time", F.col("time")), ("first", first), ("last", last))])
