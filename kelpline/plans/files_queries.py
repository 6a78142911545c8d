"""Queries on activity, folders and file listings. Files are made from ``orders`` (path, kind, size, time by rules),
activity also from ``events``; every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import labels, paths
from kelpline.model import GENERIC_FOLDERS, KIND_EXTENSIONS
from kelpline.operators import activity, catalog, folders
from kelpline.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _case(key: str, values: list[str]) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


_TOP = ["Desktop", "Documents/Work", "Downloads", "projects/atlas", "Pictures/2024", "projects/build", "Library/Logs", ".cache/tmp", "notes"]
_SUB = ["alpha", "src", "beta/reports", "images", "gamma", "delta/Archive", "node_modules/x"]
_NAME = ["IMG_", "report ", "123", "a very long file name that goes on and on ", ".hidden", "Screenshot ", "plan-"]
_EXT = ["pdf", "JPG", "py", "mp4", "csv", "tar.gz", "epub", "docx", "md"]
FILE_COLUMNS = {
    "file_id": "o_orderkey",
    "folder_id": "o_custkey % 23",
    "parent_path": f"concat('/Users/u', cast(o_custkey % 5 as varchar(9)), '/', {_case('o_custkey', _TOP)}, '/', {_case('(o_custkey + o_orderkey % 3)', _SUB)})",
    "name": f"case when o_orderkey % 7 = 2 then concat('0', cast(o_orderkey as varchar(20)), '.pdf') else concat({_case('o_orderkey', _NAME)}, cast(o_orderkey as varchar(20)), '.', {_case('(o_orderkey + o_custkey)', _EXT)}) end",
    "size": "cast(round(o_totalprice * o_totalprice / 1000) as bigint)",
    "status": "case o_orderstatus when 'F' then 'error' when 'P' then 'pending' else null end",
}
FILES_SQL = f"""files as (select *, concat(parent_path, '/', name) as path,
  lower(regexp_extract(name, '[^/]\\.([^./]*)$', 1)) as extension from (
  select {', '.join(f'{e} as {n}' for n, e in FILE_COLUMNS.items())},
  o_orderdate + to_seconds((o_orderkey * 7919) % 86400) as modified_at, o_totalprice as price from orders)),
  kinds(ext, kind) as (values {', '.join(f"('{e}', '{k}')" for k, es in KIND_EXTENSIONS.items() for e in es)}),
  kfiles as (select f.*, k.kind from files f left join kinds k on f.extension = k.ext),
  generic(g) as (values {', '.join(f"('{g}')" for g in GENERIC_FOLDERS)})"""
WITH = f"with recursive {FILES_SQL}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(*[F.expr(e).alias(n) for n, e in FILE_COLUMNS.items()], F.timestamp_add("SECOND", F.expr("cast((o_orderkey * 7919) % 86400 as int)"), F.col("o_orderdate").cast("timestamp")).alias("modified_at"), F.col("o_totalprice").alias("price"))
    rows = rows.withColumns({"path": F.concat("parent_path", F.lit("/"), "name"), "extension": paths.extension("name")})
    return rows.withColumn("kind", labels.kind_of("extension"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("ts").cast("timestamp").alias("modified_at"), F.col("event_type").alias("kind"), F.col("value").alias("size"), F.col("event_type").alias("extension"))


PCT = "cast(coalesce(floor(100.0 * {a} / nullif({b}, 0) + 0.5), 0) as bigint)".format


@query(f"""with d as (select cast(ts as date) as day, count(*) as n from events group by 1),
w as (select dayofweek(day) as w, sum(least(n, 500)) as n from d group by 1), t as (select sum(n) as t from w)
select ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][(select w from w order by n desc, w limit 1) + 1] as busy_day,
 cast((select max(n) from w) as bigint) as busy_count, {PCT(a='(select max(n) from w)', b='t')} as busy_percent,
 ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][(select w from w order by n, w limit 1) + 1] as lazy_day,
 cast((select min(n) from w) as bigint) as lazy_count, {PCT(a='(select min(n) from w)', b='t')} as lazy_percent from t""")
def capped_weekday_activity(spark, sf_dir):
    return activity.capped_weekdays(event_files(spark, sf_dir))


@query(f"""with g as (select cast(ts as date) as day, hour(ts) as h, count(*) as n from events group by 1, 2),
x as (select h, sum(least(n, 200)) as n from g group by 1), b as (select h, n from x order by n desc, h limit 1),
l(h, s) as (select i, case when i = 0 then '12 AM' when i < 12 then i || ' AM' when i = 12 then '12 PM' else (i - 12) || ' PM' end from range(24) r(i))
select (select s from l where l.h = b.h) || '-' || (select s from l where l.h = (b.h + 1) % 24) as hour, cast(n as bigint) as files, {PCT(a='n', b='(select sum(n) from x)')} as percent from b""")
def capped_hour_activity(spark, sf_dir):
    return activity.capped_hour(event_files(spark, sf_dir))


@query(WITH + """select count(*) as files, cast(sum(size) as bigint) as bytes, count(distinct cast(modified_at as date)) as active_days, count(distinct nullif(extension, '')) as extensions,
 count(*) / greatest(count(distinct cast(modified_at as date)), 1) as per_day, cast(floor(count(*) / 12 + 0.5) as bigint) as per_month, sum(size) / 12 as bytes_per_month from files""")
def activity_totals(spark, sf_dir):
    return activity.totals(files(spark, sf_dir))


@query(WITH + """select m.i as month, coalesce(n, 0) as files, cast(coalesce(b, 0) as bigint) as bytes from range(12) m(i)
left join (select month(modified_at) - 1 as m, count(*) as n, sum(size) as b from files group by 1) f on f.m = m.i""")
def month_buckets(spark, sf_dir):
    return activity.month_buckets(files(spark, sf_dir))


@query(WITH + """select cast(modified_at as date) as day, count(*) as files, dayofweek(cast(modified_at as date)) as weekday,
 cast(floor((dayofyear(cast(modified_at as date)) - 1) / 7) as bigint) as week from files group by 1""")
def daily_counts(spark, sf_dir):
    return activity.daily_counts(files(spark, sf_dir))


@query("""select cast(ts as date) as day, count(*) as files, dayofweek(cast(ts as date)) as weekday,
 cast(floor((dayofyear(cast(ts as date)) - 1) / 7) as bigint) as week from events group by 1 order by files desc, day limit 1""")
def busiest_day(spark, sf_dir):
    return activity.busiest_day(event_files(spark, sf_dir))


_SHARE = "count(*) as files, {b} as bytes, " + PCT(a="count(*)", b="(select count(*) from {t})") + " as percent"


@query(WITH + ", b as (select cast(modified_at as date) as d, count(*) as n from kfiles group by 1 order by n desc, d limit 1), x as (select * from kfiles where cast(modified_at as date) = (select d from b)) select coalesce(kind, 'unknown') as kind, " + _SHARE.format(b="cast(sum(size) as bigint)", t="x") + " from x group by 1")
def busiest_day_kinds(spark, sf_dir):
    return activity.busiest_day_kinds(files(spark, sf_dir))


@query(WITH + "select coalesce(kind, 'unknown') as kind, " + _SHARE.format(b="cast(sum(size) as bigint)", t="kfiles") + " from kfiles group by 1")
def kind_share(spark, sf_dir):
    return activity.share_by(files(spark, sf_dir), F.col("kind"), "kind")


_ORIGIN_SQL = "case when parent_path like '/Users/u_/Downloads%' then 'downloaded' when parent_path like '/Users/u_/projects%' then 'synced' when parent_path like '/Users/u_/Desktop%' or parent_path like '/Users/u_/Documents%' then 'created_here' else 'unknown' end"


@query(WITH + f"select {_ORIGIN_SQL} as origin, " + _SHARE.format(b="cast(sum(size) as bigint)", t="kfiles") + " from kfiles group by 1")
def origin_share(spark, sf_dir):
    home = [f"/Users/u{i}" for i in range(5)]
    own = paths.origin("path", [f"{h}/Downloads" for h in home], [f"{h}/projects" for h in home], [f"{h}/{d}" for h in home for d in ("Desktop", "Documents", "Projects", "Work")])
    return activity.share_by(files(spark, sf_dir), own, "origin")


@query("""select event_id, minutes_to_five from (select event_id, cast(case when hour(ts) >= 22 then (29 - hour(ts)) * 60 - minute(ts) when hour(ts) < 5 then (5 - hour(ts)) * 60 - minute(ts) end as int) as minutes_to_five from events)
where minutes_to_five is not null order by minutes_to_five, event_id limit 1""")
def night_owl(spark, sf_dir):
    return activity.night_owl(event_files(spark, sf_dir)).select(F.col("path").alias("event_id"), "minutes_to_five")


_GRID = """g as (select i // 7 as week, cast(i % 7 as int) as weekday, cast(date '2024-01-01' - cast(dayofweek(date '2024-01-01') as int) + cast(i as int) as date) as day from range(371) r(i)),
c as (select cast(ts as date) as day, count(*) as n from events group by 1),
grid as (select week, weekday, day, year(day) = 2024 as in_year, coalesce(n, 0) as files, cast(case when coalesce(n, 0) = 0 then 0 when n <= 5 then 1 when n <= 10 then 2 when n <= 100 then 3 when n <= 1000 then 4 else 5 end as int) as level from g left join c using (day))"""


@query(f"with {_GRID} select * from grid")
def calendar_grid(spark, sf_dir):
    return activity.calendar_grid(event_files(spark, sf_dir), 2024)


@query(f"with {_GRID}, w as (select week, month(min(day)) as month from grid where in_year group by 1), l as (select *, lag(month) over (order by week) as b from w) select cast(month as int) as month, week from l where (b is null or b <> month) and not (b is null and month = 12)")
def month_positions(spark, sf_dir):
    return activity.month_positions(activity.calendar_grid(event_files(spark, sf_dir), 2024))


@query(WITH + r""", r as (select *, row_number() over (partition by kind order by (regexp_matches(lower(name), '^(img_|dsc_|screenshot|screen shot|untitled)') or regexp_matches(name, '^\d+\.\w+$')), modified_at, path) as n from kfiles)
select kind, path, name, modified_at, size from r where n = 1""")
def oldest_per_kind(spark, sf_dir):
    return activity.oldest_per_kind(files(spark, sf_dir)).withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))


@query(WITH + "select path, name, size from files order by size desc, path limit 10")
def largest_files(spark, sf_dir):
    return activity.largest_files(files(spark, sf_dir))


_FOLDER_SQL = ", seg as (select *, list_filter(string_split(regexp_replace(parent_path, '^/Users/[^/]+/', ''), '/'), lambda s: s <> '') as parts from kfiles), lab as (select *, (select max(i) from range(1, len(parts) + 1) r(i) where parts[i] not in (select g from generic)) as li from seg), named as (select *, case when li is null then parts[len(parts)] when li > 1 and parts[li - 1] in (select g from generic) then parts[li - 1] || '/' || parts[li] else parts[li] end as label, coalesce(list_filter(parts, lambda p: p not in ('" + "','".join(GENERIC_FOLDERS) + "'))[1], parts[2], parts[1], 'root') as project from lab)"


@query(WITH + _FOLDER_SQL + """, m as (select month(modified_at) - 1 as month, count(*) as files from named group by 1),
f as (select month(modified_at) - 1 as month, label, count(*) as n, row_number() over (partition by month(modified_at) - 1 order by count(*) desc, label) as r from named where label not in (select g from generic) group by 1, 2),
p as (select month(modified_at) - 1 as month, path, size, parts[len(parts)] in (select g from generic) as gen from named),
q as (select *, row_number() over (partition by month order by gen, size desc, path) as r from p where size > 1024 or size = 1024 and not gen)
select cast(m.month as int) as month, m.files, f.label as folder, f.n as folder_files, q.path as file, q.size as file_size from m left join f on f.month = m.month and f.r = 1 left join q on q.month = m.month and q.r = 1""")
def month_highlights(spark, sf_dir):
    return activity.month_highlights(files(spark, sf_dir))


@query(WITH + """, c as (select month(modified_at) - 1 as month, kind, count(*) as n, row_number() over (partition by month(modified_at) - 1 order by count(*) desc, kind nulls first) as r from kfiles group by 1, 2)
select cast(month as int) as month, string_agg(kind || ': ' || n, ', ' order by r) as kinds from c where r <= 3 group by 1""")
def month_top_kinds(spark, sf_dir):
    return activity.month_top_kinds(files(spark, sf_dir))


@query(WITH + _FOLDER_SQL + f""", k as (select project, kind, count(*) as n, sum(size) as b from named group by 1, 2),
s as (select project, cast(sum(n) as bigint) as files, cast(sum(b) as bigint) as bytes from k group by 1), t as (select *, {PCT(a='files', b='(select count(*) from files)')} as percent from s order by files desc, project limit 5)
select t.*, (select kind from k where k.project = t.project order by n desc, kind nulls first limit 1) as kind from t where percent >= 5 or files >= 50""")
def project_insights(spark, sf_dir):
    return folders.project_insights(files(spark, sf_dir))


@query(WITH + _FOLDER_SQL + f""", d as (select parent_path as folder, min(label) as label, count(*) as files, cast(sum(size) as bigint) as bytes from named group by 1 order by files desc, folder limit 8),
r as (select f.*, row_number() over (partition by parent_path order by path) as r from named f where parent_path in (select folder from d)),
k as (select parent_path, kind, row_number() over (partition by parent_path order by count(*) desc, min(r)) as o from r where r <= 10 group by 1, 2),
n as (select parent_path, r, case when length(name) <= 35 then name when length(regexp_extract(name, '\\.[^.]*$')) between 1 and 9 then substring(name, 1, 32 - length(regexp_extract(name, '\\.[^.]*$'))) || '...' || regexp_extract(name, '\\.[^.]*$') else substring(name, 1, 32) || '...' end as s from r where r <= 3)
select d.*, {PCT(a='files', b='(select count(*) from files)')} as percent, (select kind from k where k.parent_path = d.folder and o = 1) as kind, (select string_agg(s, ', ' order by r) from n where n.parent_path = d.folder) as samples, {PCT(a='(select sum(files) from d)', b='(select count(*) from files)')} as covered from d""")
def hotspots(spark, sf_dir):
    return folders.hotspots(files(spark, sf_dir))


_URL_FOLDER = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', '')"
_ANC = "select p.*, '/' || array_to_string(list_filter(string_split({f}, '/'), lambda s: s <> '')[1:i], '/') as folder, i = len(list_filter(string_split({f}, '/'), lambda s: s <> '')) as own from {t} p, range(1, 40) r(i) where i <= len(list_filter(string_split({f}, '/'), lambda s: s <> ''))"


def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_URL_FOLDER).alias("at"), F.length("html").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"))


@query(f"with p as (select page_id, {_URL_FOLDER} as here, length(html) as size from pages), a as ({_ANC.format(f='here', t='p')}) select folder, cast(sum(case when own then 1 else 0 end) as bigint) as direct_files, cast(sum(case when own then size else 0 end) as bigint) as direct_bytes, count(*) as total_files, cast(sum(size) as bigint) as total_bytes, len(string_split(folder, '/')) - 1 as depth from a group by folder")
def url_tree_rollup(spark, sf_dir):
    return folders.tree_rollup(url_files(spark, sf_dir), F.col("at")).drop("latest")


@query(WITH + f", a as ({_ANC.format(f='parent_path', t='files')}) select folder, cast(sum(case when own then 1 else 0 end) as bigint) as direct_files, cast(sum(case when own then size else 0 end) as bigint) as direct_bytes, count(*) as total_files, cast(sum(size) as bigint) as total_bytes, max(modified_at) as latest, len(string_split(folder, '/')) - 1 as depth from a group by folder")
def tree_rollup(spark, sf_dir):
    return folders.tree_rollup(files(spark, sf_dir), F.col("parent_path")).withColumn("latest", F.col("latest").cast("timestamp_ntz"))


def _registered(spark: SparkSession) -> DataFrame:
    rows = [f"/Users/u{i}/{p}" for i in range(4) for p in ("Desktop", "Documents/Work", "Documents", "projects", "projects/atlas/src")]
    return spark.createDataFrame([(r,) for r in rows], "folder_path string")


_REG = ", reg(folder_path) as (select '/Users/u' || i || '/' || p from range(4) r(i), (values ('Desktop'), ('Documents/Work'), ('Documents'), ('projects'), ('projects/atlas/src')) v(p))"
_DEEP = _REG + ", deep as (select f.file_id, (select r.folder_path from reg r where f.parent_path || '/' like r.folder_path || '/%' order by length(r.folder_path) desc limit 1) as folder_path from files f)"


@query(WITH + _DEEP + " select * from deep")
def deepest_ancestor(spark, sf_dir):
    return catalog.deepest_folder(files(spark, sf_dir), _registered(spark), F.col("parent_path"), row_key="file_id")


@query(WITH + _DEEP + " select file_id from deep where folder_path is not null")
def inside_registered(spark, sf_dir):
    return catalog.inside_any(files(spark, sf_dir), _registered(spark), F.col("parent_path"), row_key="file_id").select("file_id")


@query(WITH + _DEEP + f", h as (select r.folder_path as here, count(d.file_id) as n from reg r left join deep d using (folder_path) group by 1), a as ({_ANC.format(f='here', t='h')}) select folder, bool_or(own) as registered, cast(sum(case when own then n else 0 end) as bigint) as own_files, cast(sum(n) as bigint) as all_files from a group by folder")
def registered_tree(spark, sf_dir):
    deep = catalog.deepest_folder(files(spark, sf_dir), _registered(spark), F.col("parent_path"), row_key="file_id")
    return folders.registered_tree(deep, _registered(spark))


@query(WITH + f", a as ({_ANC.format(f='parent_path', t='files')}) select folder, count(*) filter (where lower(name) like '%report%') as matched, count(*) as total from a group by folder having count(*) filter (where lower(name) like '%report%') > 0")
def filtered_tree(spark, sf_dir):
    return folders.filtered_tree(files(spark, sf_dir), F.col("parent_path"), F.lower("name").contains("report"))


@query(WITH + "select coalesce(nullif(kind, ''), 'Uncategorized') as target, count(*) as files, cast(sum(size) as bigint) as bytes from kfiles group by 1")
def moves_by_kind(spark, sf_dir):
    return folders.by_kind_moves(files(spark, sf_dir))


_EXCLUDED = r"(regexp_matches(path, '(^|/)\.') or regexp_matches(parent_path, '/(node_modules|build|\.cache|vendor|dist|target|out|bin|obj|env|venv)(/|$)') or lower(path) like '/users/u1/lib%' or lower(path) like '/users/u3/not%')"


@query(WITH + f"select file_id, kind from kfiles where not {_EXCLUDED} and kind is not null and modified_at between timestamp '1996-01-01' and timestamp '1998-12-31 23:59:59'")
def scan_filter(spark, sf_dir):
    from kelpline.sources.files import scan

    return scan(files(spark, sf_dir), custom=["/Users/u1/Lib", "\\Users\\u3\\NOT"], start=F.lit("1996-01-01").cast("timestamp"), end=F.lit("1998-12-31 23:59:59").cast("timestamp")).select("file_id", "kind")


@query(WITH + f"select count(*) as scanned, count(*) filter (where not {_EXCLUDED}) as matched, count(*) filter (where {_EXCLUDED}) as skipped from files")
def scan_counters(spark, sf_dir):
    from kelpline.sources.files import scan_counts

    return scan_counts(files(spark, sf_dir), ~paths.hidden("path") & ~paths.excluded("path", [], ["/Users/u1/Lib", "/Users/u3/not"]))


_UNIT = "case when {s} < 1024 then 0 when {s} < 1048576 then 1 when {s} < 1073741824 then 2 else 3 end"


@query(WITH + f", u as (select file_id, size, {_UNIT.format(s='size')} as k from files), v as (select *, size / power(1024, k) as v, ['B','KB','MB','GB'][k + 1] as unit from u) select file_id, case when size = 0 then '0 B' else regexp_replace(cast(round(v, 1) as varchar), '\\.0$', '') || ' ' || unit end as label, case when size <= 0 then '0 B' when v >= 10 then cast(cast(round(v) as bigint) as varchar) || ' ' || unit else cast(round(v, 1) as varchar) || ' ' || unit end as short, case when size = 0 then '0 B' when k = 0 then size || ' B' else cast(round(v, 1) as varchar) || ' ' || unit end as fixed, case when size >= 1000000 then cast(round(size / 1000000, 1) as varchar) || 'M' when size >= 1000 then cast(round(size / 1000, 1) as varchar) || 'K' else cast(size as varchar) end as count_label from v")
def size_labels(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", labels.size_label("size").alias("label"), labels.size_label_short("size").alias("short"), labels.size_label_fixed("size").alias("fixed"), labels.count_label("size").alias("count_label"))


@query(WITH + ", x as (select file_id, modified_at, epoch(timestamp '1999-06-15 12:00:00') - epoch(modified_at) as s, floor((epoch(timestamp '1999-06-15 12:00:00') - epoch(modified_at)) / 86400) as d from files) select file_id, case when d = 0 and s < 120 then 'Just now' when d = 0 and s < 3600 then cast(floor(s / 60) as int) || 'm ago' when d = 0 then cast(floor(s / 3600) as int) || 'h ago' when d = 1 then 'Yesterday' when d < 7 then cast(d as int) || ' days ago' when d < 30 then cast(floor(d / 7) as int) || 'w ago' when d < 365 then cast(floor(d / 30) as int) || 'mo ago' else strftime(modified_at, '%Y-%m-%d') end as age from x")
def relative_times(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", labels.relative_time("modified_at", F.lit("1999-06-15 12:00:00").cast("timestamp")).alias("age"))


@query(WITH + ", w(ext, kind) as (values " + ", ".join(f"('{e}', '{k}')" for k, es in labels.WORKSPACE_EXTENSIONS.items() for e in es) + ") select file_id, extension, kfiles.kind, coalesce(w.kind, 'other') as workspace_kind from kfiles left join w on w.ext = extension")
def kind_from_extension(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", "extension", "kind", labels.workspace_kind("extension").alias("workspace_kind"))


@query(WITH + _FOLDER_SQL + " select file_id, label, project from named")
def folder_names(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", paths.meaningful_folder("parent_path").alias("label"), paths.project("parent_path").alias("project"))


@query("select c_custkey as file_id, c_name as name, coalesce(n_name, 'Unknown') as location from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20")
def file_folder_left(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("folder_id"))
    return catalog.with_folder(rows, table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("label"))).select("file_id", "name", "location")


@query("""select p_partkey, case when q.k is not null then 'pending' when s_suppkey is null then 'not_indexed' when s_acctbal < 0 then 'error' when s_nationkey % 4 = 0 then 'deep' else 'fast' end as index_status
from part left join supplier on s_suppkey = p_partkey left join (select distinct l_partkey as k from lineitem where l_quantity = 50 and l_linenumber = 7) q on q.k = p_partkey""")
def index_status(spark, sf_dir):
    indexed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_acctbal") < 0, "error").otherwise("indexed").alias("status"), F.when(F.col("s_nationkey") % 4 == 0, "pdf_fine").when(F.col("s_nationkey") % 4 == 1, "pdf_fast").alias("strategy"), F.lit(None).cast("string").alias("vision"))
    queue = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey"))
    return catalog.with_index_status(table(spark, sf_dir, "part").select("p_partkey"), indexed, queue, "p_partkey").select("p_partkey", "index_status")


_ITEMS = "select s_suppkey as id, s_name as name, s_nationkey as nation from supplier where s_suppkey % 3 = 0"


@query(f"with i as ({_ITEMS}) select c_custkey from customer where exists (select 1 from i where i.id = c_custkey or i.nation * 7 = c_custkey or replace(i.name, 'Supplier', 'Customer') = c_name)")
def disjunctive_semi(spark, sf_dir):
    items = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    keys = [(F.col("c_custkey"), F.col("s_suppkey")), (F.col("c_custkey"), F.col("s_nationkey").cast("long") * 7), (F.col("c_name"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))]
    return catalog.matches_any(table(spark, sf_dir, "customer"), items, keys, "c_custkey").select("c_custkey")


@query(WITH + """, h as (select folder_id, count(*) as files from files group by 1), q as (select o_orderkey % 31 as folder_id, count(*) as queued from orders where o_orderstatus = 'P' group by 1), k(folder_id) as (select * from range(20))
select folder_id, coalesce(files, 0) as files, coalesce(queued, 0) as queued, k.folder_id is not null as known from k full join h using (folder_id) left join q using (folder_id)""".replace("k.folder_id is not null as known", "folder_id in (select folder_id from k) as known"))
def folder_counters(spark, sf_dir):
    queue = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 31).alias("folder_id"))
    return catalog.folder_counters(files(spark, sf_dir), queue, spark.range(20).withColumnRenamed("id", "folder_id"))


@query(WITH + "select folder_id, count(*) as total, count(*) filter (where coalesce(status, 'indexed') = 'indexed') as indexed, count(*) filter (where status = 'error') as errors, count(*) filter (where status = 'pending') as pending, least(cast(floor(100.0 * count(*) filter (where coalesce(status, 'indexed') = 'indexed') / count(*) + 0.5) as bigint), 100) as percent from files group by 1")
def folder_progress(spark, sf_dir):
    return catalog.folder_progress(files(spark, sf_dir))


@query("""with i as (select cast(l_partkey as varchar) as path, l_orderkey * 10 + l_linenumber as seq, l_suppkey, case l_linestatus when 'O' then 'pending' else case when l_returnflag = 'R' then 'processing' else 'done' end end as status from lineitem),
f as (select path, status as first, row_number() over (partition by path order by seq, status) as n, bool_or(status = 'processing') over (partition by path) as p from i)
select path, case when first = 'pending' and p then 'processing' else first end as status from f where n = 1""")
def queue_status(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "R", "processing").otherwise("done").alias("status"))
    return catalog.queue_status(items)


@query("select s_suppkey as k, 'added' as change from supplier where s_suppkey not in (select n_nationkey * 2 from nation) union all select n_nationkey * 2, 'removed' from nation where n_nationkey * 2 not in (select s_suppkey from supplier)")
def config_sync(spark, sf_dir):
    return catalog.sync_config(table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 2).alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query(WITH + ", c(category) as (values ('document'), ('image'), ('video'), ('audio'), ('archive'), ('book')) select category, count(k.file_id) as files, cast(coalesce(sum(size), 0) as bigint) as bytes from c left join kfiles k on k.kind = c.category group by 1 union all select 'all', count(*), cast(sum(size) as bigint) from files")
def category_totals(spark, sf_dir):
    return catalog.category_totals(files(spark, sf_dir), ["document", "image", "video", "audio", "archive", "book"])


_CODES = "select p_size % 4 - 1 as fast_stage, p_partkey % 3 - 1 as deep_stage from part"


@query(f"with s as ({_CODES}) select count(*) as total, " + ", ".join(f"count(*) filter (where {c} >= {m}) as {n}_done, count(*) filter (where {c} = -1) as {n}_error, count(*) filter (where {c} between 0 and {m - 1}) as {n}_pending, cast(floor(100.0 * count(*) filter (where {c} >= {m}) / count(*) + 0.5) as bigint) as {n}_percent" for n, c, m in (("text", "fast_stage", 1), ("embed", "fast_stage", 2), ("deep", "deep_stage", 1))) + " from s")
def stage_counts(spark, sf_dir):
    return catalog.stage_counts(table(spark, sf_dir, "part").select((F.col("p_size") % 4 - 1).alias("fast_stage"), (F.col("p_partkey") % 3 - 1).alias("deep_stage")))


@query(WITH + "select file_id, row_number() over (order by (folder_id = 3) desc, case when status = 'error' then 0 when status = 'pending' then 1 else 2 end, name, file_id) as place from files order by place limit 500")
def status_sort(spark, sf_dir):
    from pyspark.sql import Window

    top = files(spark, sf_dir).orderBy(*catalog.status_order(F.col("folder_id") == 3, F.col("status")), "name", "file_id").limit(500)
    order = [*catalog.status_order(F.col("folder_id") == 3, F.col("status")), F.col("name"), F.col("file_id")]
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("file_id", "place")  # the 500 listed rows


@query(WITH + "select file_id from files order by (file_id = 77) desc, modified_at desc, file_id limit 30")
def pinned_page(spark, sf_dir):
    return catalog.pinned_page(files(spark, sf_dir), F.col("file_id") == 77, [F.desc("modified_at"), F.col("file_id")]).select("file_id")


@query(WITH + "select file_id, name from files order by name, file_id limit 500 offset 500")
def paged_listing(spark, sf_dir):
    return files(spark, sf_dir).orderBy("name", "file_id").offset(500).limit(500).select("file_id", "name")


@query("select event_id from events where ts >= timestamp '2024-01-30' - interval 7 day")
def last_week(spark, sf_dir):
    return event_files(spark, sf_dir).where(activity.in_last_days("modified_at", 7, F.lit("2024-01-30").cast("timestamp"))).select(F.col("path").alias("event_id"))


@query("select date_trunc('minute', ts) as start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def minute_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return jobs.minute_counts(rows, ("event_type",)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 5 <> 0 union all select o_orderkey, 0.0 from orders where o_orderkey % 5 = 0")
def upsert_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return catalog.upsert(rows, rows.where("k % 5 = 0").withColumn("v", F.lit(0.0)), "k")
