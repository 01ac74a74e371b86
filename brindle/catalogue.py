"""The operators as queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import scalars
from brindle.functions import semantics as S
from brindle.ml import custom, series, training
from brindle.ml.trainers import spec
from brindle.operators import aggregates, completions, evaluate, features, imaging, joins, profile, scripts, transforms
from brindle.plans.compiler import compile_graph
from brindle.plans.graph import Graph
from brindle.sources import catalogue as workspace
from brindle.sources import arrays, readers, scratch
from brindle.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives its rows."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose zero tax is a gap, with a text flag that has gaps too."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr("nullif(l_tax, 0)").alias("l_tax"), F.expr("case when l_linenumber = 2 then null when l_linenumber = 3 then '' else l_returnflag end").alias("flag"))
    return li


_GAPS = "(select l_orderkey, l_linenumber, l_quantity, nullif(l_tax, 0) as l_tax, case when l_linenumber = 2 then null when l_linenumber = 3 then '' else l_returnflag end as flag from lineitem)"


# ---- flagship: a graph compiled to one plan ------------------------------------------------------------------------


def flagship_graph() -> Graph:
    g = Graph()
    items, orders = g.add("data.dataset", datasetId="lineitem"), g.add("data.dataset", datasetId="orders")
    large = g.add("tf.filterRows", column="l_quantity", op="gt", value="20")
    joined = g.add("tf.join", leftKey="l_orderkey", rightKey="o_orderkey", kind="inner")
    grouped = g.add("tf.groupBy", groupBy="o_orderpriority", aggregateColumn="l_extendedprice", aggregate="sum")
    g.connect(items, large)
    g.connect(large, joined, target_port=0)
    g.connect(orders, joined, target_port=1)
    g.connect(joined, grouped)
    return g


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = flagship_graph()
    out = compile_graph(spark, g, tables=lambda name: _t(spark, sf_dir, name))
    return out[g.ordered()[-1].id, 0].select("o_orderpriority", F.round("sum_l_extendedprice", 2).alias("revenue"))


@query("select o_orderpriority, round(sum(l_extendedprice), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 20 group by 1")
def graph_revenue_by_priority(spark, d):
    return flagship(spark, d)


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query("select n_nationkey, n_name, n_regionkey from nation")
def s8_parquet_scan(spark, d):
    return readers.read_parquet(spark, f"{d}/nation.parquet")


@query("select c_custkey::double as c_custkey, c_name, c_nationkey::double as c_nationkey, c_acctbal, c_mktsegment from customer")
def s5_csv_round_trip(spark, d):
    path = scratch.folder(spark)
    workspace.write(_t(spark, d, "customer"), path, "Csv")
    return readers.read_delimited(spark, path, ",", multi_line=False).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("select s_suppkey::double as s_suppkey, s_name, s_acctbal from supplier")
def s5_tsv_round_trip(spark, d):
    path = scratch.folder(spark)
    workspace.write(_t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "Tsv")
    return readers.read_delimited(spark, path, "\t", multi_line=False).select("s_suppkey", "s_name", "s_acctbal")


@query("select p_partkey, p_name, p_size, p_retailprice from part")
def s7_json_lines_round_trip(spark, d):
    path = scratch.folder(spark)
    part = _t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    workspace.write(part, path, "Json")
    return readers.read_json(spark, path, infer=False, lines=True).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


def _nation_csv(spark, d) -> str:
    """The 25 nations as text, in the form that a user types or a server sends."""
    rows = _t(spark, d, "nation").orderBy("n_nationkey").collect()
    return "n_name,share\n" + "".join(f" {r.n_name} ,{r.n_nationkey / 4 if r.n_regionkey else ''}\n" for r in rows)


@query("select doc_id, text, lang, source, n_chars from documents")
def s7_split_json_array(spark, d):
    """All documents written as one JSON array by many tasks, and read back by many."""
    path = scratch.folder(spark)
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    arrays.write_array(docs, path)
    return readers.read_json_array(spark, path, infer=False).select("doc_id", "text", "lang", "source", F.col("n_chars").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


@query("select n_name, case when n_regionkey <> 0 then n_nationkey / 4.0::double end as share from nation")
def s4_inline_rows(spark, d):
    return readers.inline_csv(spark, _nation_csv(spark, d))


@query("select n_nationkey::double as a, case when n_regionkey = 1 then n_name end as b, case when n_regionkey <> 1 then n_regionkey::double end as c from nation")
def s6_wrapped_json(spark, d):
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.when(F.col("n_regionkey") == 1, F.col("n_name")).alias("b"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("c"))
    array = workspace.to_json_array(nation).first().json
    return readers.from_json_text(spark, f'{{"items": {array[:-1]}, 7]}}').select("a", "b", "c")


@query("select c_mktsegment, count(*) as customers from customer where c_acctbal > 0 group by 1")
def s2_sql_over_views(spark, d):
    _t(spark, d, "customer").createOrReplaceTempView("brindle_customer")
    return readers.read_sql(spark, "select c_mktsegment, count(*) as customers from brindle_customer where c_acctbal > 0 group by 1")


@query("select n_name, case when n_regionkey <> 0 then n_nationkey / 4.0::double end as share from nation")
def s3_web_csv(spark, d):
    return readers.read_web(spark, "https://example.org/rows.csv", "Csv", "Accept: text/csv", get=lambda url, headers: _nation_csv(spark, d))


@query("select 'first' as name, 25 as n_rows union all select 'second', 5")
def s10_k1_import_and_catalogue(spark, d):
    w = workspace.Workspace(spark, scratch.folder(spark))
    w.save_dataset(_t(spark, d, "nation"), "first", "Parquet", "Imported")
    w.save_dataset(_t(spark, d, "region"), "second", "Csv")
    return w.list_datasets().select("name", F.col("rows").cast("int").alias("n_rows"))


# ---- projection, cleaning, filters ---------------------------------------------------------------------------------


@query("select l_orderkey, l_quantity, l_shipdate from lineitem")
def t1_select_keep(spark, d):
    return transforms.select_columns(_t(spark, d, "lineitem"), ["L_SHIPDATE", "l_orderkey", "l_quantity", "nothing"])


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def t1_select_drop(spark, d):
    return transforms.select_columns(_t(spark, d, "orders"), ["o_orderstatus", "o_orderdate", "O_ORDERPRIORITY"], "drop")


@query("select l_orderkey, l_linenumber, l_quantity::varchar as q from (select l_orderkey, l_linenumber, l_quantity::bigint as l_quantity from lineitem)")
def t2_rename_and_render(spark, d):
    return transforms.edit_metadata(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "q", "Text")


@query("select event_id, try_cast(props->>'k' as double) as k from events")
def t2_cast_number(spark, d):
    events = _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"))
    return transforms.edit_metadata(events, "raw", "k", "Numeric")


@query("select event_id, case when trim(v) = '' then null else lower(trim(v)) = 'true' or trim(v) in ('1', 'yes', 'ya') end as v from (select event_id, case event_id % 7 when 0 then 'TRUE' when 1 then 'ya' when 2 then 'tidak' when 3 then '' when 4 then '1' when 5 then 'YES' else ' yes ' end as v from events)")
def t2a_coerce_boolean(spark, d):
    events = _t(spark, d, "events").select("event_id", F.expr("case event_id % 7 when 0 then 'TRUE' when 1 then 'ya' when 2 then 'tidak' when 3 then '' when 4 then '1' when 5 then 'YES' else ' yes ' end").alias("v"))
    return transforms.edit_metadata(events, "v", None, "Boolean")


@query(f"select * from {_GAPS} where l_tax is not null and flag is not null and trim(flag) <> ''")
def t3a_drop_rows(spark, d):
    return transforms.clean_missing(_gaps(spark, d), ["l_tax", "flag"], "dropRow")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def t3b_drop_columns(spark, d):
    return transforms.clean_missing(_gaps(spark, d), None, "dropColumn")


@query(f"select l_orderkey, l_linenumber, round(coalesce(l_tax, (select avg(l_tax) from {_GAPS})), 8) as l_tax from {_GAPS}")
def t3c_fill_mean(spark, d):
    return transforms.clean_missing(_gaps(spark, d), ["l_tax"], "mean").select("l_orderkey", "l_linenumber", F.round("l_tax", 8).alias("l_tax"))


@query(f"select l_orderkey, l_linenumber, coalesce(l_tax, (select percentile_disc(0.5) within group (order by l_tax desc) from {_GAPS})) as l_tax from {_GAPS}")
def t3d_fill_median(spark, d):
    return transforms.clean_missing(_gaps(spark, d), ["l_tax"], "median").select("l_orderkey", "l_linenumber", "l_tax")


@query(f"select l_orderkey, l_linenumber, case when flag is null or trim(flag) = '' then (select flag from {_GAPS} where trim(flag) <> '' group by flag order by count(*) desc, min((l_orderkey, l_linenumber)) limit 1) else flag end as flag from {_GAPS}")
def t3e_fill_mode(spark, d):
    return transforms.clean_missing(_gaps(spark, d), ["flag"], "mode", order=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "flag")


@query(f"select l_orderkey, l_linenumber, case when flag is null or trim(flag) = '' then 'none' else flag end as flag from {_GAPS}")
def t3f_fill_constant(spark, d):
    return transforms.clean_missing(_gaps(spark, d), ["flag"], "constant", "none").select("l_orderkey", "l_linenumber", "flag")


@query("select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events) where k = 1")
def t4_duplicates_first(spark, d):
    return transforms.remove_duplicates(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "first", "event_id")


@query("select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from events) where k = 1")
def t4_duplicates_last(spark, d):
    return transforms.remove_duplicates(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "last", "event_id")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def t4_duplicates_all_columns(spark, d):
    return transforms.remove_duplicates(_t(spark, d, "lineitem").select("l_returnflag", "l_linestatus"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45")
def t5_filter_gte(spark, d):
    return transforms.filter_rows(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "L_QUANTITY", "gte", "45")


@query("select l_orderkey, l_linenumber, l_discount from lineitem where abs(l_discount - 0.05) < 1e-9")
def t5a_filter_equal_number(spark, d):
    return transforms.filter_rows(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", "eq", "0.05")


@query("select o_orderkey, o_orderpriority from orders where lower(o_orderpriority) = '1-urgent'")
def t5b_filter_equal_text(spark, d):
    return transforms.filter_rows(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "eq", "1-Urgent")


@query("select doc_id, source from documents where contains(lower(text), 'licensed under')")
def t5b_filter_contains(spark, d):
    return transforms.filter_rows(_t(spark, d, "documents").select("doc_id", "source", "text"), "text", "contains", "LICENSED under").drop("text")


@query(f"select l_orderkey, l_linenumber, flag from {_GAPS} where coalesce(lower(flag), '') <> 'r'")
def t5c_not_equal_keeps_gaps(spark, d):
    return transforms.filter_rows(_gaps(spark, d), "flag", "ne", "R").select("l_orderkey", "l_linenumber", "flag")


@query(f"select l_orderkey, l_linenumber, flag from {_GAPS} where flag is not null and trim(flag) <> ''")
def t5_filter_not_empty(spark, d):
    return transforms.filter_rows(_gaps(spark, d), "flag", "notEmpty").select("l_orderkey", "l_linenumber", "flag")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by md5(concat('42-', o_orderkey)), o_orderkey) as k from orders) where k <= (select round_even(count(*) * 0.8, 0) from orders)")
def t6_split_first_part(spark, d):
    return transforms.split_data(_t(spark, d, "orders"), 0.8, ids=["o_orderkey"])[0].select("o_orderkey")


@query("select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by md5(concat('7-', o_orderkey)), o_orderkey) as k, count(*) over (partition by o_orderpriority) as n from orders) where k > round_even(n * 0.75, 0)")
def t6_split_stratified_rest(spark, d):
    return transforms.split_data(_t(spark, d, "orders"), 0.75, "o_orderpriority", 7, ["o_orderkey"])[1].select("o_orderkey", "o_orderpriority")


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice, c_name, c_acctbal from orders join customer on o_custkey = c_custkey")
def j1_inner_join(spark, d):
    return joins.join(_t(spark, d, "orders"), _t(spark, d, "customer"), "o_custkey", "C_CUSTKEY").select("o_orderkey", "o_totalprice", "c_name", "c_acctbal")


@query("select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 150000) on c_custkey = o_custkey")
def j1_left_join(spark, d):
    return joins.join(_t(spark, d, "customer"), _t(spark, d, "orders").where("o_totalprice > 150000"), "c_custkey", "o_custkey", "left").select("c_custkey", "o_orderkey")


@query("select coalesce(c_custkey, o_custkey) as c_custkey, c_name, o_orderkey from (select * from customer where c_acctbal > 0) full join (select * from orders where o_orderpriority = '1-URGENT') on c_custkey = o_custkey")
def j1c_full_join(spark, d):
    return joins.join(_t(spark, d, "customer").where("c_acctbal > 0"), _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey", "full").select("c_custkey", "c_name", "o_orderkey")


@query(f"select l_orderkey, l_linenumber, x.flag, label from {_GAPS} x join (select '' as f, 'blank' as label union all select 'R', 'returned' union all select null, 'null') y on coalesce(x.flag, '') = coalesce(y.f, '')")
def j1a_null_and_empty_match(spark, d):
    labels = spark.createDataFrame([("", "blank"), ("R", "returned"), (None, "null")], "f string, label string")
    return joins.join(_gaps(spark, d), labels, "flag", "f").select("l_orderkey", "l_linenumber", "flag", "label")


@query("select a.n_nationkey, a.n_name, b.n_name as n_name_2, b.n_regionkey as n_regionkey_2 from nation a join nation b on a.n_regionkey = b.n_nationkey")
def j1b_clashing_names(spark, d):
    n = _t(spark, d, "nation")
    return joins.join(n, n, "n_regionkey", "n_nationkey").select("n_nationkey", "n_name", "n_name_2", "n_regionkey_2")


@query("select n_name, s_suppkey from nation join supplier on n_nationkey::varchar = s_nationkey::bigint::varchar")
def j1a_keys_as_text(spark, d):
    supplier = _t(spark, d, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double"))
    return joins.join(_t(spark, d, "nation"), supplier, "n_nationkey", "s_nationkey").select("n_name", "s_suppkey")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def x_semi_join(spark, d):
    return joins.join(_t(spark, d, "customer"), _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def x_anti_join(spark, d):
    return joins.join(_t(spark, d, "customer"), _t(spark, d, "orders"), "c_custkey", "o_custkey", "left_anti").select("c_custkey", "c_name")


@query("select a.event_id, b.value as value_asof from (select event_id, user_id, ts from events where event_type = 'purchase') a asof left join (select user_id, ts, max(value) as value from events where event_type = 'click' group by 1, 2) b on a.user_id = b.user_id and a.ts >= b.ts")
def x_as_of_join(spark, d):
    e = _t(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["value"]).select("event_id", "value_asof")


# ---- aggregates and profiles ---------------------------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as mean_l_extendedprice from lineitem group by all")
def a1_group_mean(spark, d):
    return aggregates.group_by(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "mean").withColumn("mean_l_extendedprice", F.round("mean_l_extendedprice", 4))


@query(f"select coalesce(flag, '') as flag, round(coalesce(sum(l_tax), 0), 4) as sum_l_tax from {_GAPS} group by 1")
def a1a_group_sum_merges_gaps(spark, d):
    return aggregates.group_by(_gaps(spark, d), ["flag"], "l_tax", "sum").withColumn("sum_l_tax", F.round("sum_l_tax", 4))


@query("select o_orderpriority, min(o_totalprice) as min_o_totalprice from orders group by 1")
def a1_group_min(spark, d):
    return aggregates.group_by(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "min")


@query("select c_mktsegment, c_nationkey, max(c_acctbal) as max_c_acctbal from customer group by all")
def a1_group_max(spark, d):
    return aggregates.group_by(_t(spark, d, "customer"), ["c_mktsegment", "C_NationKey"], "c_acctbal", "max")


@query("select user_id, count(*) as count from events group by 1")
def a1_group_count(spark, d):
    return aggregates.group_by(_t(spark, d, "events"), ["user_id", "no such column"], None, "count")


@query(f"with c as (select case when flag is null or trim(flag) = '' then '(empty)' else lower(flag) end as value, count(*) as count from {_GAPS} group by 1) select value, count, (select count(*) from c) as distinct, (select sum(count)::bigint from c) as total from c order by count desc, value limit 40")
def a2_value_counts(spark, d):
    return aggregates.value_counts(_gaps(spark, d), "flag")


@query("with v as (select doc_id, unnest([doc_id::double, n_chars::double, 7.5]) as x from documents) select doc_id, count(*)::int as count, round(avg(x), 6) as mean, percentile_disc(0.5) within group (order by x desc) as median, min(x) as min, max(x) as max, round(stddev_samp(x), 6) as std_dev from v group by 1")
def a3_list_statistics(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat_ws(", ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.lit("x;7.5")).alias("numbers"))
    return aggregates.list_statistics(docs, "numbers").drop("numbers").withColumns({"mean": F.round("mean", 6), "std_dev": F.round("std_dev", 6)})


@query("select metric, count(*) as runs from (select unnest(json_keys(props)) as metric from events) group by 1")
def a4_metric_frequency(spark, d):
    return aggregates.metric_frequency(_t(spark, d, "events"), "props")


@query("select user_id, coalesce(round_even(avg(value), 1), 0) as avg_rating, count(value) as ratings from events group by 1")
def a5_average_rating(spark, d):
    return aggregates.average_rating(_t(spark, d, "events"), "user_id", "value")


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_l_quantity, grouping_id(l_returnflag, l_linestatus)::bigint as level from lineitem group by rollup (l_returnflag, l_linestatus)")
def x_rollup(spark, d):
    return aggregates.rollup(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("select c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) as sum_c_acctbal, grouping_id(c_mktsegment, c_nationkey)::bigint as level from customer group by cube (c_mktsegment, c_nationkey)")
def x_cube(spark, d):
    return aggregates.cube(_t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal").withColumn("sum_c_acctbal", F.round("sum_c_acctbal", 2))


def _profile_sql(column: str, number: str | None, source: str) -> str:
    stats = f"min({number}) as min, max({number}) as max, round(avg({number}), 6) as mean, percentile_disc(0.5) within group (order by {number} desc) as median, round(coalesce(stddev_samp({number}), 0), 6) as std_dev" if number else "null::double as min, null::double as max, null::double as mean, null::double as median, null::double as std_dev"
    return f"select '{column}' as \"column\", count(*) filter (where {column} is null or trim({column}::varchar) = '') as missing, count(distinct case when trim({column}::varchar) <> '' then lower({column}::varchar) end) as distinct, {stats} from {source}"


@query(" union all ".join([_profile_sql("l_quantity", "l_quantity", _GAPS), _profile_sql("l_tax", "l_tax", _GAPS), _profile_sql("flag", None, _GAPS)]))
def p1_profile(spark, d):
    return profile.profile(_gaps(spark, d), ["l_quantity", "l_tax", "flag"]).withColumns({"mean": F.round("mean", 6), "std_dev": F.round("std_dev", 6)})


@query("select * from (select \"column\", value, count, row_number() over (partition by \"column\" order by count desc, value)::int as rank from (select 'p_brand' as \"column\", lower(p_brand) as value, count(*) as count from part group by 2 union all select 'p_type', lower(p_type), count(*) from part group by 2)) where rank <= 8")
def p1_top_values(spark, d):
    return profile.top_values(_t(spark, d, "part"), ["p_brand", "p_type"])


@query("with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem), b as (select least(11, floor((l_extendedprice - lo) / ((hi - lo) / 12.0)))::int as bin, lo, hi from lineitem, e) select bin, round(lo + bin * ((hi - lo) / 12.0), 4) as \"from\", round(lo + (bin + 1) * ((hi - lo) / 12.0), 4) as \"to\", count(*) as count from b group by bin, lo, hi")
def p2_histogram(spark, d):
    return profile.histogram(_t(spark, d, "lineitem"), "l_extendedprice").withColumns({"from": F.round("from", 4), "to": F.round("to", 4)})


@query("select * from (values ('c_custkey', 'Numeric'), ('c_name', 'Text'), ('c_nationkey', 'Numeric'), ('c_acctbal', 'Numeric'), ('c_mktsegment', 'Categorical')) t(\"column\", logical)")
def p3_inferred_types(spark, d):
    return profile.inferred_types(_t(spark, d, "customer"))


# ---- features ------------------------------------------------------------------------------------------------------


@query("with e as (select min(l_quantity) as lo, max(l_quantity) as hi, min(l_tax) as tlo, max(l_tax) as thi from lineitem) select l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 8) as l_quantity, round((l_tax - tlo) / (thi - tlo), 8) as l_tax from lineitem, e")
def f1a_min_max(spark, d):
    out = features.normalize(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], "minmax")
    return out.withColumns({"l_quantity": F.round("l_quantity", 8), "l_tax": F.round("l_tax", 8)})


@query("with e as (select avg(c_acctbal) as m, stddev_samp(c_acctbal) as s from customer) select c_custkey, round((c_acctbal - m) / s, 6) as c_acctbal from customer, e")
def f1b_z_score(spark, d):
    return features.normalize(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "zscore").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("select o_orderkey, round(ln(greatest(o_totalprice, 1e-9) + 1), 8) as o_totalprice from orders")
def f1c_log_scale(spark, d):
    return features.normalize(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "logscale").withColumn("o_totalprice", F.round("o_totalprice", 8))


@query("with e as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part) select p_partkey, least(9, trunc((p_retailprice - lo) / ((hi - lo) / 10.0)))::double as p_retailprice from part, e")
def f1d_binning(spark, d):
    return features.normalize(_t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "binning")


@query("select o_orderkey, (lower(o_orderstatus) = 'f')::int::double as \"o_orderstatus_F\", (lower(o_orderstatus) = 'o')::int::double as \"o_orderstatus_O\", (lower(o_orderstatus) = 'p')::int::double as \"o_orderstatus_P\" from orders")
def f2a_one_hot(spark, d):
    return features.one_hot(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("select c_custkey, (dense_rank() over (order by lower(c_mktsegment)) - 1)::double as c_mktsegment from customer")
def f2b_ordinal(spark, d):
    return features.one_hot(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "ordinal")


@query()
def f2c_hash_buckets(spark, d):
    return features.one_hot(_t(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"], "hash", 8)


_STOP = ", ".join(f"'{w}'" for w in scalars.STOP_WORDS)
_WORDS = f"select item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r.,;:!?\"()\\-/]+'), lambda x: x <> '' and x not in ({_STOP})) as w from benchmark"


@query(f"with d as ({_WORDS}), t as (select unnest(w) as term from d union all select unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) from d) select term, count(*) as n from t group by 1 having count(*) > 1 order by n desc, term limit 512")
def f3_text_vocabulary(spark, d):
    return features.vocabulary(_t(spark, d, "benchmark"), "text").select("term", "n")


@query()
def f3_featurize_text(spark, d):
    return features.featurize_text(_t(spark, d, "benchmark"), "text").select("item_id", "TextFeatures")


_NUMBERS = "(select l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::double as l_linenumber, 1.0::double as one from lineitem)"


def _numbers(spark, d):
    return _t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"), F.lit(1.0).alias("one"))


@query(f"select 'l_quantity' as feature, round(abs(corr(l_quantity, l_extendedprice)), 6) as score from {_NUMBERS} union all select 'l_discount', round(abs(corr(l_discount, l_extendedprice)), 6) from {_NUMBERS} union all select 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6) from {_NUMBERS} union all select 'l_linenumber', round(abs(corr(l_linenumber, l_extendedprice)), 6) from {_NUMBERS} union all select 'one', 0.0")
def f4a_correlation_scores(spark, d):
    return features.feature_scores(_numbers(spark, d), "l_extendedprice").withColumn("score", F.round("score", 6))


def _mutual_sql(column: str) -> str:
    b = lambda c: f"least(9, floor(({c} - min({c}) over ()) / ((max({c}) over () - min({c}) over ()) / 10.0)))::int"
    return f"select '{column}' as feature, round(sum(n / t * log2(n * t / (na * nb))), 6) as score from (select n::double as n, sum(n) over ()::double as t, sum(n) over (partition by a)::double as na, sum(n) over (partition by b)::double as nb from (select a, b, count(*) as n from (select {b(column)} as a, {b('l_extendedprice')} as b from lineitem) group by all))"


@query(" union all ".join([_mutual_sql("l_quantity"), _mutual_sql("l_discount")]))
def f4b_mutual_information(spark, d):
    return features.feature_scores(_t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), "l_extendedprice", "mutualInformation").withColumn("score", F.round("score", 6))


@query("select 'p_size' as feature, round(var_samp(p_size), 6) as score from part union all select 'p_partkey', round(var_samp(p_partkey), 6) from part")
def f4c_variance(spark, d):
    return features.feature_scores(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "variance").withColumn("score", F.round("score", 6))


@query("select p_partkey, p_retailprice from part")
def f4_select_best_feature(spark, d):
    return features.select_features(_t(spark, d, "part"), "p_retailprice", "variance", top=1)[0]


# ---- evaluation ----------------------------------------------------------------------------------------------------

_SCORED = "(select l.doc_id, l.quality as label, (d.n_chars % 1000 >= 100)::int as predicted, (d.n_chars % 100) / 100.0 as probability from labels l join documents d using (doc_id))"


def _scored(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 1000 >= 100).cast("int").alias("predicted"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("probability"))


@query(f"with c as (select count(*) filter (where label = 1 and predicted = 1) as tp, count(*) filter (where label = 0 and predicted = 1) as fp, count(*) filter (where label = 0 and predicted = 0) as tn, count(*) filter (where label = 1 and predicted = 0) as fn from {_SCORED}) select tp, fp, tn, fn, round((tp + tn)::double / (tp + fp + tn + fn), 8) as accuracy, round(tp::double / (tp + fp), 8) as precision, round(tp::double / (tp + fn), 8) as recall, round(2.0 * tp / (2 * tp + fp + fn), 8) as f1, round(tn::double / (tn + fp), 8) as specificity from c")
def e9_binary_metrics(spark, d):
    m = evaluate.binary_metrics(_scored(spark, d), "label", "predicted")
    return m.withColumns({c: F.round(c, 8) for c in ("accuracy", "precision", "recall", "f1", "specificity")})


@query(f"with s as {_SCORED}, r as (select label, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0 as k from s) select round((sum(k) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0) / (count(*) filter (where label = 1)::double * count(*) filter (where label = 0)), 8) as auc from r")
def e10_auc(spark, d):
    return evaluate.auc(_scored(spark, d), "label", "probability").select(F.round("auc", 8).alias("auc"))


@query(f"with s as (select *, row_number() over w as k, sum(label) over (w rows unbounded preceding) as tp, count(*) over () as n, sum(label) over () as pos from {_SCORED} window w as (order by probability desc, doc_id)) select round((k - tp)::double / (n - pos), 8) as fpr, round(tp::double / pos, 8) as tpr, probability as threshold from s where (k - 1) % greatest(1, n // 100) = 0 or k = n union all select 0, 0, 1 union all select 1, 1, 0")
def e11_roc_points(spark, d):
    out = evaluate.roc_points(_scored(spark, d), "label", "probability", order="doc_id")
    return out.withColumns({"fpr": F.round("fpr", 8), "tpr": F.round("tpr", 8)})


_LANGS = "(select lang, case when n_chars % 4 = 0 then 'en' else lang end as guess from documents)"


@query(f"select lower(lang) as actual, lower(guess) as predicted, count(*) as count from {_LANGS} group by all")
def e12_class_confusion(spark, d):
    docs = _t(spark, d, "documents").select("lang", F.expr("case when n_chars % 4 = 0 then 'en' else lang end").alias("guess"))
    return evaluate.class_confusion(docs, "lang", "guess")


@query(f"select round(avg((lang = guess)::int), 8) as micro_accuracy, (select round(avg(r), 8) from (select avg((lang = guess)::int) as r from {_LANGS} group by lang)) as macro_accuracy, (select count(distinct lang) from documents) as classes from {_LANGS}")
def e12_multiclass_metrics(spark, d):
    docs = _t(spark, d, "documents").select("lang", F.expr("case when n_chars % 4 = 0 then 'en' else lang end").alias("guess"))
    return evaluate.multiclass_metrics(docs, "lang", "guess").withColumns({c: F.round(c, 8) for c in ("micro_accuracy", "macro_accuracy")})


@query("with s as (select l_extendedprice as y, l_quantity * 1500 as p from lineitem) select round(avg(abs(y - p)), 4) as mae, round(avg((y - p) ** 2), 2) as mse, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) as r2 from s")
def e13_regression_metrics(spark, d):
    li = _t(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    m = evaluate.regression_metrics(li, "l_extendedprice", "guess")
    return m.withColumns({"mae": F.round("mae", 4), "mse": F.round("mse", 2), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query("with s as (select label, count(*) as n from embeddings group by 1) select count(*) as clusters, max(n) as largest, min(n) as smallest, round(min(n)::double / max(n), 8) as balance from s")
def e14_clustering_metrics(spark, d):
    return evaluate.clustering_metrics(_t(spark, d, "embeddings"), "label").withColumn("balance", F.round("balance", 8))


@query("with s as (select value as v, row_number() over (order by value) - 1 as k, count(*) over () as n from events), p as (select v as p95 from s where k = floor(n * 0.95)) select round(avg(v), 6) as mean, max(v) as max, any_value(p95) as p95, count(*) filter (where v >= p95) as above_p95 from s, p")
def e15_anomaly_metrics(spark, d):
    return evaluate.anomaly_metrics(_t(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("with s as (select o_totalprice as actual, o_custkey * 100.0::double as predicted, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders) select actual, predicted from s where k % greatest(1, n // 500) = 0")
def e13_residual_sample(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") * F.lit(100.0)).alias("guess"))
    return evaluate.residual_sample(o, "o_totalprice", "guess", "o_orderkey")


# ---- language-model columns and scripts ----------------------------------------------------------------------------


def _echo(system: str, user: str, provider: str, temperature: float) -> str:
    """A client that answers each numbered input with its length: deterministic, for tests."""
    import json
    import re

    lines = re.findall(r"^\d+\. (.*)$", user, re.M)
    return "```json\n" + json.dumps([{"Category": "long" if len(x) > 25 else "short"} for x in lines]) + "\n```"


@query("select conv_id, turn, role || ' said: ' || text || ' ({{missing}})' as prompt from conversations")
def l6_rendered_prompts(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", completions.rendered_prompts(c, completions.prompt("{{role}} said: {{text}} ({{missing}})")).alias("prompt"))


@query("select p_partkey, case when length(p_name) > 25 then 'long' else 'short' end as \"Category\" from part")
def l4_classified_in_batches(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    return completions.apply(part, completions.classify("p_name", categories="long\nshort"), _echo).select("p_partkey", "Category")


def _replies(answer: Callable[[str], dict]):
    """A client that gives each numbered input its own answer: deterministic, for tests."""

    def client(system: str, user: str, provider: str, temperature: float) -> str:
        import json
        import re

        return json.dumps([answer(x) for x in re.findall(r"^\d+\. (.*)$", user, re.M)])

    return client


@query("select p_partkey, case when row_number() over (order by p_partkey) <= 10 then case when length(p_name) > 25 then 'long' else 'short' end end as \"Category\" from part")
def l0_first_rows_only(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    return completions.apply(part, completions.classify("p_name", categories="long\nshort"), _echo, completions.Settings(max_rows=10), "p_partkey").select("p_partkey", "Category")


@query("select c_custkey, lower(c_mktsegment) as segment from customer")
def l1_reformatted(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return completions.apply(c, completions.reformat("c_mktsegment", "segment", "lower case"), _replies(lambda x: {"segment": x.lower()})).select("c_custkey", "segment")


@query("select p_partkey, upper(p_name) as p_name from part")
def l2_cleansed_in_place(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    return completions.apply(part, completions.cleanse("p_name"), _replies(lambda x: {"p_name": x.upper()})).select("p_partkey", "p_name")


@query("select p_partkey, case when length(p_name) % 2 = 0 then 'positive' else 'negative' end as \"Sentiment\", '0.5' as \"SentimentScore\" from part")
def l3_sentiment(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    answer = lambda x: {"Sentiment": "negative" if len(x) % 2 else "positive", "SentimentScore": 0.5}
    return completions.apply(part, completions.sentiment("p_name"), _replies(answer)).select("p_partkey", "Sentiment", "SentimentScore")


@query("select p_partkey, split_part(p_name, ' ', 1) as kind, nullif(split_part(p_name, ' ', 2), '') as thing from part")
def l5_extracted(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    answer = lambda x: dict(zip(("kind", "thing"), x.split(" ")))
    return completions.apply(part, completions.extract("p_name", "kind\nthing"), _replies(answer)).select("p_partkey", "kind", "thing")


def _add_total(part):
    part["total"] = part["l_quantity"] * 2
    return part


class _Balance:
    """A customer's running total of cents, and whether the order is the largest so far."""

    def __init__(self):
        self.total, self.largest = 0, -1

    def feed(self, row):
        self.total += row["cents"]
        yield {"o_orderkey": row["o_orderkey"], "o_custkey": row["o_custkey"], "total": self.total, "record": row["cents"] > self.largest}
        self.largest = max(self.largest, row["cents"])


@query("""select o_orderkey, o_custkey, sum(cents) over w::bigint as total, cents > coalesce(max(cents) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), -1) as record
    from (select *, floor(o_totalprice * 100)::bigint as cents from orders) window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)""")
def u1_running_balance(spark, d):
    """A script of whole groups without a schema, fed in order."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return scripts.streamed_script(orders, _Balance, ["o_custkey"], ["o_orderdate", "o_orderkey"])


class _PaidShare:
    """Cents a customer ordered, beside the balance that the second table gives first."""

    def __init__(self):
        self.balance, self.cents, self.key = None, 0, None

    def feed(self, row):
        self.key = row["key"]
        if row["source"] == 2:
            self.balance = row["balance"]
        else:
            self.cents += row["cents"]
        return ()

    def finish(self):
        yield {"key": self.key, "cents": self.cents, "balance": self.balance or 0.0}


@query("select c_custkey as key, coalesce(sum(floor(o_totalprice * 100)), 0)::bigint as cents, c_acctbal as balance from customer left join orders on o_custkey = c_custkey group by all")
def u1_two_tables(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    customers = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return scripts.streamed_script(orders, _PaidShare, ["key"], second=customers)


@query("select l_orderkey, l_linenumber, l_quantity, l_quantity * 2 as total from lineitem")
def u1_python_script(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scripts.python_script(li, _add_total, "l_orderkey long, l_linenumber int, l_quantity double, total double")


@query("select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1")
def u3_sql_script(spark, d):
    return scripts.sql_script("select r_name, count(*) as nations from {dataset1} join {dataset2} on n_regionkey = r_regionkey group by 1", _t(spark, d, "nation"), _t(spark, d, "region"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def u4_expression_script(spark, d):
    li = scripts.expression_script(_t(spark, d, "lineitem"), {"net": "round(l_extendedprice * (1 - l_discount), 4)"})
    return li.select("l_orderkey", "l_linenumber", "net")


# ---- readers' helpers ----------------------------------------------------------------------------------------------


_FILES = "(select page_id, 'p' || page_id || case page_id % 8 when 0 then '.csv' when 1 then '.TSV' when 2 then '.tab' when 3 then '.json' when 4 then '.v2.ndjson' when 5 then '.parquet' when 6 then '' else '.Jsonl' end as name from pages)"


@query(f"select page_id, name, case when name ilike '%.tsv' or name ilike '%.tab' then 'Tsv' when name ilike '%json' or name ilike '%.jsonl' then 'Json' when name ilike '%.parquet' then 'Parquet' else 'Csv' end as format from {_FILES}")
def s9_format_guess(spark, d):
    _t(spark, d, "pages").select("page_id").createOrReplaceTempView("brindle_pages")
    files = spark.sql(f"select * from {_FILES}".replace("from pages", "from brindle_pages"))
    return files.select("page_id", "name", readers.format_of(F.col("name")).alias("format"))


@query("select 25::bigint as rows")
def s11_preview(spark, d):
    return readers.preview(_t(spark, d, "lineitem")).agg(F.count(F.lit(1)).alias("rows"))


@query("select r_regionkey as key, r_name as \"Name\", case when r_regionkey % 2 = 0 then r_regionkey::double end as even from region")
def s14_rows_from_dictionaries(spark, d):
    rows = [{"key": r.r_regionkey, "Name": r.r_name} | ({"even": r.r_regionkey} if r.r_regionkey % 2 == 0 else {}) for r in _t(spark, d, "region").collect()]  # five regions
    df = readers.from_dictionaries(spark, rows)
    return df.select(F.col("key").cast("int").alias("key"), "Name", F.col("even").cast("double").alias("even"))


@query("select doc_id, case when length(text) > 100 then left(text, 100) || chr(10) || '... (' || length(text) || ' characters in all)' else text end as shown from documents")
def sc5_truncated(spark, d):
    return _t(spark, d, "documents").select("doc_id", scalars.truncated(F.col("text"), 100).alias("shown"))


@query("select c_custkey, (case c_nationkey % 3 when 0 then 7 when 1 then 0 else 9 end)::bigint as hours from customer")
def sc10_now_in_zone(spark, d):
    """Each customer's local hour against UTC's."""
    zone = F.element_at(F.array(F.lit("Asia/Jakarta"), F.lit("UTC"), F.lit("Asia/Tokyo")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return _t(spark, d, "customer").select("c_custkey", F.timestamp_diff("HOUR", scalars.now_in("UTC"), scalars.now_in(zone)).alias("hours"))


# ---- scalar functions ----------------------------------------------------------------------------------------------


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') as identifier, upper(sha256(p_name)) as digest from part")
def sc_text_functions(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", scalars.slug(F.concat("p_name", F.lit(" & Co."))).alias("slug"), scalars.identifier(F.col("p_name")).alias("identifier"), scalars.sha256_hex(F.col("p_name")).alias("digest"))


@query("select o_orderkey, date_diff('day', o_orderdate::date, date '1998-12-31')::int as days, round(epoch(o_orderdate) / 86400.0 + 25569, 6) as ole from orders")
def sc_date_functions(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", scalars.days_between(F.col("o_orderdate"), F.lit("1998-12-31").cast("date")).alias("days"), F.round(scalars.to_ole_date(F.col("o_orderdate")), 6).alias("ole"))


@query("select event_id, props->>'$.k' as k from events")
def sc_json_path(spark, d):
    return _t(spark, d, "events").select("event_id", scalars.json_path(F.col("props"), "k").alias("k"))


@query("select event_id, user_id, event_type, value from events where value >= 50")
def sc_filter_language(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return e.where(scalars.filter_condition(e, "value >= 50"))


@query("select l_orderkey, l_linenumber, round_even(l_extendedprice, 1) as half_even, trunc(l_extendedprice)::bigint as cut, least(greatest(l_quantity, 5), 40) as clamped, round(log2(l_quantity), 8) as bits, round(((2.0 + 3) * 4 - 6 / 3.0) ^ 2, 6) as constant from lineitem")
def sc_math_functions(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalars.half_even(F.col("l_extendedprice"), 1).alias("half_even"), F.col("l_extendedprice").cast("bigint").alias("cut"), scalars.clamp(F.col("l_quantity"), 5.0, 40.0).alias("clamped"), F.round(scalars.log2(F.col("l_quantity")), 8).alias("bits"), F.round(scalars.arithmetic("((2 + 3) * 4 - 6 / 3) ^ 2"), 6).alias("constant"))


@query()
def sc_visible_text(spark, d):
    return _t(spark, d, "pages").select("page_id", scalars.visible_text(F.col("html")).alias("text"))


# ---- metadata queries ----------------------------------------------------------------------------------------------

_RUNS = "(select event_id, user_id as experiment_id, ts as started, props as metrics from events)"


def _runs(spark, d):
    return _t(spark, d, "events").select("event_id", F.col("user_id").alias("experiment_id"), F.col("ts").alias("started"), F.col("props").alias("metrics"))


@query("select event_id, value from events where event_type = 'click' and value > 10")
def q3_ad_hoc_query(spark, d):
    e = _t(spark, d, "events").where("event_type = 'click'")
    return transforms.select_columns(e.where(scalars.filter_condition(e, "value > 10")), ["event_id", "value"])


@query(f"select event_id, started from {_RUNS} order by started desc, event_id limit 20")
def q7_latest_runs(spark, d):
    return _runs(spark, d).orderBy(F.desc("started"), "event_id").limit(20).select("event_id", "started")


@query(f"select started, (metrics->>'k')::double as value from {_RUNS} where metrics->>'k' is not null")
def q8_run_trend(spark, d):
    return workspace.run_trend(_runs(spark, d), "k")


@query(f"select event_id, c_name as name from (select * from {_RUNS} order by started desc limit 8) left join customer on experiment_id = c_custkey")
def q9_recent_with_names(spark, d):
    names = _t(spark, d, "customer").select(F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("name"))
    return workspace.recent_with_names(_runs(spark, d), names).select("event_id", "name")


@query("select p_brand as category, p_name as name from part where p_brand = 'Brand#1'")
def q10_gallery(spark, d):
    return workspace.gallery(_t(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("name")), "Brand#1")


@query("with s as (select o_custkey, o_orderkey as scene_id, o_totalprice as points, o_orderdate as created from orders where o_orderstatus <> 'P' order by created desc, scene_id limit 60), r as (select l_orderkey as scene_id, round_even(avg(l_quantity / 10), 1) as avg_rating, count(*) as ratings from lineitem group by 1) select scene_id, coalesce(avg_rating, 0) as avg_rating, coalesce(ratings, 0) as ratings, points from s left join r using (scene_id) order by 2 desc, 3 desc, 4 desc, 1 limit 1")
def q11_best_rated(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_totalprice").alias("points"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") != "P").alias("is_public"))
    r = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), (F.col("l_quantity") / 10).alias("stars"))
    return workspace.best_rated(o, r).select("scene_id", "avg_rating", "ratings", "points")


@query("select o_orderkey as scene_id, o_orderdate as created from orders where o_custkey = 7")
def q12_owned_by(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("created"), F.col("o_custkey").cast("string").alias("user_id"))
    return workspace.owned_by(o, "7").select("scene_id", "created")


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 4")
def q15_last_messages(spark, d):
    return workspace.last_messages(_t(spark, d, "conversations"), "conv_id", "turn", 2)


# ---- images and meshes ---------------------------------------------------------------------------------------------

#: Each whole vector as a picture of 8 x 8 pixels.
_PIXELS = """(select vec_id as image, i % 8 as x, i // 8 as y, floor(abs(c) * 1000)::int % 256 as r, floor(abs(c) * 3000)::int % 256 as g, (floor(abs(c) * 1000)::int + i) % 256 as b, case when c > 0.2 then 3 else 255 end as a
    from (select vec_id, unnest(embedding)::double as c, generate_subscripts(embedding, 1)::int - 1 as i from embeddings where len(list_filter(embedding, lambda c: isfinite(c))) = 64))"""


def _pixels(spark, d):
    whole = _t(spark, d, "embeddings").where("size(filter(embedding, c -> abs(c) < double('inf'))) = 64")
    each = whole.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", F.col("v").cast("double").alias("c"))
    return each.selectExpr("vec_id as image", "i % 8 as x", "cast(i div 8 as int) as y", "int(floor(abs(c) * 1000)) % 256 as r", "int(floor(abs(c) * 3000)) % 256 as g", "(int(floor(abs(c) * 1000)) + i) % 256 as b", "if(c > 0.2, 3, 255) as a")


_DEPTH = f"(select image, x, y, a, least(greatest(0.55 * (0.299 * r + 0.587 * g + 0.114 * b) / 255 + 0.45 * (1 - sqrt((x / 7.0 * 2 - 1) ** 2 + (y / 7.0 * 2 - 1) ** 2) / sqrt(2)), 0), 1)::double as depth from {_PIXELS})"


@query("select n_nationkey, greatest(8, least(512, floor(h * ar)))::int as w, greatest(8, least(512, h))::int as h from (select n_nationkey, ar, floor(sqrt(40000.0 / ar)) as h from (select n_nationkey, (n_nationkey + 1) / 7.0 as ar from nation))")
def g1_target_size(spark, d):
    n = _t(spark, d, "nation")
    w, h = imaging.target_size(F.col("n_nationkey") + 1, F.lit(7), 40000)
    return n.select("n_nationkey", w.alias("w"), h.alias("h"))


@query(f"select image, x::int as x, y::int as y, round(depth, 8) as depth from {_DEPTH}")
def g3_depth(spark, d):
    return imaging.depth(_pixels(spark, d)).select("image", "x", "y", F.round("depth", 8).alias("depth"))


@query(f"with d as {_DEPTH} select p.image as image, p.x::int as x, p.y::int as y, round((avg(q.depth) - 0.5) * 0.6, 8) as pz from d p join d q on p.image = q.image and abs(p.x - q.x) <= 1 and abs(p.y - q.y) <= 1 where p.a >= 8 group by all")
def g4_g5_points(spark, d):
    return imaging.points(_pixels(spark, d)).select("image", "x", "y", F.round("pz", 8).alias("pz"))


def _lanczos_sql(axis: str, source: int, target: int) -> str:
    """Every weight of one axis, straight from the kernel's definition."""
    fold = max(1.0, source / target)
    t = f"((o + 0.5) * {source / target!r} - 0.5 - i) / {fold!r}"
    return f"(select i as {axis}, o as {axis}o, case when abs({t}) < 1e-9 then 1.0 when abs({t}) >= 3 then 0.0 else sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} / 3) end as {axis}w from range({source}) s(i), range({target}) q(o))"


def _resized_sql(width: int, height: int, rows: int = 8, pixels: str = _PIXELS) -> str:
    shown = ", ".join(f"least(greatest(round(round(sum(xw * yw * {c}) / sum(xw * yw), 6)), 0), 255)::int as {c}" for c in "rgba")
    return f"select image, xo::int as x, yo::int as y, {shown} from {pixels} join {_lanczos_sql('x', 8, width)} using (x) join {_lanczos_sql('y', rows, height)} using (y) group by 1, 2, 3"


def _tall(spark, d):
    """The same pictures twice over each other, so that there are rows to give up."""
    again = _pixels(spark, d)
    return again.unionByName(again.withColumn("y", F.col("y") + 8))


@query(_resized_sql(8, 11, 16, f"(select * from {_PIXELS} union all select image, x, y + 8, r, g, b, a from {_PIXELS})"))
def g2_resized_smaller(spark, d):
    return imaging.resize(_tall(spark, d), 64)


@query(_resized_sql(15, 15))
def g2_resized_larger(spark, d):
    return imaging.resize(_pixels(spark, d), 230)


@query("select count(*) as n, (count(*) * 32)::bigint as bytes from " + _PIXELS + " where a >= 8")
def g6_splat_records(spark, d):
    return imaging.splat_rows(imaging.points(_pixels(spark, d))).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).alias("bytes"))


_HEIGHTS = f"(select image, x, y, x / 7.0 * 2 - 1 as px, 1 - y / 7.0 * 2 as py, (depth - 0.5) * 0.6 as pz from {_DEPTH})"


@query(f"select image, x::int as x, y::int as y, round(px, 8)::double as px, round(py, 8)::double as py, round(pz, 8) as pz, (x < 7 and y < 7)::int * 2 as triangles from {_HEIGHTS}")
def g8_grid_mesh(spark, d):
    """The surface of each picture: its vertices, and the triangles that begin at each of them."""
    vertices, triangles = imaging.height_mesh(imaging.depth(_pixels(spark, d)))
    begun = triangles.groupBy(F.col("quad").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("triangles"))
    shown = [(F.round(c, 8) + F.lit(0.0)).alias(c[-2:]) for c in ("px", "py", "pz")]
    placed = vertices.select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return placed.join(begun, "id", "left").select("id.image", "id.x", "id.y", *shown, F.coalesce("triangles", F.lit(0)).alias("triangles"))


_NORMALS = f"""with v as materialized {_HEIGHTS},
  q as (select a.image, a.x, a.y, a.px as ax, a.py as ay, a.pz as az, b.px as bx, b.py as "by", b.pz as bz, c.px as cx, c.py as cy, c.pz as cz, d.px as dx, d.py as dy, d.pz as dz
    from v a join v b on b.image = a.image and b.x = a.x + 1 and b.y = a.y join v c on c.image = a.image and c.x = a.x and c.y = a.y + 1 join v d on d.image = a.image and d.x = a.x + 1 and d.y = a.y + 1),
  t as (select image, [[x, y], [x + 1, y], [x, y + 1]] as corners, bx - ax as ux, "by" - ay as uy, bz - az as uz, cx - ax as vx, cy - ay as vy, cz - az as vz from q
    union all select image, [[x + 1, y], [x + 1, y + 1], [x, y + 1]], dx - bx, dy - "by", dz - bz, cx - bx, cy - "by", cz - bz from q),
  n as (select image, unnest(corners) as spot, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz from t),
  s as (select image, spot[1]::int as x, spot[2]::int as y, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from n group by all)
  select image, x, y, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) as nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) as ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) as nz from s"""


@query(_NORMALS)
def g8_vertex_normals(spark, d):
    n = imaging.vertex_normals(*imaging.height_mesh(imaging.depth(_pixels(spark, d))))
    return n.select("id.image", "id.x", "id.y", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


# ---- windows over the event stream (batch form) --------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts, timestamp '1970-01-01') as start, event_type, count(*) as count, round(sum(value), 4) as sum_value from events group by all")
def w_tumbling_windows(spark, d):
    return streams.windowed(_t(spark, d, "events"), "ts", "1 hour", by=["event_type"], value="value").select("start", "event_type", "count", F.round("sum_value", 4).alias("sum_value"))


@query("select time_bucket(interval '1 hour', ts, timestamp '1970-01-01') - interval (s * 30) minute + case when extract(minute from ts) >= 30 then interval '30 minute' else interval '0 minute' end as start, count(*) as count from events, range(2) t(s) group by 1")
def w_sliding_windows(spark, d):
    return streams.windowed(_t(spark, d, "events"), "ts", "1 hour", "30 minutes").select("start", "count")


@query("with g as (select user_id, ts, (ts >= lag(ts) over w + interval '6 hours' or lag(ts) over w is null)::int as fresh from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as count from s group by user_id, k")
def w_sessions(spark, d):
    return streams.sessions(_t(spark, d, "events"), "ts", "6 hours", ["user_id"]).select("user_id", "start", "count")


@query("select event_id, rank() over (partition by event_type order by value desc, event_id)::int as place, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running from events")
def w_rank_and_running(spark, d):
    from pyspark.sql import Window

    e = _t(spark, d, "events")
    place = F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    running = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", place.alias("place"), F.round(running, 4).alias("running"))


@query("select n_nationkey as k from nation union select c_nationkey from customer intersect select s_nationkey from supplier")
def x_set_operations(spark, d):
    c, s = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(c.intersect(s)).distinct()


# ---- learning ------------------------------------------------------------------------------------------------------


def _flags(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", (F.col("l_extendedprice") > 30000).cast("int").alias("Label"))
    return S.with_logical(li, "l_returnflag", "Categorical")


def _learn(name: str, algorithm: str, label: str, frame: Callable, features_: list[str] | None, ids: list[str], **parameters) -> None:
    def run(spark, d):
        df = frame(spark, d)
        t = training.train(spec(algorithm, **parameters), df, label, features_)
        return training.score(t, df).drop(*[c for c in df.columns if c not in ids])

    run.__name__ = name
    query()(run)


def _beats_constant(scored, task: str):
    """One row: how many rows were scored, what the best constant prediction gets, and whether the model is better."""
    if task == "Regression":
        error = F.sqrt(F.avg(F.pow(F.col("Score") - F.col("Label"), 2)))
        return scored.agg(F.count(F.lit(1)).alias("rows"), F.round(F.stddev_pop("Label"), 2).alias("baseline"), (error < F.stddev_pop("Label")).alias("better"))
    right = F.sum((F.col("PredictedLabel").cast("string") == F.col("Label").cast("string")).cast("long"))
    by_label = scored.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), right.alias("right"))
    share = F.max("n") / F.sum("n")
    return by_label.agg(F.sum("n").alias("rows"), F.round(share, 8).alias("baseline"), (F.sum("right") / F.sum("n") > share).alias("better"))


_SHARE = "select sum(n)::bigint as rows, round(max(n)::double / sum(n), 8) as baseline, true as better from (select count(*) as n from {} group by {})"
_BASELINES = {
    "algo.bin": ("Binary", _SHARE.format("embeddings", "label >= 5")),
    "algo.multi": ("Multiclass", _SHARE.format("embeddings", "label")),
    "algo.reg": ("Regression", "select count(*) as rows, round(stddev_pop(l_extendedprice), 2) as baseline, true as better from lineitem"),
}


def _check(name: str, algorithm: str, frame: Callable, features_: list[str], **parameters) -> None:
    """``<name>_check``: the learner against the best constant, whose figures SQL gives."""
    kind = algorithm.rsplit(".", 1)[0]
    if kind not in _BASELINES:
        return
    task, sql = _BASELINES[kind]
    if task == "Binary":  # the tables' line items hold no signal for a yes or no
        frame, features_ = _halves, ["embedding"]

    def run(spark, d):
        df = frame(spark, d)
        return _beats_constant(training.score(training.train(spec(algorithm, **parameters), df, "Label", features_), df), task)

    run.__name__ = f"{name}_check"
    query(sql)(run)


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
_IDS = ["l_orderkey", "l_linenumber"]
_price = lambda spark, d: S.with_logical(_t(spark, d, "lineitem").select(*_IDS, *_FEATURES, F.col("l_extendedprice").alias("Label")), "l_returnflag", "Categorical")
_kinds = lambda spark, d: _t(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("Label"))
_halves = lambda spark, d: _t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("Label"))
_few = {"numberOfTrees": 5, "numberOfLeaves": 8}
for _name, _algorithm, _frame, _columns, _keys, _more in [
    ("m1_logistic", "algo.bin.logistic", _flags, _FEATURES, _IDS, {"l1Regularization": 0.0, "l2Regularization": 0.001}),
    ("m2_sdca_binary", "algo.bin.sdca", _flags, _FEATURES, _IDS, {}),
    ("m3_boosted_trees", "algo.bin.fastTree", _flags, _FEATURES, _IDS, _few),
    ("m4_forest", "algo.bin.fastForest", _flags, _FEATURES, _IDS, _few),
    ("m5_leafy_trees", "algo.bin.lightGbm", _flags, _FEATURES, _IDS, _few),
    ("m6_perceptron", "algo.bin.perceptron", _flags, _FEATURES, _IDS, {}),
    ("m7_svm", "algo.bin.svm", _flags, _FEATURES, _IDS, {}),
    ("m8_sdca_multiclass", "algo.multi.sdca", _kinds, ["embedding"], ["vec_id"], {}),
    ("m9_lbfgs_multiclass", "algo.multi.lbfgs", _kinds, ["embedding"], ["vec_id"], {}),
    ("m12_naive_bayes", "algo.multi.naiveBayes", _kinds, ["embedding"], ["vec_id"], {}),
    ("m13_sdca_regression", "algo.reg.sdca", _price, _FEATURES, _IDS, {}),
    ("m14_least_squares", "algo.reg.ols", _price, _FEATURES, _IDS, {}),
    ("m15_boosted_regression", "algo.reg.fastTree", _price, _FEATURES, _IDS, _few),
    ("m16_forest_regression", "algo.reg.fastForest", _price, _FEATURES, _IDS, _few),
    ("m17_leafy_regression", "algo.reg.lightGbm", _price, _FEATURES, _IDS, _few),
    ("m18_tweedie", "algo.reg.tweedie", _price, _FEATURES, _IDS, {"numberOfTrees": 10, "numberOfLeaves": 16}),
    ("m19_poisson", "algo.reg.poisson", _price, _FEATURES, _IDS, {}),
    ("m20_sgd_regression", "algo.reg.sgd", _price, _FEATURES, _IDS, {}),
    ("m21_k_means", "algo.cluster.kmeans", _kinds, ["embedding"], ["vec_id"], {}),
    ("m22_pca_anomaly", "algo.anomaly.pca", _kinds, ["embedding"], ["vec_id"], {"rank": 3}),
]:
    _learn(_name, _algorithm, "Label", _frame, _columns, _keys, **_more)
    _check(_name, _algorithm, _frame, _columns, **_more)
_check("m10_one_against_all", "algo.multi.oneVsAll", _kinds, ["embedding"], numberOfTrees=2, numberOfLeaves=4)
_check("m11_leafy_multiclass", "algo.multi.lightGbm", _kinds, ["embedding"], numberOfTrees=2, numberOfLeaves=4)


# Learners against planted rules: fitted on the orders whose key isn't divisible by 5, compared row by row on the others.


def _planted(name: str, algorithm: str, rule: str, kept: str, features_: list[str], answer: str, **parameters) -> None:
    """``<name>``: predictions for held-out line items must be what the rule says, which SQL works out by itself."""
    column, rounding = ("PredictedLabel", "cast({} as varchar)") if answer == "class" else ("Score", "round(cast({} as double), " + answer + ")")

    def run(spark, d):
        rows = _t(spark, d, "lineitem").where(kept).select(*_IDS, *features_, F.expr(rule).alias("Label"))
        t = training.train(spec(algorithm, **parameters), rows.where("l_orderkey % 5 <> 0"), "Label", features_)
        shown = F.col(column).cast("string") if answer == "class" else F.round(column, int(answer))
        return training.score(t, rows.where("l_orderkey % 5 = 0")).select(*_IDS, shown.alias("predicted"))

    run.__name__ = name
    query(f"select l_orderkey, l_linenumber, {rounding.format(rule)} as predicted from lineitem where ({kept}) and l_orderkey % 5 = 0")(run)


_LEAF_FEATURES = ["l_quantity", "l_discount", "l_linenumber"]
_BOX = "case when l_quantity > 20 and l_discount > 0.045 or l_linenumber = 1 then 1 else 0 end"
_KINDS = "case when l_linenumber < 3 then 'first' when l_quantity > 30 then 'bulk' else 'rest' end"
_STEPS = "case when l_linenumber > 5 then 7.0 when l_quantity > 40 then 90.0 when l_quantity > 15 then 35.0 when l_discount > 0.045 then 12.0 else 20.0 end"
_planted("m5_leafy_planted_box", "algo.bin.lightGbm", _BOX, "true", _LEAF_FEATURES, "class", numberOfTrees=4, numberOfLeaves=8)
_planted("m11_leafy_planted_kinds", "algo.multi.lightGbm", _KINDS, "true", _LEAF_FEATURES, "class", numberOfTrees=3, numberOfLeaves=4)
_planted("m17_leafy_planted_steps", "algo.reg.lightGbm", _STEPS, "true", _LEAF_FEATURES, "6", numberOfTrees=1, numberOfLeaves=12, learningRate=1.0)
_planted("m18_tweedie_planted_steps", "algo.reg.tweedie", _STEPS, "true", _LEAF_FEATURES, "6", numberOfTrees=1, numberOfLeaves=12, learningRate=1.0)
_SLOPE = "l_quantity / 50 + 4 * l_discount"
_planted("m1_logistic_planted_line", "algo.bin.logistic", f"case when {_SLOPE} > 0.7 then 1 else 0 end", f"abs({_SLOPE} - 0.7) > 0.15", _LEAF_FEATURES, "class", l1Regularization=0.0, l2Regularization=0.0001)
_planted("m2_sdca_planted_line", "algo.bin.sdca", f"case when {_SLOPE} > 0.7 then 1 else 0 end", f"abs({_SLOPE} - 0.7) > 0.15", _LEAF_FEATURES, "class", l1Regularization=0.0, l2Regularization=0.001, maximumNumberOfIterations=15)
_planted("m7_svm_planted_line", "algo.bin.svm", f"case when {_SLOPE} > 0.7 then 1 else 0 end", f"abs({_SLOPE} - 0.7) > 0.15", _LEAF_FEATURES, "class", numberOfIterations=50, **{"lambda": 0.0001})
_BANDS = "case when l_quantity < 16 then 'low' when l_quantity < 34 then 'mid' else 'high' end"
_APART = "l_quantity < 12 or l_quantity between 20 and 29 or l_quantity > 37"
_planted("m8_sdca_planted_bands", "algo.multi.sdca", _BANDS, _APART, ["l_quantity"], "class", l1Regularization=0.0, l2Regularization=0.0001, maximumNumberOfIterations=30)
_planted("m9_lbfgs_planted_bands", "algo.multi.lbfgs", _BANDS, _APART, ["l_quantity"], "class", l1Regularization=0.0, l2Regularization=0.0001)


_GAINS = """with t as (select l_quantity as q, count(*) as n, sum(l_extendedprice::double) as s from lineitem group by 1), c as (select q, sum(n) over (order by q) as nl, sum(s) over (order by q) as sl, sum(n) over () as nt, sum(s) over () as st from t),
  a as (select q, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) as gain from c where nl < nt), first as (select arg_max(q, gain) as cut from a)
  select case when l_quantity <= cut then 'left' else 'right' end as leaf, count(*) as rows, round(avg(l_extendedprice::double), 4) as value from lineitem, first group by 1"""


@query(_GAINS)
def m17_leafy_first_split(spark, d):
    """The split that lessens the squares most and its leaves' means."""
    df = _t(spark, d, "lineitem").select(*_IDS, "l_quantity", F.col("l_extendedprice").alias("Label"))
    scored = training.score(training.train(spec("algo.reg.lightGbm", numberOfTrees=1, numberOfLeaves=2, learningRate=1.0), df, "Label", ["l_quantity"]), df)
    leaves = scored.groupBy("Score").agg(F.count(F.lit(1)).alias("rows"), F.min("l_quantity").alias("q"))
    side = F.when(F.col("q") == F.min("q").over(Window.partitionBy()), "left").otherwise("right")
    return leaves.select(side.alias("leaf"), "rows", F.round("Score", 4).alias("value"))


_RIDGE = "sign(covar_pop(x, y)) * greatest(abs(covar_pop(x, y)) / stddev_samp(x) - {l1}, 0) / (var_pop(x) / var_samp(x) + {l2}) / stddev_samp(x)"


@query(f"with s as (select min(l_quantity)::double as lo, max(l_quantity)::double as hi from lineitem), r as (select (l_quantity - lo) / (hi - lo) as x, (l_quantity * (1 + l_discount))::double as y from lineitem, s) select 'l2' as penalty, round({_RIDGE.format(l1=0, l2=0.5)}, 1) as slope from r union all select 'l1 and l2', round({_RIDGE.format(l1=1, l2=0.5)}, 1) from r union all select 'large l1', round({_RIDGE.format(l1=100, l2=0.5)}, 1) from r")
def m13_sdca_closed_form(spark, d):
    """Slopes over the scaled quantity: ridge regression's, and the soft-thresholded ones of elastic nets, with penalties at deviation 1."""
    df = _t(spark, d, "lineitem").select("l_quantity", F.expr("l_quantity * (1 + l_discount)").alias("Label"))
    rows = []
    for name, l1, l2 in (("l2", 0.0, 0.5), ("l1 and l2", 1.0, 0.5), ("large l1", 100.0, 0.5)):
        t = training.train(spec("algo.reg.sdca", l1Regularization=l1, l2Regularization=l2, tolerance=1e-10), df, "Label", ["l_quantity"])
        rows.append((name, round(t.model.stages[-1].getOrDefault("weights")[0], 1)))
    return spark.createDataFrame(rows, "penalty string, slope double")


@query("select l_orderkey, l_linenumber, round(avg(l_quantity::double) over (partition by l_returnflag = 'R'), 3) as predicted from lineitem union all select l_orderkey, -l_linenumber, round(avg(l_quantity::double) over (), 3) from lineitem")
def m19_poisson_closed_form(spark, d):
    """Means of two groups without a penalty; with a large l1 no weight is left and the mean of all (negative numbers)."""
    df = _t(spark, d, "lineitem").select(*_IDS, F.expr("cast(l_returnflag = 'R' as int)").alias("returned"), F.col("l_quantity").alias("Label"))
    fit = lambda l1: training.score(training.train(spec("algo.reg.poisson", l1Regularization=l1, l2Regularization=0.0), df, "Label", ["returned"]), df)
    shown = F.round("Score", 3).alias("predicted")
    return fit(0.0).select(*_IDS, shown).unionByName(fit(1e6).select("l_orderkey", (-F.col("l_linenumber")).alias("l_linenumber"), shown))


@query("with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem) select l_orderkey, l_linenumber, round((a * l_quantity + b) / 100) as predicted from lineitem, f")
def m14_least_squares_closed_form(spark, d):
    df = _t(spark, d, "lineitem").select(*_IDS, "l_quantity", F.col("l_extendedprice").alias("Label"))
    t = training.train(spec("algo.reg.ols", l2Regularization=0.0), df, "Label", ["l_quantity"])
    return training.score(t, df).select(*_IDS, F.round(F.col("Score") / 100).alias("predicted"))


@query("with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b, regr_r2(l_extendedprice, l_quantity) as r2 from lineitem) select round(sqrt(avg((l_extendedprice - a * l_quantity - b) ** 2)), 2) as rmse, round(any_value(r2), 6) as r2 from lineitem, f")
def e7_e8_scored_and_evaluated(spark, d):
    df = _t(spark, d, "lineitem").select(*_IDS, "l_quantity", F.col("l_extendedprice").alias("Label"))
    t = training.train(spec("algo.reg.ols", l2Regularization=0.0), df, "Label", ["l_quantity"])
    found = training.evaluate(training.score(t, df))
    return spark.createDataFrame([(round(found["rmse"], 2), round(found["r2"], 6))], "rmse double, r2 double")


@query("select count(*) as rows, true as tighter from embeddings")
def m21_k_means_check(spark, d):
    df = _kinds(spark, d)
    scored = training.score(training.train(spec("algo.cluster.kmeans"), df, "Label", ["embedding"]), df)
    cells = scored.select("PredictedClusterId", F.posexplode("embedding").alias("at", "x"))
    spread = lambda by: cells.groupBy(*by).agg((F.var_pop("x") * F.count(F.lit(1))).alias("s")).agg(F.sum("s").alias("s")).first()["s"]
    tighter = spread(["PredictedClusterId", "at"]) < spread(["at"])
    return scored.agg(F.count(F.lit(1)).alias("rows")).withColumn("tighter", F.lit(tighter))


@query(_SHARE.format("documents", "lang"))
def m27_text_classes_check(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("Label"))
    return _beats_constant(training.score(training.train(spec("algo.nlp.textClassification", textColumn="text"), docs, "Label"), docs), "Multiclass")


@query("select 'l_quantity' as feature")
def e16_most_important_feature(spark, d):
    df = _t(spark, d, "lineitem").select(*_FEATURES[:3], (F.col("l_quantity") > 25).cast("int").alias("Label"))
    t = training.train(spec("algo.bin.logistic", l1Regularization=0.0, l2Regularization=0.001, maximumNumberOfIterations=10), df, "Label")
    rows = training.feature_importance(t, df, 1)
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance")).limit(1).select("feature")


@query()
def m10_one_against_all(spark, d):
    df = _kinds(spark, d)
    t = training.train(spec("algo.multi.oneVsAll", numberOfTrees=2, numberOfLeaves=4), df, "Label", ["embedding"])
    return training.score(t, df).select("vec_id", "PredictedLabel")


_BEYOND = "exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"
_KERNELS = f"""with w as (select event_id, value, list(value) over w as past, greatest(stddev_pop(value) over w, 1e-6) as width from events window w as (partition by user_id order by event_id rows between 30 preceding and 1 preceding)),
  k as (select event_id, value, len(past) as n, list_transform(list_transform(past, lambda x: (value - x) / width), lambda z: struct_pack(z := z, t := 1 / (1 + 0.2316419 * abs(z)))) as kernels from w),
  u as (select event_id, value, n, (select avg(case when z < 0 then 1 - beyond else beyond end) from (select z, {_BEYOND} as beyond from (select unnest(kernels, recursive := true)))) as above from k),
  p as (select event_id, value, case when n < 3 or n is null then 1.0 else greatest(0.0, least(1.0, 2 * least(above, 1 - above))) end as p from u)
  select event_id, value as spike_score, round(p, 6) as p_value, (p < 0.05)::int as alert from p"""


@query(_KERNELS)
def m23_spikes(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "value")
    return custom.spikes(e, "value", "event_id", 95, 30, ["user_id"]).select("event_id", "spike_score", F.round("p_value", 6).alias("p_value"), "alert")


@query()
def m24_recommendations(spark, d):
    e = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("Label"))
    t = training.train(spec("algo.rec.matrixFactorization", userColumn="user_id", itemColumn="event_type", approximationRank=4, numberOfIterations=3), e, "Label")
    return training.score(t, e).select("user_id", "event_type", "Score")


_TASTE = "(l_suppkey % 7) * (l_linenumber - 4) + l_linenumber"


@query(f"with r as (select l_orderkey, l_linenumber as item, ({_TASTE})::double as y from lineitem), m as (select item, avg(y) as mean from r where l_orderkey % 5 <> 0 group by 1) select count(*) as rows, round(sqrt(avg((y - mean) ** 2)), 4) as baseline, true as better from r join m using (item) where l_orderkey % 5 = 0")
def m24_held_out_ratings(spark, d):
    """Held-out error of a planted taste of suppliers for line numbers: less than half of the item means' error."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.expr(_TASTE).cast("double").alias("Label"))
    fit, held = rows.where("l_orderkey % 5 <> 0").drop("l_orderkey"), rows.where("l_orderkey % 5 = 0")
    t = training.train(spec("algo.rec.matrixFactorization", userColumn="l_suppkey", itemColumn="l_linenumber", approximationRank=2, numberOfIterations=20, learningRate=0.2), fit, "Label")
    means = fit.groupBy("l_linenumber").agg(F.avg("Label").alias("mean"))
    error = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("Label"), 2)))
    met = training.score(t, held).join(F.broadcast(means), "l_linenumber")  # an item is one of seven line numbers
    return met.agg(F.count("Score").alias("rows"), F.round(error("mean"), 4).alias("baseline"), (error("Score") * 2 < error("mean")).alias("better"))


_SCALED = "(l_{0}::double - min(l_{0}::double) over ()) / (max(l_{0}::double) over () - min(l_{0}::double) over ())"


@query(f"with r as (select l_orderkey, l_linenumber, {_SCALED.format('quantity')} as x, 0.8 * ({_SCALED.format('quantity')}) + 0.2 * ({_SCALED.format('discount')}) as y0 from lineitem), q as (select *, (y0 - min(y0) over ()) / (max(y0) over () - min(y0) over ()) as y from r), m as (select avg(x) as mx, avg(y) as my, var_pop(x) as a, covar_pop(x, y) as b, var_pop(y) as c from q), e as (select *, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b ** 2) as low from m) select l_orderkey, l_linenumber, round(abs((x - mx) * b + (y - my) * (low - a)) / sqrt(b ** 2 + (low - a) ** 2), 5) as score from q, e")
def m22_plane_distance(spark, d):
    """Distance from the first of two components, whose direction has a closed form."""
    li = _t(spark, d, "lineitem")
    ends = li.agg(*[f(F.col(f"l_{c}").cast("double")).alias(f"{n}_{c}") for c in ("quantity", "discount") for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: (F.col(f"l_{c}").cast("double") - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    rows = li.crossJoin(F.broadcast(ends)).select(*_IDS, scaled("quantity").alias("x"), (0.8 * scaled("quantity") + 0.2 * scaled("discount")).alias("y"))  # one row of ends
    t = training.train(spec("algo.anomaly.pca", rank=1), rows, None, ["x", "y"])
    return training.score(t, rows).select(*_IDS, F.round("Score", 5).alias("score"))


@query("with s as (select value as x, row_number() over (order by event_id) as k from events where value is not null), l as (select unnest(range(6)) as lag), v as (select k - lag as start, lag, x from s, l where k > lag and k - lag <= (select count(*) from s) - 5) select a.lag::int as i, b.lag::int as j, round(sum(a.x * b.x), 2) as product from v a join v b using (start) group by 1, 2")
def m25_lag_products(spark, d):
    """Products of the lagged vectors of one series of all events, in pieces of 500 values."""
    placed = series.placed(_t(spark, d, "events"), "value", "event_id")
    products = series.lag_products(placed, 6, piece=500)
    return products.select((F.col("cell") / 6).cast("int").alias("i"), (F.col("cell") % 6).cast("int").alias("j"), F.round("product", 2).alias("product"))


@query()
def m25_forecast(spark, d):
    daily = _t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    enough = daily.groupBy("event_type").agg(F.count(F.lit(1)).alias("days")).where("days >= 8")
    return custom.forecast(daily.join(F.broadcast(enough), "event_type"), "n", "day", 5, 4, 60, ["event_type"])


@query()
def m27_text_classes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("Label"))
    t = training.train(spec("algo.nlp.textClassification", textColumn="text"), docs, "Label")
    return training.score(t, docs).select("doc_id", "PredictedLabel")


@query()
def e3_cross_validation(spark, d):
    df = _flags(spark, d).select(*_IDS, *_FEATURES[:3], "Label")
    rows, _ = training.cross_validate(spec("algo.bin.logistic", maximumNumberOfIterations=10), df, "Label", _FEATURES[:3], 3, ids=_IDS)
    return spark.createDataFrame(rows, "metric string, mean double, std_dev double, min double, max double")


@query()
def e4_parameter_sweep(spark, d):
    df = _t(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("Label"))
    rows, _ = training.sweep(spec("algo.reg.fastTree", numberOfTrees=2), df, "Label", "numberOfLeaves: 4, -1", features=["p_size", "p_partkey"], ids=["p_partkey"])
    return spark.createDataFrame(rows, T.StructType([T.StructField("numberOfLeaves", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())]))


@query()
def e5_automatic_search(spark, d):
    df = _t(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("Label"))
    rows, _ = training.auto_ml(df, "Label", "Regression", 10, ids=["p_partkey"])
    return spark.createDataFrame([(r["rank"], r["algorithm"], float(r["score"])) for r in rows], "rank int, algorithm string, score double")


@query()
def e16_feature_importance(spark, d):
    df = _flags(spark, d).select(*_FEATURES[:3], "Label")
    t = training.train(spec("algo.bin.logistic", l1Regularization=0.0, l2Regularization=0.001, maximumNumberOfIterations=10), df, "Label")
    return spark.createDataFrame(training.feature_importance(t, df), "feature string, importance double")
