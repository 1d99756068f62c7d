"""Scalar rules, row rules, header evidence and renderings on the parquet tables, each with an equivalent SQL text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import cells as X
from ..operators import bands, header, merges, profile, render
from .catalogue import BANDS, EV, QUERIES, SQL, _event_bands, _events, _t, query

__all__ = ["QUERIES", "SQL"]

LABELS = ["Date", " Period : ", "YEAR", "Order Qtr", "날짜별", "amount", ":month:", "quarter-end", "기간", "dates", "  "]

def _sql_list(items) -> str:
    return ",".join("'" + x.replace("'", "''") + "'" for x in items)


def _some(key, items):
    """One of ``items`` by a key."""
    return F.element_at(F.array(*map(F.lit, items)), (key % len(items) + 1).cast("int"))


@query(
    f"with t as (select c_custkey, [{_sql_list(LABELS)}][c_custkey%{len(LABELS)}+1] label from customer),"
    " c as (select *, lower(trim(regexp_replace(trim(label), '^:+|:+$', '', 'g'))) gate_text, lower(trim(label)) low from t)"
    f" select c_custkey, label, gate_text in ({_sql_list(C.AXIS_LABELS_GATE)}) gate, low in ({_sql_list(C.AXIS_LABELS_BONUS)}) bonus,"
    f" len(list_intersect(regexp_split_to_array(low,'[^a-z0-9]+'), [{_sql_list(C.AXIS_TOKENS_ROWS)}]))>0 or regexp_matches(low, '{'|'.join(C.AXIS_PARTS_ROWS)}') rows_rule from c"
)
def axis_label_rules(spark, d):
    t = _t(spark, d, "customer").select("c_custkey", _some(F.col("c_custkey"), LABELS).alias("label"))
    label = F.col("label")
    return t.select("c_custkey", "label", X.axis_label_gate(label).alias("gate"), X.axis_label_bonus(label).alias("bonus"), X.axis_label_rows(label).alias("rows_rule"))


@query(
    "with t as (select o_orderkey k, 'int' kind, o_orderkey l, cast(null as double) d from orders union all select o_orderkey, 'float', null, case when o_orderkey%2=0 then floor(o_totalprice/30) else o_totalprice/30 end from orders union all select o_orderkey, 'datetime', null, null from orders union all select o_orderkey, 'time', null, null from orders),"
    " y as (select *, kind in ('datetime','time') or coalesce(l between 1000 and 9999, false) or coalesce(d=floor(d) and d between 1000 and 9999, false) axis from t)"
    " select k as o_orderkey, kind, axis gate, kind='datetime' bonus, axis rows_rule, kind in ('datetime','time') strict from y"
)
def axis_value_kinds(spark, d):
    o = _t(spark, d, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double") / 30
    none_l, none_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    of = lambda kind, l, x: o.select("o_orderkey", F.lit(kind).alias("kind"), l.alias("l"), x.alias("d"))  # noqa: E731, E741
    t = of("int", key.cast("long"), none_d).union(of("float", none_l, F.when(key % 2 == 0, F.floor(price)).otherwise(price).cast("double")))
    t = t.union(of("datetime", none_l, none_d)).union(of("time", none_l, none_d))
    a = (F.col("kind"), F.lit(None).cast("string"), F.col("l"), F.col("d"))
    return t.select("o_orderkey", "kind", X.axis_value_gate(*a).alias("gate"), X.axis_value_bonus(*a[:2]).alias("bonus"), X.axis_value_rows(*a).alias("rows_rule"), X.axis_value_strict(*a[:2]).alias("strict"))


NUMBERS = ["12", " 1_000 ", "abc", "", "1e5", "nan", ".5", "5.", "1__0", "-inf", "+3.25E-2", "1 2", "   "]


@query(
    f"with t as (select c_custkey, case when c_custkey%5=0 then 'int' when c_custkey%5=1 then 'bool' else 'string' end kind, [{_sql_list(NUMBERS)}][c_custkey%{len(NUMBERS)}+1] s from customer),"
    r" f as (select *, regexp_full_match(lower(trim(s)), '[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|[+-]?(inf(inity)?|nan)') num from t)"
    " select c_custkey, kind, s, num float_like, kind='int' or (kind='string' and (trim(s)='' or num)) measure from f"
)
def numeric_rules(spark, d):
    key = F.col("c_custkey")
    t = _t(spark, d, "customer").select("c_custkey", F.when(key % 5 == 0, "int").when(key % 5 == 1, "bool").otherwise("string").alias("kind"), _some(key, NUMBERS).alias("s"))
    return t.select("c_custkey", "kind", "s", X.float_like(F.col("s")).alias("float_like"), X.numeric_measure(F.col("kind"), F.col("s")).alias("measure"))


KINDS = ["string", "int", "float", "bool", "date", "datetime", "time"]


@query(
    f"with t as (select l_orderkey, l_linenumber, [{_sql_list(KINDS)}][(l_orderkey+l_linenumber)%7+1] kind, case when l_orderkey%2=0 then strftime(l_shipdate, '%Y-%m-%d') else strftime(l_shipdate, '%Y') end s from lineitem)"
    " select l_orderkey, l_linenumber, case when kind='string' then 'string' when kind in ('int','float') then 'number' when kind in ('date','datetime','time') then 'date' else 'other' end category,"
    " case when kind in ('date','datetime','time') or (kind='string' and length(s)>4) then 'date' when kind in ('int','float') then 'number' when kind='string' then 'text' else 'other' end value_kind from t"
)
def cell_categories(spark, d):
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = F.when(key % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "yyyy"))
    t = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _some(key + n, KINDS).alias("kind"), s.alias("s"))
    return t.select("l_orderkey", "l_linenumber", X.category().alias("category"), profile.value_kind(F.col("kind"), F.col("s")).alias("value_kind"))


@query(
    "with t as (select l_orderkey, l_linenumber, cast(l_suppkey%12+1 as int) width, least(l_suppkey%12+1, l_linenumber) filled, l_partkey%3=0 axis, case when l_partkey%4=0 then null else l_partkey%4=1 end head_axis, case when l_partkey%5=0 then null else true end head_filled, l_partkey%2=0 strict from lineitem)"
    " select l_orderkey, l_linenumber, filled/width<0.3 or (filled=1 and width>=3) thin, width>=8 and filled>0 and axis wide_data, axis and (coalesce(head_axis,false) or (head_filled is null and strict)) axis_data from t"
)
def thin_row_rules(spark, d):
    p, width = F.col("l_partkey"), (F.col("l_suppkey") % 12 + 1).cast("int")
    t = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", width.alias("width"), F.least(width, F.col("l_linenumber")).alias("filled"), (p % 3 == 0).alias("axis"), F.when(p % 4 != 0, p % 4 == 1).alias("head_axis"), F.when(p % 5 != 0, True).alias("head_filled"), (p % 2 == 0).alias("strict"))
    c = F.col
    return t.select("l_orderkey", "l_linenumber", X.thin_row(c("filled"), c("width")).alias("thin"), X.wide_rescue(c("filled"), c("width"), c("axis")).alias("wide_data"), X.axis_rescue(c("axis"), c("strict"), c("head_axis"), c("head_filled")).alias("axis_data"))


LETTERS = "(case when {n}<=26 then chr(cast(64+{n} as int)) when {n}<=702 then chr(cast(65+({n}-27)//26 as int)) || chr(cast(65+({n}-27)%26 as int)) else chr(cast(65+({n}-703)//676 as int)) || chr(cast(65+({n}-703)//26%26 as int)) || chr(cast(65+({n}-703)%26 as int)) end)"


@query(
    "with t as (select o_orderkey, cast(case when o_orderkey%9=0 then null else o_orderkey%16384+1 end as int) l, cast(case when o_orderkey%7=0 then null else o_orderkey%16384+1+o_custkey%5 end as int) r, cast(o_orderkey%50+1 as int) s, cast(case when o_orderkey%4=0 then null else o_orderkey%40 end as int) e from orders)"
    f" select o_orderkey, case when l is not null and r is not null then {LETTERS.format(n='l')} || ':' || {LETTERS.format(n='r')} end usecols, coalesce(l,1) first_col, greatest(coalesce(r,20000),coalesce(l,1)) last_col, s-1 header, case when e is null then null else greatest(e-s+1,0) end n_rows from t"
)
def read_plan_fields(spark, d):
    key = F.col("o_orderkey")
    int_ = lambda x: x.cast("int")
    t = _t(spark, d, "orders").select("o_orderkey", int_(F.when(key % 9 != 0, key % 16384 + 1)).alias("l"), int_(F.when(key % 7 != 0, key % 16384 + 1 + F.col("o_custkey") % 5)).alias("r"), int_(key % 50 + 1).alias("s"), int_(F.when(key % 4 != 0, key % 40)).alias("e"))
    first, last = X.table_span(F.col("l"), F.col("r"), F.lit(20000))
    rows = F.when(F.col("e").isNotNull(), X.row_count(F.col("s"), F.col("e")))
    return t.select("o_orderkey", X.a1_span(F.col("l"), F.col("r")).alias("usecols"), first.alias("first_col"), last.alias("last_col"), X.base0(F.col("s")).alias("header"), rows.alias("n_rows"))


SPACED = ["  two words ", ":Label:", " : Period:: ", " hard ", "　wide　", "plain", "::", ""]


@query(
    f"with t as (select s_suppkey, [{_sql_list(SPACED)}][s_suppkey%{len(SPACED)}+1] label from supplier), s as (select *, trim(label, ' ' || chr(160) || chr(12288)) x from t)"
    " select s_suppkey, x as stripped, lower(trim(regexp_replace(x, '^:+|:+$', '', 'g'), ' ' || chr(160) || chr(12288))) cleaned from s"
)
def label_cleaning(spark, d):
    t = _t(spark, d, "supplier").select("s_suppkey", _some(F.col("s_suppkey"), SPACED).alias("label"))
    return t.select("s_suppkey", X.strip(F.col("label")).alias("stripped"), X.clean_label(F.col("label")).alias("cleaned"))


@query(
    "with r as (select l_suppkey g, l_partkey, l_quantity, l_shipdate, row_number() over(partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey)+1 as row from lineitem qualify row<=9),"
    " a as (select distinct g, 1 as row, 1 col, [ 'Date','Period','name' ][g%3+1] s from r union all select distinct g, 1, c, case when (g+c)%4=0 then 'plain' else 'a:b:' || g || '/' || c end from r, (select unnest([2,3,4,5]) c)),"
    " v as (select g, row, 1 col, 'string' kind, case when (g+row)%7=0 then 'x' else strftime(l_shipdate,'%Y-%m') end s from r union all select g, row, c, case when (l_partkey+c)%9=0 then 'string' else 'float' end, 'n/x' from r, (select unnest([2,3,4,5]) c)),"
    " h as (select g, count(*) filter(where col>1) labels, count(*) filter(where col>1 and s<>'plain') codes, max(case when col=1 then lower(s) end) axis from a group by g),"
    " b as (select g, count(*) filter(where col=1) vals, count(*) filter(where col=1 and s<>'x') dates, count(*) filter(where col>1) measures, count(*) filter(where col>1 and kind='float') nums from v where row<=6 group by g)"
    " select g as l_suppkey, 1 as row, 0.25::double as bonus from h join b using(g) where axis in ('date','period') and labels>=3 and codes>=0.6*labels and vals>=2 and dates>=0.8*vals and nums>=0.8*measures"
)
def timeseries_header_bonus(spark, d):
    """Sheets of a time column and coded series, one a supplier; row 1 is the header."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    r = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), "l_partkey", "l_shipdate", (F.row_number().over(order) + 1).alias("row")).filter("row <= 9")
    g, cols = F.col("g"), F.explode(F.array(*map(F.lit, range(2, 6)))).alias("col")
    groups = r.select("g").distinct()
    cell = lambda df, row, col, kind, s: df.select(g.alias("g"), row.alias("row"), col.alias("col"), kind.alias("kind"), s.alias("s"))
    text = F.lit("string")
    c = F.col("col")
    cells = cell(groups, F.lit(1), F.lit(1), text, _some(g, ["Date", "Period", "name"]))
    cells = cells.union(cell(groups.select("g", cols), F.lit(1), c, text, F.when((g + c) % 4 == 0, "plain").otherwise(F.concat(F.lit("a:b:"), g, F.lit("/"), c))))
    cells = cells.union(cell(r, F.col("row"), F.lit(1), text, F.when((g + F.col("row")) % 7 == 0, "x").otherwise(F.date_format("l_shipdate", "yyyy-MM"))))
    cells = cells.union(cell(r.select("*", cols), F.col("row"), c, F.when((F.col("l_partkey") + c) % 9 == 0, "string").otherwise("float"), F.lit("n/x")))
    return header.timeseries_bonus(cells, ["g"]).select(g.alias("l_suppkey"), "row", "bonus")


@query(
    "with r as (select l_suppkey g, l_orderkey, l_shipdate, row_number() over(partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as row from lineitem qualify row<=12),"
    " v as (select g, row, case when row<=1+g%3 then (case when (g+row)%4=0 then 'date' when (g+row)%4=1 then null else 'title' end) when (g+row)%6=0 then 'x' else strftime(l_shipdate,'%Y-%m') end s, 6+(l_orderkey%4) others from r),"
    " p as (select g, row, s, coalesce(regexp_full_match(s,'[0-9]{4}-[0-9]{2}'), false) axis, others + case when s is null then 0 else 1 end filled from v),"
    " w as (select *, count(*) filter(where axis) over(partition by g order by row rows between 1 following and 3 following) below, coalesce(lead(axis) over(partition by g order by row), false) nxt from p)"
    " select g as l_suppkey, min(row) header_row from w where filled>=8 and below>=2 and (s='date' or (s is null and nxt)) group by g"
)
def wide_axis_header(spark, d):
    """Wide sheets of ten columns, one a supplier, with a time axis in the first column."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    g, row = F.col("g"), F.col("row")
    r = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_shipdate", F.row_number().over(order).alias("row")).filter("row <= 12")
    top = F.when((g + row) % 4 == 0, "date").when((g + row) % 4 != 1, "title")
    s = F.when(row <= 1 + g % 3, top).otherwise(F.when((g + row) % 6 == 0, "x").otherwise(F.date_format("l_shipdate", "yyyy-MM")))
    axis = r.select("g", "row", F.lit(1).alias("col"), F.lit("string").alias("kind"), s.alias("s")).filter("s IS NOT NULL")
    rest = r.select("g", "row", F.explode(F.sequence(F.lit(2), (F.col("l_orderkey") % 4 + 7).cast("int"))).alias("col"), F.lit("int").alias("kind"), F.lit(None).cast("string").alias("s"))
    cells = axis.union(rest).withColumns({"l": F.lit(1).cast("long"), "d": F.lit(None).cast("double")})
    extents = r.groupBy("g").agg(F.max("row").alias("n"), F.lit(10).alias("width"))
    wide = header.wide_axis_rows(cells, extents, ["g"])
    # scores that favour the last row, so that only the rule can choose another one
    scores = r.select("g", "row", (row / 100.0).cast("double").alias("score"))
    last = extents.select("g", F.col("n").alias("last"))
    picked = header.pick_header(scores, wide, ["g"]).join(last, "g").filter("header_row < last")
    return picked.select(g.alias("l_suppkey"), F.col("header_row").cast("long").alias("header_row"))


@query(
    f"with {EV}, real as (select user_id, row as col from ev where value>=50), mg as (select user_id, row lo, row + cast(floor(value) as int)%4 hi, cast(event_id%3 as int) r0, cast(event_id%3 + event_id%2 as int) r1 from ev where event_type='click'),"
    " c as (select user_id, col from real union select user_id, unnest(range(lo, hi+1)) from mg where r0<=2 and r1>=2),"
    " a as (select user_id, col - row_number() over(partition by user_id order by col) g, col from c), r as (select user_id, g, min(col) l, max(col) r, count(*) w from a group by 1,2)"
    " select user_id, arg_max(l, (w, -l)) left_col, arg_max(r, (w, -l)) right_col, count(*)>1 gapped from r group by 1"
)
def merged_header_span(spark, d):
    e = _events(spark, d)
    m = e.filter("event_type = 'click'").select("user_id", F.col("row").alias("min_col"), (F.col("row") + F.floor("value").cast("int") % 4).alias("max_col"), (F.col("event_id") % 3).cast("int").alias("min_row"), (F.col("event_id") % 3 + F.col("event_id") % 2).cast("int").alias("max_row"), F.lit(2).alias("header_row"))
    return bands.longest_run(merges.filled_header(e.filter("value >= 50").select("user_id", F.col("row").alias("col")), m, ["user_id"]), ["user_id"])


@query(
    "with c as (select l_orderkey g, l_linenumber col, 2 as row, 'c' || l_partkey label from lineitem union all select l_orderkey, l_linenumber, 1, 'g' || l_suppkey from lineitem where l_linenumber%3=1),"
    " x as (select distinct g, label, unnest([col, col+1]) col from c where row=1),"
    " b as (select g, col, label from c where row=2 group by all)"
    " select b.g as l_orderkey, b.col, b.label leaf, x.label as group_label from b left join x on x.g=b.g and x.col=b.col"
)
def group_label_fill(spark, d):
    """Groups over two columns each, the third one bare: a label ends with its merge."""
    l = _t(spark, d, "lineitem")  # noqa: E741
    leaf = l.select("l_orderkey", F.lit(2).alias("row"), F.col("l_linenumber").alias("col"), F.concat(F.lit("c"), F.col("l_partkey")).alias("label")).distinct()
    top = l.filter("l_linenumber % 3 = 1").select("l_orderkey", F.lit(1).alias("row"), F.col("l_linenumber").alias("col"), F.concat(F.lit("g"), F.col("l_suppkey")).alias("label")).distinct()
    m = top.select("l_orderkey", F.col("row").alias("min_row"), F.col("row").alias("max_row"), F.col("col").alias("min_col"), (F.col("col") + 1).alias("max_col")).distinct()
    found = merges.level_labels(leaf.union(top), m, ["l_orderkey"])
    groups = found.filter("row = 1").select("l_orderkey", "col", F.col("label").alias("group_label")).distinct()
    return found.filter("row = 2").select("l_orderkey", "col", F.col("label").alias("leaf")).join(groups, ["l_orderkey", "col"], "left")


@query(
    f"with {EV}, {BANDS}, o as (select distinct user_id, cast(5 + user_id%17 as int) header_row from ev)"
    " select o.user_id, o.header_row, b.band_no, b.band_no is null as unplaced from o left join bands b on o.user_id=b.user_id and o.header_row between start_row and end_row"
)
def sheet_override_band(spark, d):
    o = _events(spark, d).select("user_id", (5 + F.col("user_id") % 17).cast("int").alias("header_row")).distinct()
    hit = merges.anchored(o, _event_bands(spark, d), ["user_id"], anchor="header_row")
    return hit.select("user_id", "header_row", "band_no", F.col("band_no").isNull().alias("unplaced"))


@query(
    "with n as (select n_nationkey, n_name, n_regionkey, row_number() over(order by n_nationkey) r from nation)"
    " select 0::bigint n, '| n_nationkey | n_name | n_regionkey |' line union all select 1, '| --- | --- | --- |' union all select r+1, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' from n where r<=20 union all select 22, '… ' || (count(*)-20) || ' more rows' from n having count(*)>20"
)
def markdown_table(spark, d):
    return render.markdown_table(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query(
    "with c as (select c_custkey, c_name from customer order by c_custkey limit 30) select (select count(*) from customer) row_count, '[' || string_agg('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}', ',' order by c_custkey) || ']' records from c"
)
def json_table(spark, d):
    return render.json_table(_t(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 30)


@query(
    f"with {EV}, m as (select user_id, row min_row, row + cast(floor(value) as int)%6 max_row, cast(event_id%4 as int) min_col, cast(event_id%4+event_id%3 as int) max_col from ev where event_type='click')"
    " select user_id, min_row, max_row, min_col, max_col, row_number() over(partition by user_id order by min_row, min_col, max_row, max_col) as position from m"
)
def merge_order(spark, d):
    e = _events(spark, d).filter("event_type = 'click'")
    m = e.select("user_id", F.col("row").alias("min_row"), (F.col("row") + F.floor("value").cast("int") % 6).alias("max_row"), (F.col("event_id") % 4).cast("int").alias("min_col"), (F.col("event_id") % 4 + F.col("event_id") % 3).cast("int").alias("max_col"))
    return merges.positioned(m, ["user_id"]).withColumn("position", F.col("position").cast("long"))
