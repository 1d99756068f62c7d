"""Every operator applied to the parquet tables, each with an equivalent SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import cells as X
from ..operators import bands, body, header, merges, names, profile, render, tabular
from ..sources.grid import cells_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return _t(spark, d, "events").select("user_id", "event_id", "event_type", "value", rn.alias("row"))


EV = "ev as (select user_id, event_id, event_type, value, row_number() over(partition by user_id order by event_id) as row from events)"
BANDS = (
    "b0 as (select user_id, row, lag(row) over(partition by user_id order by row) p from ev where value >= 35),"
    " b1 as (select user_id, row, sum(case when p is null or row-p-1>=2 then 1 else 0 end) over(partition by user_id order by row) band_no from b0),"
    " bands as (select user_id, cast(band_no as int) band_no, min(row) start_row, max(row) end_row from b1 group by all)"
)


def _event_bands(spark, d) -> DataFrame:
    return bands.band_extents(_events(spark, d).filter("value >= 35"), ["user_id"])


@query(f"with {EV}, {BANDS} select user_id, band_no, start_row, end_row from bands")
def band_split_events(spark, d):
    return _event_bands(spark, d)


@query(
    "with l as (select doc_id, generate_subscripts(string_split(text, chr(10)),1) as row, unnest(string_split(text, chr(10))) as line from documents),"
    " a as (select doc_id, row, lag(row) over(partition by doc_id order by row) p from l where length(line) >= 60),"
    " b as (select doc_id, row, sum(case when p is null or row-p-1>=2 then 1 else 0 end) over(partition by doc_id order by row) n from a)"
    " select doc_id, cast(n as int) band_no, cast(min(row) as int) start_row, cast(max(row) as int) end_row from b group by doc_id, n"
)
def text_line_bands(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.length("line") >= 60).select("doc_id", (F.col("p") + 1).cast("int").alias("row"))
    return bands.band_extents(lines, ["doc_id"])


SAMPLE = "(((k*least({s},n)+n-1)//n)*n) < (k+1)*least({s},n)"


@query(
    "with a as (select o_orderpriority, o_orderkey, row_number() over(partition by o_orderpriority order by o_orderkey)-1 k, count(*) over(partition by o_orderpriority) n from orders)"
    f" select o_orderpriority, o_orderkey from a where {SAMPLE.format(s=200)}"
)
def even_sample_orders(spark, d):
    return profile.even_sample(_t(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"])


NULL_TABLES = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


@query(
    " union all ".join(
        f"select '{t}' as \"table\", '{c}' as \"column\", count(*) as rows, count(*)-count({c}) as nulls, round((count(*)-count({c}))/count(*), 4) as null_ratio from (select * replace (nullif({c}, (select min({c}) from {t})) as {c}) from {t})"
        for t, cs in NULL_TABLES.items()
        for c in cs
    )
)
def column_null_ratio(spark, d):
    """Each column's least value counts as missing here, so that there are nulls."""
    out = []
    for t, cs in NULL_TABLES.items():
        df = _t(spark, d, t)
        low = df.agg(*[F.min(c).alias(f"_{c}") for c in cs])
        df = df.crossJoin(F.broadcast(low)).select(*[F.nullif(F.col(c), F.col(f"_{c}")).alias(c) for c in cs])  # one row
        out.append(profile.null_ratios(df, cs).select(F.lit(t).alias("table"), "*"))
    return reduce(DataFrame.union, out)


PROFILED = ["o_orderstatus", "price", "o_orderdate", "year_text", "mixed"]


@query(
    "with a as (select o_orderpriority g, o_orderstatus, round(o_totalprice,2) price, o_orderdate, case when o_orderkey%10=0 then null else cast(year(o_orderdate) as varchar) end year_text, case when o_orderkey%3=0 then o_orderstatus else cast(o_orderkey as varchar) end mixed,"
    " row_number() over(partition by o_orderpriority order by o_orderkey)-1 k, count(*) over(partition by o_orderpriority) n from orders),"
    f" s as (select * from a where {SAMPLE.format(s=200)}),"
    " u as (select g, 1 col, 'string' kind, o_orderstatus s from s union all select g, 2, 'float', null from s union all select g, 3, 'datetime', null from s union all select g, 4, 'string', year_text from s where year_text is not null union all select g, 5, 'string', mixed from s),"
    " c as (select g, col, count(*) f, count(*) filter(where kind='datetime') dt, count(*) filter(where kind='float') nu, count(*) filter(where kind='string') st, count(*) filter(where kind='string' and regexp_full_match(s, '[0-9]+')) nt from u group by all),"
    " z as (select g, count(*) sampled from s group by g)"
    " select g as o_orderpriority, col, case when f=0 then 'text' when dt>=f*0.95 then 'date' when nu+nt>=f*0.95 then (case when st=f then 'numeric_text' else 'number' end) when st=f then 'text' else 'mixed' end inferred_type, round(1-f/sampled,6) null_ratio from c join z using(g)"
)
def column_type_profile(spark, d):
    key = F.col("o_orderkey")
    df = _t(spark, d, "orders").select(
        "o_orderpriority",
        "o_orderkey",
        "o_orderstatus",
        F.round("o_totalprice", 2).alias("price"),
        "o_orderdate",
        F.when(key % 10 != 0, F.year("o_orderdate").cast("string")).alias("year_text"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise(key.cast("string")).alias("mixed"),
    )
    sample = profile.even_sample(df, ["o_orderpriority"], ["o_orderkey"])
    cells = cells_of(sample.withColumn("row", F.lit(1)), ["o_orderpriority"], "row", PROFILED)
    rows = sample.groupBy("o_orderpriority").agg(F.count("*").alias("sampled"))
    return profile.profile_columns(cells, ["o_orderpriority"], rows).select("o_orderpriority", "col", "inferred_type", F.round("null_ratio", 6).alias("null_ratio"))


@query(
    f"with {EV}, s as (select user_id, row, 1 col from ev where row<=20 and value>=35 union all select user_id, row, 2 from ev where row<=20 and event_type='view' union all select user_id, row, 3 from ev where row<=20 and value>=70),"
    " a as (select user_id, count(distinct col) columns, count(distinct row) rows, count(*) filled from s group by 1)"
    " select user_id, columns, rows, filled, round(filled/(columns*rows),9) density, columns>1 and filled/(columns*rows)>=0.5 is_tabular from a"
)
def density_gate(spark, d):
    e = _events(spark, d).filter(F.col("row") <= C.SAMPLE_ROWS)
    grid = e.select("user_id", "row", F.when(F.col("value") >= 35, F.col("value")).alias("c1"), F.when(F.col("event_type") == "view", F.col("event_type")).alias("c2"), F.when(F.col("value") >= 70, F.col("value")).alias("c3"))
    return tabular.tabular(cells_of(grid, ["user_id"], "row", ["c1", "c2", "c3"]), ["user_id"]).withColumn("density", F.round("density", 9))


WIDE = 11


@query(
    "with m as (select l_suppkey g, strftime(l_shipdate,'%Y-%m') period, l_linenumber + 1 as col from lineitem where l_linenumber<=7 union select l_suppkey, strftime(l_shipdate,'%Y-%m'), 9 + l_partkey%3 from lineitem),"
    " r as (select *, dense_rank() over(partition by g order by period) as row from m),"
    " s as (select g, row, col from r where row<=20 union select g, row, 1 from r where row<=20 and row>1),"
    " w as (select g, count(distinct col) width from s group by 1),"
    " f as (select g, row, count(distinct col) filled, max(case when col=1 then 1 else 0 end) axis from s group by 1,2),"
    " x as (select g, row, filled, sum(axis) over(partition by g order by row rows between 1 following and 3 following) below from f)"
    " select distinct g as l_suppkey from x join w using(g) where width>=8 and filled>=0.8*width and below>=2"
)
def wide_sparse_gate(spark, d):
    l = _t(spark, d, "lineitem")  # noqa: E741
    period = F.date_format("l_shipdate", "yyyy-MM")
    m = l.filter("l_linenumber <= 7").select("l_suppkey", period.alias("period"), (F.col("l_linenumber") + 1).alias("col")).union(l.select("l_suppkey", period, (9 + F.col("l_partkey") % 3).cast("int")))
    r = m.distinct().withColumn("row", F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("period"))).filter(F.col("row") <= C.SAMPLE_ROWS)
    null = lambda t: F.lit(None).cast(t)
    body_ = r.select("l_suppkey", "row", "col", F.lit("int").alias("kind"), null("string").alias("s"), F.lit(1).cast("long").alias("l"), null("double").alias("d"))
    axis = r.filter("row > 1").select("l_suppkey", "row", F.lit(1).alias("col"), F.lit("string").alias("kind"), F.col("period").alias("s"), null("long").alias("l"), null("double").alias("d")).distinct()
    return tabular.wide_sparse(body_.union(axis), ["l_suppkey"])


FIELDS = (
    "l as (select doc_id g, generate_subscripts(string_split(text, chr(10)),1) r, unnest(string_split(text, chr(10))) line from documents),"
    " f as (select g, r, generate_subscripts(string_split(line,' '),1) c, unnest(string_split(line,' ')) v from l where r<=20),"
    " cells as (select g, r, c, case when regexp_full_match(v,'[0-9]+') then 'number' when length(v)%5=0 then 'date' else 'string' end k, length(v) len from f where c<=6 and v<>''),"
    " ext as (select g, max(r) n, max(c) w from cells group by g)"
)
SCORES = (
    "cand as (select g,w,n,unnest(range(1,n+1)) r from ext), grid as (select cand.*, unnest(range(1,w+1)) c from cand),"
    " below as (select g.g,g.r,g.c,b.k,count(*) cnt,min(b.r) first_r,sum(b.len) sl from grid g join cells b on b.g=g.g and b.c=g.c and b.r>g.r and b.r<=g.r+5 group by all),"
    " col as (select g,r,c,max(cnt)*1.0/sum(cnt) cons, arg_max(k, cnt*1000-first_r) dom, sum(sl)*1.0/sum(cnt) ml from below group by all),"
    " j as (select g.g,g.r,g.w,least(5,g.n-g.r) nb,x.k ck,coalesce(x.len,0) cl,col.cons,col.dom,col.ml from grid g left join cells x on x.g=g.g and x.r=g.r and x.c=g.c left join col on col.g=g.g and col.r=g.r and col.c=g.c),"
    " scored as (select g,r,least(1.0, .5*count(*) filter (where ck='string')/w + .3*coalesce(sum(cons),0)/w*nb/5.0 + case when nb=0 then 0 else .2*sum(case when dom is null then (case when ck is null then 0 else 1 end) else ((case when ck is distinct from dom then 1 else 0 end)+abs(cl-ml)/greatest(cl,ml,1.0))/2.0 end)/w end) score from j group by g,r,w,nb)"
)


def _fields(spark, d, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and extents of the scanned lines; with ``limit``, of each line's first fields only."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("g"), "text").repartition("g")  # fields of a document stay together
    lines = docs.select("g", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.col("p") < C.HEADER_SCAN_ROWS)
    v = F.col("v")
    cells = lines.select("g", (F.col("p") + 1).alias("row"), F.posexplode(F.split("line", " ")).alias("q", "v")).filter(v != "")
    if limit is not None:
        cells = cells.filter(F.col("q") < limit)
    cells = cells.select("g", "row", (F.col("q") + 1).alias("col"), F.when(v.rlike("^[0-9]+$"), "number").when(F.length(v) % 5 == 0, "date").otherwise("string").alias("cat"), F.length(v).alias("len"))
    return cells, cells.groupBy("g").agg(F.max("row").alias("n"), F.max("col").alias("width"))


def _scores(spark, d, limit: int | None = None) -> DataFrame:
    return header.score_rows(*_fields(spark, d, limit), ["g"]).withColumn("score", F.round("score", 6))


def _picks(scores: DataFrame) -> DataFrame:
    none = scores.limit(0).select("g", "row", F.lit(True).alias("dense"), F.lit(0).alias("axis_below"), F.lit(False).alias("axis_next"), F.lit(False).alias("label"), F.lit(False).alias("blank"), F.lit(0).alias("width"))
    return header.pick_header(scores, none, ["g"]).select("g", F.col("header_row").cast("long").alias("header_row"))


#: Fields of a line that the SQL texts of header_score and header_pick read; the queries *_all_fields read every one.
SQL_FIELDS = 6


@query(f"with {FIELDS}, {SCORES} select g, r as row, round(score, 6) score from scored")
def header_score(spark, d):
    return _scores(spark, d, SQL_FIELDS).withColumn("row", F.col("row").cast("long"))


@query(f"with {FIELDS}, {SCORES}, q as (select g, r, round(score,6) s from scored) select g, arg_max(r, (s, -r)) as header_row from q group by g")
def header_pick(spark, d):
    return _picks(_scores(spark, d, SQL_FIELDS))


@query()
def header_score_all_fields(spark, d):
    return _scores(spark, d).withColumn("row", F.col("row").cast("long"))


@query()
def header_pick_all_fields(spark, d):
    return _picks(_scores(spark, d))


@query(
    "with v as (select p_partkey k, p_brand || ':' || p_type || '/' || p_partkey t from part union all select c_custkey, c_name from customer union all select o_orderkey, o_orderpriority || ':' || o_orderstatus from orders)"
    " select k, t as label from v where length(t)<=40 and regexp_full_match(t,'[A-Za-z0-9][A-Za-z0-9:_./-]*') and length(regexp_replace(t,'[^:_./-]','','g'))>=2 and regexp_matches(t,'[A-Za-z]')"
)
def code_label_filter(spark, d):
    part, cust, orders = (_t(spark, d, t) for t in ("part", "customer", "orders"))
    v = part.select(F.col("p_partkey").alias("k"), F.concat_ws(":", "p_brand", F.concat_ws("/", "p_type", "p_partkey")).alias("label"))
    v = v.union(cust.select("c_custkey", "c_name")).union(orders.select("o_orderkey", F.concat_ws(":", "o_orderpriority", "o_orderstatus")))
    return v.filter(X.code_like(F.col("label")))


FORMS = ("%Y-%m-%d", "%Y/%m", "%m/%d/%Y", "%B %d, %Y", "%Y", "%d.%m.%Y")
JAVA_FORMS = ("yyyy-MM-dd", "yyyy/MM", "MM/dd/yyyy", "MMMM dd, yyyy", "yyyy", "dd.MM.yyyy")


@query(
    "with f as (select o_orderkey, unnest(["
    + ",".join(f"strftime(o_orderdate,'{f}')" for f in FORMS)
    + "]) t, generate_subscripts([1,2,3,4,5,6],1) form from orders)"
    " select cast(form as int) form, count(*) n, count(*) filter(where regexp_matches(t, '^[0-9]{4}([-/.][0-9]{1,2}([-/.][0-9]{1,2})?)?$')) gate,"
    " count(*) filter(where regexp_full_match(t, '[0-9]{4}([-/][0-9]{1,2}([-/][0-9]{1,2})?)?')) bonus,"
    f" count(*) filter(where regexp_matches(lower(t), '{C.ROW_VALUE}')) rows_rule from f group by form"
)
def time_axis_filter(spark, d):
    t = _t(spark, d, "orders").select(F.posexplode(F.array(*[F.date_format("o_orderdate", f) for f in JAVA_FORMS])).alias("p", "t"))
    kind, s, none_l, none_d = F.lit("string"), F.col("t"), F.lit(None).cast("long"), F.lit(None).cast("double")
    on = lambda c: F.count(F.when(c, 1))
    return t.groupBy((F.col("p") + 1).cast("int").alias("form")).agg(
        F.count("*").alias("n"), on(X.axis_value_gate(kind, s, none_l, none_d)).alias("gate"), on(X.axis_value_bonus(kind, s)).alias("bonus"), on(X.axis_value_rows(kind, s, none_l, none_d)).alias("rows_rule")
    )


@query("select l_returnflag, l_linestatus, count(*) n, cast(sum(cast(l_quantity as bigint)) as bigint) qty from lineitem group by all")
def subtotal_exclusion(spark, d):
    """A report with its own subtotal and total rows, loaded without them."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    report = _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    label = F.when(flag.isNull(), "Grand Total").when(status.isNull(), F.concat(F.lit("Subtotal "), flag)).otherwise(flag)
    return report.withColumn("label", label).filter(~X.keyword_hit(F.col("label"))).select("l_returnflag", "l_linestatus", "n", "qty")


BODY = (
    "a as (select *, c='B' and coalesce(lag(c) over(partition by user_id order by row)='B', false) dbl from t),"
    " stop as (select user_id, min(row) filter (where dbl) s from a group by 1),"
    " live as (select a.* from a join stop using(user_id) where s is null or row < s-1),"
    " lastnb as (select user_id, max(row) filter (where c<>'B') ln from live group by 1),"
    " reg as (select user_id, min(row) filter (where c='D') ds, max(row) filter (where c='D') de, max(row) filter (where c='D' and not m) lf, count(*) filter (where c='S') ns from live group by 1),"
    " mg as (select user_id, count(*) filter (where c='D' and m and row<lf) mb, count(*) filter (where c='D' and m and row>lf) ma from live join reg using(user_id) group by 1),"
    " sk as (select user_id, count(*) filter (where c='S' or (c='B' and row<ln)) n_skips, coalesce(sum(row) filter (where c='S' or (c='B' and row<ln)),0) sum_skips from live join lastnb using(user_id) group by 1)"
    " select user_id, ds data_start, case when lf is not null and mb=0 and ma>0 then lf else de end data_end, case when ds is null and ns>0 then 0 else n_skips end n_skips, cast(case when ds is null and ns>0 then 0 else sum_skips end as bigint) sum_skips,"
    " lf is not null and mb=0 and ma>0 clamped, ds is null and ns>0 unreliable from reg join mg using(user_id) join sk using(user_id)"
)


def _scanned(rows: DataFrame) -> DataFrame:
    s = body.scan_body(rows, ["user_id"])
    return s.select("user_id", "data_start", "data_end", F.size("skip_rows").cast("long").alias("n_skips"), F.aggregate("skip_rows", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_skips"), "clamped", "unreliable")


@query(f"with {EV}, t as (select user_id, row, case when value<9 then 'B' when value<25 then 'S' else 'D' end c, event_type='signup' m from ev), {BODY}")
def body_scan_regions(spark, d):
    v = F.col("value")
    return _scanned(_events(spark, d).select("user_id", "row", F.when(v < 9, "B").when(v < 25, "S").otherwise("D").alias("cls"), (F.col("event_type") == "signup").alias("merged"), F.col("event_type").alias("label")))


@query(f"with {EV}, n as (select user_id, max(row) k from ev group by 1), t as (select user_id, row, case when value<3 then 'S' else 'D' end c, row > k-user_id%4 m from ev join n using(user_id)), {BODY}")
def trailing_group_clamp(spark, d):
    e = _events(spark, d).withColumn("k", F.count("*").over(Window.partitionBy("user_id")))
    return _scanned(e.select("user_id", "row", F.when(F.col("value") < 3, "S").otherwise("D").alias("cls"), (F.col("row") > F.col("k") - F.col("user_id") % 4).alias("merged"), F.col("event_type").alias("label")))


@query(
    f"with {EV}, a as (select user_id, row - row_number() over(partition by user_id order by row) g, row from ev where value>=20), r as (select user_id, g, min(row) l, max(row) r, count(*) w from a group by 1,2)"
    " select user_id, arg_max(l, (w, -l)) left_col, arg_max(r, (w, -l)) right_col, count(*)>1 gapped from r group by 1"
)
def header_span_run(spark, d):
    return bands.longest_run(_events(spark, d).filter("value >= 20").select("user_id", F.col("row").alias("col")), ["user_id"])


@query(
    f"with {EV}, {BANDS}, mg as (select user_id, row min_row, row + cast(floor(value) as int)%6 max_row from ev where event_type='click')"
    " select m.user_id, m.min_row, m.max_row, b.band_no, case when m.min_row<=b.start_row then 'header' else 'body' end kind from mg m join bands b on m.user_id=b.user_id and m.max_row>=b.start_row and m.min_row<=b.end_row"
)
def merge_overlap_blocks(spark, d):
    m = _events(spark, d).filter("event_type = 'click'").select("user_id", F.col("row").alias("min_row"), (F.col("row") + F.floor("value").cast("int") % 6).alias("max_row"))
    hit = merges.overlapping(m, _event_bands(spark, d), ["user_id"], ["band_no"])
    return merges.classified(hit, "start_row").select("user_id", "min_row", "max_row", "band_no", "kind")


@query(
    f"with {EV}, {BANDS}, an as (select distinct user_id, row anchor from ev where row%7=3), j as (select an.*, band_no from an left join bands b on an.user_id=b.user_id and anchor between start_row and end_row)"
    " select user_id, anchor, band_no, band_no is not null and row_number() over(partition by user_id, band_no order by anchor)=1 applies from j"
)
def anchor_band_resolve(spark, d):
    return merges.anchored(_events(spark, d).filter("row % 7 = 3").select("user_id", F.col("row").alias("anchor")), _event_bands(spark, d), ["user_id"])


@query("select o_custkey, o_orderkey as row from orders where (o_orderkey%5=0 or o_orderkey%7=1) and o_orderkey%11<>0")
def skip_override_fold(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("row"))
    return merges.folded_skips(o.filter("row % 5 = 0"), o.filter("row % 7 = 1"), o.filter("row % 11 = 0"), ["o_custkey"])


@query(
    "with c as (select distinct l_orderkey g, l_linenumber as row from lineitem where l_quantity>10), h as (select g, max(row)+cast(g%2 as int) h from c group by 1),"
    " a as (select c.g, h, row, row + row_number() over(partition by c.g order by row desc) z from c join h using(g) where row<h) select g as l_orderkey, h as header_row, min(row) top_row from a where z=h group by 1,2"
)
def header_band_runs(spark, d):
    c = _t(spark, d, "lineitem").filter("l_quantity > 10").select("l_orderkey", F.col("l_linenumber").alias("row")).distinct()
    h = c.groupBy("l_orderkey").agg((F.max("row") + F.col("l_orderkey") % 2).cast("int").alias("header_row"))
    return merges.header_levels(c.join(h, "l_orderkey").filter("row < header_row"), ["l_orderkey"])


@query(
    f"with {EV}, m as (select user_id, row min_row, row + cast(floor(value) as int)%9 max_row, cast(user_id*0 + event_id%5 as int) min_col from ev), h as (select distinct user_id, cast(10 + user_id%13 as int) header_row from ev)"
    " select user_id, min_col col, max(min_row) anchor_row from m join h using(user_id) where min_row<header_row and max_row>=header_row group by 1,2"
)
def vertical_anchor(spark, d):
    e = _events(spark, d)
    m = e.select("user_id", F.col("row").alias("min_row"), (F.col("row") + F.floor("value").cast("int") % 9).alias("max_row"), (F.col("event_id") % 5).cast("int").alias("min_col"))
    h = e.select("user_id", (10 + F.col("user_id") % 13).cast("int").alias("header_row")).distinct()
    return merges.vertical_anchors(m, h, ["user_id"])


LISTED = "li as (select n_name, row_number() over(order by p, k) as position from (select n_name, 1 p, n_nationkey k from nation union all select r_name, 2, r_regionkey from region union all select n_name || '.1', 3, n_nationkey from nation where n_nationkey%5=0 union all select n_name, 4, n_nationkey from nation union all select n_name || '.1', 5, n_nationkey from nation where n_nationkey%5=1))"


@query(
    f"with recursive {LISTED}, f(position, name, unique_name, used) as (select 0::bigint, '', '', []::varchar[] union all"
    " select position, name, u, list_append(used, u) from (select li.position, li.n_name as name, f.used, case when list_contains(f.used, li.n_name) then list_filter(list_transform(range(1, len(f.used) + 2), lambda k: li.n_name || '.' || k), lambda c: not list_contains(f.used, c))[1] else li.n_name end u from f join li on li.position = f.position + 1))"
    " select position, name, unique_name from f where position > 0"
)
def dedupe_names(spark, d):
    """Names of all nations and regions, nations twice, some with a number already, made unique in order."""
    nation = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    region = _t(spark, d, "region").select("r_name", F.col("r_regionkey").cast("long"))
    part = lambda p, df: df.select(F.lit(p).alias("p"), F.col("k"), F.col("name"))
    dotted = nation.withColumn("name", F.concat("name", F.lit(".1")))
    listed = part(1, nation).union(part(2, region.toDF("name", "k"))).union(part(3, dotted.filter("k % 5 = 0"))).union(part(4, nation)).union(part(5, dotted.filter("k % 5 = 1")))
    held = listed.agg(F.array_sort(F.collect_list(F.struct("p", "k", "name"))).alias("x")).select(F.transform("x", lambda e: e["name"]).alias("x"))
    return held.select(F.posexplode(F.arrays_zip(F.col("x").alias("name"), names.deduped(F.col("x")).alias("unique_name"))).alias("at", "e")).select((F.col("at") + 1).cast("long").alias("position"), "e.name", "e.unique_name")


@query("select n_nationkey, concat_ws(' / ', r_name, case when n_nationkey%3=0 then null else n_name end) as name from nation join region on n_regionkey=r_regionkey")
def flatten_labels(spark, d):
    both = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    top = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Unnamed: "), F.col("n_nationkey"), F.lit("_level_1"))).otherwise(F.col("n_name"))
    return both.select("n_nationkey", X.flatten_levels(F.array("r_name", top, F.lit(""))).alias("name"))


@query("select doc_id, '| ' || doc_id || ' | ' || coalesce(regexp_replace(replace(text,'|','\\|'), '\\r\\n|\\n|\\r', ' ', 'g'),'') || ' | ' || coalesce(lang,'') || ' |' as line from documents")
def markdown_rows(spark, d):
    return render.markdown_lines(_t(spark, d, "documents").select("doc_id", "text", "lang"), ["doc_id"])


@query(
    "select event_id, '{\"event_id\":' || event_id || ',\"ts\":\"' || strftime(ts,'%Y-%m-%dT%H:%M:%S') || case when extract(microseconds from ts)%1000000=0 then '' else '.' || lpad(cast(extract(microseconds from ts)%1000000 as varchar),6,'0') end || '\",\"event_type\":\"' || event_type || '\",\"missing\":' || case when event_id%4=0 then 'null' else '\"' || event_type || '\"' end || '}' as record from events"
)
def json_records(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("missing"))
    return render.json_lines(e, ["event_id"])


@query(
    "select l_suppkey, bool_or(l_quantity>45) has_formula, case when bool_or(l_quantity>45) and bool_and(l_discount<0.09) filter(where l_quantity>45) then 'as_formula' else 'as_value' end read_hint from lineitem group by 1"
)
def formula_hint_agg(spark, d):
    formula = F.when(F.col("l_quantity") > 45, F.lit("=A1"))
    grid = _t(spark, d, "lineitem").select("l_suppkey", F.lit(1).alias("col"), formula.alias("formula"), F.when((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.09), None).otherwise("float").alias("kind"), F.lit(None).cast("string").alias("s"))
    rows = grid.groupBy("l_suppkey").agg(F.count("*").alias("sampled"))
    p = profile.profile_columns(grid, ["l_suppkey"], rows)
    return p.select("l_suppkey", "has_formula", F.when(F.col("has_formula") & F.col("uncached"), "as_formula").otherwise("as_value").alias("read_hint"))


@query(
    "with k as (select o_custkey, case when o_orderkey%25=0 then null when o_orderkey%40=1 then 'text' else 'date' end kind from orders), a as (select o_custkey, count(*) observed, count(kind) populated, greatest(count(*) filter(where kind='date'), count(*) filter(where kind='text')) top_kind from k group by 1)"
    " select o_custkey, observed, populated, top_kind, observed>0 and populated>0 and populated/observed>=0.95 and top_kind/populated>=0.95 is_key from a"
)
def leading_key_evidence(spark, d):
    key = F.col("o_orderkey")
    kind = F.when(key % 25 == 0, None).when(key % 40 == 1, "string").otherwise("datetime")
    c = _t(spark, d, "orders").select("o_custkey", kind.alias("kind"), F.lit("x").alias("s"))
    c = c.withColumn("vk", F.when(F.col("kind").isNotNull(), profile.value_kind(F.col("kind"), F.col("s"))))
    a = c.groupBy("o_custkey").agg(F.count("*").alias("observed"), F.count("vk").alias("populated"), F.greatest(F.count(F.when(F.col("vk") == "date", 1)), F.count(F.when(F.col("vk") == "text", 1))).alias("top_kind"))
    return a.withColumn("is_key", profile.leading_key(F.col("observed"), F.col("populated"), F.col("top_kind")))
