"""Inspection of many workbooks at once, as one chain of relations.

cells, sheets, merges -> tabular sheets -> bands -> headers -> spans -> body
regions -> column profiles -> blocks.  All keys hold (file, sheet_idx); a sheet
with one band is judged as a whole sheet, others band by band.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import cells as X
from ..operators import bands, body, header, merges as M, profile, tabular
from ..options import UNSET, InspectionOptions
from ..scratch import settled

SHEET = ["file", "sheet_idx"]
BLOCK = [*SHEET, "band_no"]


@dataclass
class Inspection:
    """Relations of an inspection; metadata only, tables are loaded from ``cells``."""

    cells: DataFrame
    merges: DataFrame
    sheets: DataFrame
    blocks: DataFrame
    columns: DataFrame
    warnings: DataFrame
    close: Callable[[], object] | None = None


def _overrides(spark: SparkSession, options: InspectionOptions) -> tuple[DataFrame, DataFrame]:
    sheets = [(s.sheet, s.is_tabular, s.header_row is not UNSET, None if s.header_row is UNSET else s.header_row, list(s.skip_rows_add), list(s.skip_rows_remove)) for s in options.sheets]
    blocks = [(s.sheet, b.anchor_row, b.header_row is not UNSET, None if b.header_row is UNSET else b.header_row, list(b.skip_rows_add)) for s in options.sheets for b in s.blocks]
    return (
        spark.createDataFrame(sheets, "sheet string, o_tabular boolean, o_header_set boolean, o_header int, o_add array<int>, o_remove array<int>"),
        spark.createDataFrame(blocks, "sheet string, anchor int, b_header_set boolean, b_header int, b_add array<int>"),
    )


def _resolved(asked: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides of blocks by band, one a band, and those left out with the reason (file, sheet_idx, band_no, seq, message)."""
    both = asked.join(found.select(*BLOCK, "start_row", "end_row").withColumnRenamed("band_no", "in_band"), SHEET).filter("anchor BETWEEN start_row AND end_row")
    placed = asked.join(both.select(*SHEET, "anchor", F.col("in_band").alias("band_no"), "start_row", "end_row"), [*SHEET, "anchor"], "left")
    says = F.col("b_header_set") | (F.size("b_add") > 0)
    inside = F.col("b_header").isNull() | F.col("b_header").between(F.col("start_row"), F.col("end_row"))
    good = F.col("band_no").isNotNull() & says & inside
    first = F.min(F.when(good, F.col("anchor"))).over(Window.partitionBy(*SHEET, "band_no"))
    placed = placed.withColumn("good", good).withColumn("first", first)
    why = (
        F.when(F.col("band_no").isNull(), "lies in no table band")
        .when(F.col("first") < F.col("anchor"), F.concat(F.lit("is in the band of row "), F.col("first").cast("string")))
        .when(~says, "asks for nothing")
        .when(~inside, F.concat(F.lit("gives header row "), F.col("b_header").cast("string"), F.lit(" outside its band")))
    )
    message = F.concat(F.lit("sheet '"), F.col("sheet"), F.lit("': block override at row "), F.col("anchor").cast("string"), F.lit(" "), why, F.lit("; ignored"))
    ignored = placed.withColumn("message", message).filter("message IS NOT NULL").select(*SHEET, F.coalesce("band_no", F.lit(0)).alias("band_no"), F.col("anchor").alias("seq"), "message")
    return placed.filter("good AND anchor = first"), ignored


def _length() -> Column:
    return X.value_length(F.col("kind"), F.col("s"), F.col("l"), F.col("d"))


def inspect_relations(cells: DataFrame, sheets: DataFrame, merges: DataFrame, options: InspectionOptions | None = None) -> Inspection:
    """Infer the tables of all sheets in ``cells``."""
    options = options or InspectionOptions()
    spark = cells.sparkSession
    o_sheets, o_blocks = _overrides(spark, options)
    filled = cells.filter(F.col("kind").isNotNull())

    # which sheets are tables
    gate = tabular.tabular(filled.filter(F.col("row") <= C.SAMPLE_ROWS), SHEET)
    sheets = (
        sheets.join(gate.select(*SHEET, "density", "is_tabular"), SHEET, "left")
        .join(F.broadcast(o_sheets), "sheet", "left")  # as many rows as the caller gave overrides
        .withColumn("is_tabular", F.coalesce("o_tabular", "is_tabular", F.col("max_col") > 1))
        .withColumn("tabular_by", F.when(F.col("o_tabular").isNotNull(), "manual").otherwise("heuristic"))
        .withColumn("used_range", F.concat(F.lit("A1:"), X.column_letters(F.col("max_col")), F.col("max_row").cast("string")))
    )
    sheets = settled(sheets, "sheets")
    live = filled.join(sheets.filter("is_tabular").select(*SHEET, "max_row", "max_col", "o_header_set", "o_header", "o_add", "o_remove"), SHEET)

    # bands; an anchor's override goes to the band that holds it
    rows = live.select(*SHEET, "row").distinct()
    found = bands.band_extents(rows, SHEET)
    per_sheet = Window.partitionBy(*SHEET)
    found = found.withColumn("n_bands", F.count("*").over(per_sheet)).join(sheets.select(*SHEET, "sheet", "max_row", "max_col", "o_header_set", "o_header", "o_add", "o_remove"), SHEET)
    asked = sheets.filter("is_tabular").select(*SHEET, "sheet").join(F.broadcast(o_blocks), "sheet")
    hits, ignored = _resolved(asked, found)
    found = found.join(F.broadcast(hits.select(*BLOCK, "b_header_set", "b_header", "b_add")), BLOCK, "left")
    alone = F.col("n_bands") == 1
    found = (
        found.withColumn("w_start", F.when(alone, 1).otherwise(F.col("start_row")))
        .withColumn("w_end", F.when(alone, F.col("max_row")).otherwise(F.col("end_row")))
        .withColumn("n", F.least(F.lit(C.HEADER_SCAN_ROWS), F.col("w_end") - F.col("w_start") + 1))
    )
    found = settled(found, "bands")
    scoped = filled.join(found.select(*BLOCK, "w_start", "w_end", "n", "max_col", "n_bands"), SHEET).filter("row BETWEEN w_start AND w_end")
    sample = scoped.filter("row < w_start + n").withColumn("sheet_row", F.col("row")).withColumn("row", F.col("row") - F.col("w_start") + 1)

    sample = settled(sample, "header-sample")
    # headers
    extents = sample.groupBy(*BLOCK, "n").agg(F.when(F.first("n_bands") == 1, F.first("max_col")).otherwise(F.max("col")).alias("width"))
    scores = header.score_rows(sample.select(*BLOCK, "row", "col", X.category().alias("cat"), _length().alias("len")), extents, BLOCK)
    bonus = header.timeseries_bonus(sample.select(*BLOCK, "row", "col", "kind", "s"), BLOCK)
    scores = scores.join(bonus, [*BLOCK, "row"], "left").select(*BLOCK, "row", F.least(F.lit(1.0), F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    scores, extents = settled(scores, "header-scores"), settled(extents, "header-extents")
    wide = header.wide_axis_rows(sample, extents, BLOCK)
    picked = header.pick_header(scores, wide, BLOCK)
    heads = found.join(picked, BLOCK, "left").withColumn("header_row", F.col("header_row") + F.col("w_start") - 1)
    sheet_says = F.coalesce("o_header_set", F.lit(False)) & (F.col("o_header").isNull() | F.col("o_header").between(F.col("start_row"), F.col("end_row")) | (F.col("n_bands") == 1))
    block_says = F.coalesce("b_header_set", F.lit(False)) & (F.col("n_bands") > 1)
    manual = block_says | sheet_says
    good = F.coalesce(F.col("confidence") >= options.header_threshold, F.lit(False))
    heads = (
        heads.withColumn("provenance", F.when(manual, "manual").when(good, "heuristic").otherwise("default"))
        .withColumn("headerless", manual & F.when(block_says, F.col("b_header")).otherwise(F.col("o_header")).isNull())
        .withColumn("header_row", F.when(block_says, F.col("b_header")).when(sheet_says, F.col("o_header")).when(good, F.col("header_row")))
        .withColumn("confidence", F.when(manual, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
    )

    heads = settled(heads, "headers")

    # spans: merges fill the header cells they cover
    headed = heads.filter("header_row IS NOT NULL")
    head_cells = filled.join(headed.select(*BLOCK, "header_row"), SHEET).filter("row = header_row")
    real = head_cells.select(*BLOCK, "col", "kind", "s", "l", "d", "b", "ts")
    run = bands.longest_run(M.filled_header(real, merges.join(headed.select(*BLOCK, "header_row"), SHEET), BLOCK), BLOCK)
    lost = (F.col("left_col") == F.col("right_col")) & F.col("gapped")
    run = run.select(*BLOCK, F.when(~lost, F.col("left_col")).alias("run_left"), F.when(~lost, F.col("right_col")).alias("right_col"), lost.alias("narrowed"))
    spans = settled(headed.join(run, BLOCK, "left"), "header-runs")

    # body rows below the header, blank ones included
    under = filled.join(spans.select(*BLOCK, "header_row", "w_end", "run_left", "right_col"), SHEET).filter("row > header_row AND row <= w_end AND run_left IS NOT NULL")
    left = _extended_left(under, real, spans)
    spans = spans.join(left, BLOCK, "left").withColumn("left_col", F.coalesce("ext_left", "run_left"))
    spans = settled(spans, "spans")
    axis_label = real.join(spans.select(*BLOCK, "left_col"), BLOCK).filter("col = left_col").select(*BLOCK, F.when(F.col("kind") == "string", X.axis_label_rows(F.col("s"))).otherwise(F.lit(False)).alias("head_axis"), F.lit(True).alias("head_filled"))
    spans = spans.join(axis_label, BLOCK, "left")
    inside = F.col("col").between(F.col("left_col"), F.col("right_col"))
    first = F.struct("col", "kind", "s", "l", "d")
    seen = (
        under.drop("run_left", "right_col")
        .join(spans.select(*BLOCK, "left_col", "right_col", "head_axis", "head_filled"), BLOCK)
        .groupBy(*BLOCK, "row")
        .agg(
            F.count(F.when(inside, 1)).alias("filled"),
            F.min_by(first, F.when(F.col("col") >= F.col("left_col"), F.col("col"))).alias("lead"),
            F.max(F.when(F.col("col") == F.col("left_col"), first)).alias("at_left"),
        )
    )
    body_rows = spans.filter("left_col IS NOT NULL AND w_end > header_row").select(*BLOCK, "left_col", "right_col", "head_axis", "head_filled", F.explode(F.sequence(F.col("header_row") + 1, F.col("w_end"))).alias("row")).join(seen, [*BLOCK, "row"], "left")
    width = F.col("right_col") - F.col("left_col") + 1
    n = F.coalesce("filled", F.lit(0))
    lk, ls, ll, ld = (F.col(f"at_left.{c}") for c in ("kind", "s", "l", "d"))
    thin = ~X.wide_rescue(n, width, X.axis_value_gate(lk, ls, ll, ld)) & X.thin_row(n, width)
    axis_row = X.axis_rescue(X.axis_value_rows(lk, ls, ll, ld), X.axis_value_strict(lk, ls), F.col("head_axis"), F.col("head_filled"))
    label = F.when(F.col("lead.kind") == "string", X.strip(F.col("lead.s")))
    cls = F.when(n == 0, "B").when(X.keyword_hit(label, options.skip_keywords) | (thin & ~axis_row), "S").otherwise("D")
    grouped = merges.join(headed.select(*BLOCK, "header_row"), SHEET).filter("min_row > header_row AND max_row > min_row").select(*BLOCK, F.explode(F.sequence("min_row", "max_row")).alias("row")).distinct().withColumn("merged", F.lit(True))
    body_rows = body_rows.withColumn("cls", cls).withColumn("label", label).join(grouped, [*BLOCK, "row"], "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    regions = settled(body.scan_body(body_rows.select(*BLOCK, "row", "cls", "merged", "label"), BLOCK), "regions")

    blocks = heads.join(spans.select(*BLOCK, "left_col", "right_col", "narrowed"), BLOCK, "left").join(regions, BLOCK, "left")
    whole = F.col("headerless")
    blocks = (
        blocks.withColumn("data_start", F.when(whole, F.col("start_row")).otherwise(F.col("data_start")))
        .withColumn("data_end", F.when(whole, F.col("end_row")).otherwise(F.col("data_end")))
        .withColumn("left_col", F.when(~whole & ~F.coalesce("unreliable", F.lit(False)), F.col("left_col")))
        .withColumn("right_col", F.when(~whole & ~F.coalesce("unreliable", F.lit(False)), F.col("right_col")))
    )
    none = F.array().cast("array<int>")
    asked = F.array_union(F.coalesce("o_add", none), F.filter(F.coalesce("b_add", none), lambda r: r.between(F.col("start_row"), F.col("end_row"))))
    blocks = blocks.withColumn("skip_rows", F.array_sort(F.array_except(F.array_union(F.coalesce(F.col("skip_rows").cast("array<int>"), none), asked), F.coalesce("o_remove", none))))
    # not a table: no heuristic header, or no row of data
    is_block = (F.col("provenance") == "manual") | ((F.col("provenance") == "heuristic") & F.col("data_start").isNotNull()) | ((F.col("n_bands") == 1) & F.col("header_row").isNotNull())
    blocks = blocks.withColumn("is_table", is_block)
    blocks = blocks.withColumn("table_no", F.when(F.col("is_table"), F.sum(F.col("is_table").cast("int")).over(Window.partitionBy(*SHEET).orderBy("band_no").rowsBetween(Window.unboundedPreceding, 0))))
    blocks = settled(blocks, "tables")
    levels = _levels(merges, blocks)
    blocks = settled(blocks.join(levels, BLOCK, "left").withColumn("top_row", F.coalesce("top_row", "header_row")), "blocks")
    columns = settled(_columns(cells, merges, blocks, real), "columns")
    return Inspection(cells, merges, sheets, blocks, columns, _warnings(blocks).union(ignored))


def _extended_left(under: DataFrame, real: DataFrame, spans: DataFrame) -> DataFrame:
    """Blank-headed columns left of the run that hold a key in nearly every row."""
    taken = real.join(spans.select(*BLOCK, "run_left"), BLOCK).filter("col < run_left").groupBy(*BLOCK).agg(F.max("col").alias("wall"))
    free = spans.select(*BLOCK, "run_left", "right_col").join(taken, BLOCK, "left").withColumn("wall", F.coalesce("wall", F.lit(0))).filter("run_left - wall > 1")
    near = under.join(free.select(*BLOCK, "wall"), BLOCK).filter("col > wall AND col <= right_col").withColumn("cand", F.col("col") < F.col("run_left"))
    strict = X.axis_value_strict(F.col("kind"), F.col("s"))
    rows = near.groupBy(*BLOCK, "row").agg(F.coalesce(F.bool_or(~F.col("cand") | strict), F.lit(False)).alias("counts")).filter("counts")
    order = Window.partitionBy(*BLOCK).orderBy("row")
    before = F.coalesce(F.lag("row").over(order), F.col("row") - 1)
    rows = rows.withColumn("_gap", (F.col("row") - before - 1 >= C.BLANK_RUN).cast("int")).withColumn("_cut", F.sum("_gap").over(order)).filter("_cut = 0").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= C.TYPE_SAMPLE_ROWS).select(*BLOCK, "row")
    observed = rows.groupBy(*BLOCK).agg(F.count("*").alias("observed"))
    kinds = near.filter("cand").join(rows, [*BLOCK, "row"]).groupBy(*BLOCK, "col", profile.value_kind(F.col("kind"), F.col("s")).alias("vk")).agg(F.count("*").alias("c"))
    per = kinds.groupBy(*BLOCK, "col").agg(F.sum("c").alias("populated"), F.max("c").alias("top")).join(observed, BLOCK)
    ok = per.filter(profile.leading_key(F.col("observed"), F.col("populated"), F.col("top"))).join(free.select(*BLOCK, "run_left"), BLOCK)
    # only an unbroken run of keys next to the span counts
    from_span = ok.withColumn("_run", F.col("col") + F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.desc("col")))).filter("_run = run_left")
    return from_span.groupBy(*BLOCK).agg(F.min("col").alias("ext_left"))


def _levels(merges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Top row of headers of several levels: header merges right above the header, within the band."""
    able = blocks.filter("is_table AND provenance = 'heuristic' AND header_row IS NOT NULL").select(*BLOCK, "header_row", "start_row", "end_row")
    hit = M.overlapping(merges, able.select(*SHEET, "band_no", "start_row", "end_row", "header_row"), SHEET, ["band_no", "header_row"]).filter("min_row < header_row")
    covered = hit.select(*BLOCK, "header_row", F.explode(F.sequence(F.col("min_row"), F.least(F.col("max_row"), F.col("header_row") - 1))).alias("row"))
    return M.header_levels(covered, BLOCK).select(*BLOCK, "top_row")


def _columns(cells: DataFrame, merges: DataFrame, blocks: DataFrame, real: DataFrame) -> DataFrame:
    """Profile of every column of every table: name, type, null ratio, formula."""
    span = blocks.filter("is_table AND NOT headerless AND data_start IS NOT NULL").select(*BLOCK, "header_row", "data_start", "data_end", "skip_rows", F.coalesce("left_col", F.lit(1)).alias("lo"), F.coalesce("right_col", "max_col").alias("hi"))
    rows = span.select(*BLOCK, "skip_rows", F.explode(F.sequence("data_start", "data_end")).alias("row")).filter(~F.array_contains("skip_rows", F.col("row"))).select(*BLOCK, "row")
    rows = profile.even_sample(rows, BLOCK, ["row"])
    counted = rows.groupBy(*BLOCK).agg(F.count("*").alias("sampled"))
    body_cells = cells.join(rows, [*SHEET, "row"]).join(span.select(*BLOCK, "lo", "hi"), BLOCK).filter("col BETWEEN lo AND hi")
    seen = profile.profile_columns(body_cells, BLOCK, counted)
    all_cols = span.select(*BLOCK, "lo", F.explode(F.sequence("lo", "hi")).alias("col"))
    by_block = merges.select(*SHEET, "min_row", "min_col", "max_row").join(span.select(*BLOCK), SHEET)
    anchors = M.vertical_anchors(by_block, span.select(*BLOCK, "header_row"), BLOCK).withColumnRenamed("anchor_row", "row")
    text = F.when(F.col("kind") == "string", F.nullif(X.strip(F.col("s")), F.lit(""))).otherwise(F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    above = cells.join(anchors, [*SHEET, "row", "col"]).select(*BLOCK, "col", text.alias("above"))
    named = real.select(*BLOCK, "col", text.alias("name"))
    return (
        all_cols.join(seen, [*BLOCK, "col"], "left")
        .join(named, [*BLOCK, "col"], "left")
        .join(above, [*BLOCK, "col"], "left")
        .select(
            *BLOCK,
            "col",
            (F.col("col") - F.col("lo")).alias("index"),
            F.coalesce("name", "above").alias("name"),
            F.coalesce("inferred_type", F.lit("text")).alias("inferred_type"),
            F.coalesce("null_ratio", F.lit(1.0)).alias("null_ratio"),
            F.coalesce("has_formula", F.lit(False)).alias("has_formula"),
            F.when(F.coalesce("uncached", F.lit(False)), "as_formula").otherwise("as_value").alias("read_hint"),
        )
    )


def _warnings(blocks: DataFrame) -> DataFrame:
    """(file, sheet_idx, band_no, seq, message), in a fixed order."""
    sheet = F.col("sheet")
    rows = F.concat(F.lit("rows "), F.col("start_row").cast("string"), F.lit("-"), F.col("end_row").cast("string"))
    both = F.coalesce("o_header_set", F.lit(False)) & F.coalesce("b_header_set", F.lit(False))
    placed = F.max((F.col("o_header").isNull() | F.col("o_header").between(F.col("start_row"), F.col("end_row"))).cast("int")).over(Window.partitionBy(*SHEET)) == 1
    given = F.array_union(F.coalesce("o_add", F.array().cast("array<int>")), F.coalesce("b_add", F.array().cast("array<int>")))
    above = F.filter(given, lambda r: r.between(F.col("start_row"), F.col("end_row")) & (r < F.coalesce("data_start", F.col("header_row") + 1)))
    said = F.array(
        F.when(F.col("band_no") > 1, F.when(F.col("is_table"), F.concat(F.lit("sheet '"), sheet, F.lit("': table block at "), rows, F.lit(" extracted as '"), sheet, F.lit("!T"), F.col("table_no").cast("string"), F.lit("'"))).otherwise(F.concat(F.lit("sheet '"), sheet, F.lit("': additional table block suspected at "), rows))),
        F.when(F.coalesce("clamped", F.lit(False)), F.concat(F.lit("sheet '"), sheet, F.lit("': merged rows at the end left out, data ends at row "), F.col("data_end").cast("string"))),
        F.when(F.coalesce("unreliable", F.lit(False)), F.concat(F.lit("sheet '"), sheet, F.lit("': no data row within the header's columns; column bounds dropped"))),
        F.when(both & (F.col("n_bands") > 1) & F.col("o_header").between(F.col("start_row"), F.col("end_row")), F.concat(F.lit("sheet '"), sheet, F.lit("': header rows given for the sheet and for the block at "), rows, F.lit("; the block's counts"))),
        F.when((F.col("band_no") == 1) & (F.col("n_bands") > 1) & F.coalesce("o_header_set", F.lit(False)) & ~F.col("_placed"), F.concat(F.lit("sheet '"), sheet, F.lit("': given header row "), F.col("o_header").cast("string"), F.lit(" lies in no table band; ignored"))),
        F.when(F.size(F.filter(above, lambda r: r.isNotNull())) > 0, F.concat(F.lit("sheet '"), sheet, F.lit("': rows to skip at or above the header or the data are ignored: "), F.array_join(above, ", "))),
        F.when((F.col("provenance") == "default"), F.concat(F.lit("sheet '"), sheet, F.lit("': no header found at "), rows, F.lit("; one may be given"))),
    )
    return blocks.withColumn("_placed", placed).select(*BLOCK, said.alias("said")).select(*BLOCK, F.posexplode("said").alias("seq", "message")).filter("message IS NOT NULL")
