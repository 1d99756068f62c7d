"""Size-balanced sharding by sampled splitters (DataFrame operations only).

A record's key is a hash of its text followed by its id, so that equal texts
lie together.  A size-weighted sample of keys gives quantile boundaries, the
records are range-partitioned by them, and each range is summed.  Ranges that
hold more than their share are subdivided before any window runs over them, by
what was measured: a text that fills a share by itself gets a range of its own,
cut by the id hash, and the rest of the range is cut by the key.  So no task
gets a hot text as a whole, however the sample fell.  The exact running size of
the ranges then fixes the shard of each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, shuffle_width, written

SHARDS = 40
#: Bytes counted for a record beside its text.
RECORD_OVERHEAD = 16
#: Keys drawn for the splitters, and a range at least: a bounded sample, for boundaries only.
SAMPLE_KEYS, KEYS_A_RANGE = 20_000, 8
#: A group of equal texts stays in one shard up to this share of a shard's size.
WHOLE_GROUP_SHARE = 0.01


def _spread(key: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of so many equal parts of low .. high a key falls in; never falls with the key."""
    at = F.floor((key.cast("double") - low) / (high - low) * parts)
    return F.greatest(F.lit(0), F.least(at, parts - 1)).cast("int")


def _ranged(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` with rng, the number of boundaries at or below the key g.

    Keys are hashes, so equal slices of their space hold few boundaries each;
    a row is held against those of its own slice.
    """
    spark, slices = rows.sparkSession, len(bounds) + 1
    slice_of = _spread(F.col("g"), F.lit(-(2.0**63)), F.lit(2.0**63), F.lit(slices))
    cuts = spark.createDataFrame([(b,) for b in bounds], "g long").withColumn("slice", slice_of)
    cuts = cuts.groupBy("slice").agg(F.sort_array(F.collect_list("g")).alias("cuts"))
    every = spark.range(slices).select(F.col("id").cast("int").alias("slice")).join(cuts, "slice", "left")
    every = every.select("slice", F.coalesce("cuts", F.array().cast("array<long>")).alias("cuts"))
    earlier = F.sum(F.size("cuts")).over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("base", F.coalesce(earlier, F.lit(0)).cast("int"))
    below = F.size(F.filter("cuts", lambda c: c <= F.col("g")))
    return rows.withColumn("slice", slice_of).join(F.broadcast(every), "slice").withColumn("rng", F.col("base") + below).drop("slice", "cuts", "base")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shard sizes are as near equal as whole documents allow, and
    equal texts share a shard unless the group exceeds ``WHOLE_GROUP_SHARE`` of
    a shard.  A null text counts as empty; a null id is kept and ordered first;
    rows repeated in full are kept, each with its own slot; an empty table
    gives no rows.  Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        F.xxhash64(F.col(id_col).cast("long"), F.lit(1)).alias("d"),
    )
    rows = written(rows, "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or max(4 * shuffle_width(spark), 4)

    # Size-weighted sample: a record is drawn with probability in proportion to its size.
    weight = F.col("size") * F.lit(max(SAMPLE_KEYS, KEYS_A_RANGE * ranges) / max(total, 1))
    uniform = F.pmod(F.xxhash64("d", "g", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted(r[0] for r in rows.filter(uniform < weight).select("g").collect())
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    placed = _ranged(rows, bounds)

    # Overfull ranges, as measured; there are at most as many as shares, and so of texts that fill one.
    share = max(total / ranges, 1.0)
    full = {r["rng"]: r["bytes"] for r in placed.groupBy("rng").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > share).collect()}
    over = spark.createDataFrame(list(full), "int").toDF("rng") if full else None
    hot = [] if over is None else placed.join(F.broadcast(over), "rng").groupBy("rng", "g").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > share).collect()
    rest = dict(full)
    for r in hot:
        rest[r["rng"]] -= r["bytes"]
    edge = [-(2.0**63), *map(float, bounds), 2.0**63]
    cut = [(k, edge[k], max(edge[k + 1], edge[k] + 4096.0), int(n // share) + 1) for k, n in rest.items()]
    cut = spark.createDataFrame(cut, "rng int, low double, high double, parts int")
    own = spark.createDataFrame([(r["g"], int(r["bytes"] // share) + 1) for r in hot], "g long, own_parts int")
    placed = placed.join(F.broadcast(cut), "rng", "left").join(F.broadcast(own), "g", "left")
    by_id = _spread(F.col("d"), F.lit(-(2.0**63)), F.lit(2.0**63), F.col("own_parts"))
    by_key = _spread(F.col("g"), F.col("low"), F.col("high"), F.col("parts"))
    placed = placed.withColumn("own", F.col("own_parts").isNotNull())
    placed = placed.withColumn("g_part", F.when(F.col("own"), F.col("g"))).withColumn("sub", F.coalesce(F.when(F.col("own"), by_id), by_key, F.lit(0)))

    # Sizes of ranges; at most a few times the number of splitters, whatever the input.
    cell = ["rng", "own", "g_part", "sub"]
    cells = placed.groupBy(*cell).agg(F.sum("size").alias("bytes")).collect()
    # within a range the hot texts stand first
    cells.sort(key=lambda r: (r["rng"], not r["own"], r["g_part"] or 0, r["sub"]))
    start, table = 0, []
    for r in cells:
        table.append((r["rng"], r["own"], r["g_part"], r["sub"], start))
        start += r["bytes"]
    starts = spark.createDataFrame(table, "rng int, own boolean, g_part long, sub int, start long")

    order = [F.col("g"), F.col("d"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    keyed = placed.join(F.broadcast(starts), on=[placed[c].eqNullSafe(starts[c]) for c in cell]).select("doc_id", "size", "text_crc32", "g", "d", placed["rng"], placed["own"], placed["sub"], "start")
    in_cell = Window.partitionBy("rng", "own", "start")
    running = in_cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    in_group = Window.partitionBy("rng", "own", "start", "g")
    target = max(total, 1) / shards
    before = F.col("start") + F.coalesce(F.sum("size").over(running), F.lit(0))
    keyed = keyed.withColumn("before", before).withColumn("group_bytes", F.sum("size").over(in_group)).withColumn("group_from", F.min("before").over(in_group))
    whole = ~F.col("own") & (F.col("group_bytes") <= F.lit(WHOLE_GROUP_SHARE * target))
    middle = F.when(whole, F.col("group_from") + F.col("group_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    keyed = keyed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(target))).cast("int"))
    keyed = written(keyed.select("doc_id", "size", "text_crc32", "start", "shard", "before"), "shard-placed")

    # Slots: rank within (cell, shard) plus the rows of the shard in earlier cells.
    per = keyed.groupBy("shard", "start").agg(F.count("*").alias("n"))
    earlier = per.withColumn("slot0", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "start", "slot0")
    rank = F.row_number().over(Window.partitionBy("start", "shard").orderBy("before", "doc_id")) - 1
    return (
        keyed.withColumn("k", rank)
        .join(F.broadcast(earlier), ["shard", "start"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"))
