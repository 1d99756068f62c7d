"""Quality rules with thresholds that adapt to language and source.

Base statistics are exact and per document.  Thresholds come from mergeable
quantile sketches: log-spaced histograms with a relative error of at most
``RELATIVE_ERROR``, whose counts add, so that sketches of (language, source)
merge into those of a language and of the corpus.  A group's threshold is
Tukey's fence over its own sketch, blended with those over the language's and
the corpus's sketch by weights that grow with the counts, and joined to the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import combine, map_batches, read_table, row_key, written

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RELATIVE_ERROR = 0.02
#: Values below this share the sketch's first bin.
SMALLEST = 1e-4
LAST_BIN = 1200
#: A sketch of this many documents weighs as much as the wider ones; one of n documents has the share n / (n + MIN_GROUP).
MIN_GROUP = 200
FENCE = 3.0
#: metric -> least spread that counts as one inter-quartile range.
METRICS = {"symbol_rate": 0.05, "upper_rate": 0.06, "dup_line_rate": 0.2, "repeat_rate": 0.09, "run_rate": 0.05, "shout_rate": 0.05, "word_length": 1.0}
#: Share of a group that is taken to be sound when a fence is drawn: the fence's
#: upper quartile is that of the sound part, so a bad minority can't widen it.
SOUND_SHARE = 0.7

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_shouts long, n_runs long"


def base_statistics(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_shouts, n_runs) of a whole text."""
    if not text:
        return (0,) * 9
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    white = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    shouts = raw.count(b"!")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW_WORDS:
        h = combine(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), WINDOW_WORDS)
        s = np.sort(h)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            starts = np.flatnonzero(np.isin(h, twice))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW_WORDS, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    return (n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, shouts, sum(map(bytes.__eq__, words, words[1:])))


def with_base_statistics(docs: DataFrame, keep: str) -> DataFrame:
    """The columns in ``keep`` (a DDL list) plus those of ``BASE_SCHEMA``; ``text`` is read, not kept."""
    names = [x.split()[0] for x in keep.split(",")]
    types = {f.name: f for f in pa.schema([(c.split()[0], pa.int64()) for c in BASE_SCHEMA.split(", ")])}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [base_statistics(t) for t in batch.column("text").to_pylist()]
        cols = np.array(rows, np.int64).reshape(len(rows), len(types))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(cols[:, i]) for i in range(len(types))], names=[*names, *types])

    return map_batches(docs.select(*names, "text"), run, f"{keep}, {BASE_SCHEMA}")


def _metrics(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / words,
            "upper_rate": F.col("n_upper") / chars,
            "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_rate": F.col("n_repeat_words") / words,
            "run_rate": F.col("n_runs") / words,
            "shout_rate": F.col("n_shouts") / words,
            "word_length": F.col("word_chars") / words,
        }
    )


def _bin(x):
    gamma = math.log1p(RELATIVE_ERROR)
    return F.when(x <= SMALLEST, 0).otherwise(F.least(F.lit(LAST_BIN), F.ceil(F.log(x / F.lit(SMALLEST)) / F.lit(gamma)))).cast("int")


def _value(b):
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.lit(SMALLEST) * F.exp(b * F.lit(math.log1p(RELATIVE_ERROR))))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): one mergeable histogram a group and metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bin(F.col(m)).alias("bin")) for m in METRICS]))
    return stats.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.metric", "p.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Upper fence of each group and metric from merged sketches."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin")))
    spread = F.create_map(*[F.lit(y) for m, s in METRICS.items() for y in (m, s)])
    out = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("docs"), _value(at(0.25 * SOUND_SHARE)).alias("low"), _value(at(0.75 * SOUND_SHARE)).alias("high"))
    width = F.greatest(F.col("high") - F.col("low"), spread[F.col("metric")])
    return out.select(*keys, "metric", "docs", (F.col("high") + FENCE * width).alias("fence"))


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, one fence a metric), a row for each group in the data."""
    sketch = written(sketches(stats), "quality-sketch")
    share = lambda docs: docs / (docs + F.lit(MIN_GROUP))
    own, lang, every = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    joined = (
        own.alias("o")
        .join(lang.alias("l"), (F.col("o.lang").eqNullSafe(F.col("l.lang"))) & (F.col("o.metric") == F.col("l.metric")))
        .join(every.alias("e"), F.col("o.metric") == F.col("e.metric"))
        .select(
            "o.lang",
            "o.source",
            "o.metric",
            (share(F.col("l.docs")) * F.col("l.fence") + (1 - share(F.col("l.docs"))) * F.col("e.fence")).alias("wider"),
            F.col("o.fence").alias("own"),
            share(F.col("o.docs")).alias("w"),
        )
        .withColumn("fence", F.col("w") * F.col("own") + (1 - F.col("w")) * F.col("wider"))
    )
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"max_{m}") for m in METRICS])


#: Above this many groups the thresholds are joined by a shuffle, which AQE splits where one source is hot.
BROADCAST_GROUPS = 50_000


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept, one row per input row.

    Null or empty texts have no words and fail the base; null languages and
    sources form groups of their own; ties and repeated rows get equal
    verdicts; an empty table gives no rows; other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), row_key().alias("row_key"), "text")
    stats = written(_metrics(with_base_statistics(slim, "doc_id long, lang string, source string, row_key long")), "quality-stats")
    limits = written(thresholds(stats), "quality-limits")
    side = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = F.lit(True)
    for m in METRICS:
        fine = fine & (F.col(m) <= F.col(f"max_{m}"))
    return (
        stats.alias("s")
        .join(side.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source")), "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.coalesce(fine, F.lit(True))).alias("kept"), "row_key", *METRICS, *[f"max_{m}" for m in METRICS])
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
