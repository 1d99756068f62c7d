"""Exact top-k inner products over integer vectors.

Candidates are laid out in chunks of descending length.  Vectors are rotated by
the eigenvectors of the corpus's Gram matrix (its right singular vectors), so
that the first coordinates carry most of a product and the rest is bounded by
Cauchy-Schwarz on the residual lengths.  Each query starts from the k-th score
among the longest vectors, a fixed number of them; chunks, blocks and pairs
whose bound is below a query's threshold are passed over, and what is left is
scored in exact integers.  Queries and candidates meet in cells of bounded size:
queries are dealt into blocks by the least length a candidate must have for them
(threshold over own length), so a chunk meets the first blocks only, those with a
query that its longest vector can reach, and no copy of it is made for the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, shuffle_width, written

SCALE = 256
QUERY_EVERY = 50
TOP = 5
#: Longest candidates that give the first thresholds; a fixed number, broadcast.
HEAD = 2048
CHUNK_ROWS = 4096
QUERY_BLOCK = 4096
BLOCK = 512
#: Intervals of a column at most; sketches of quantiles tell no more apart.
INTERVALS = 5000
#: Coordinates in the first partial sum, as a share of the energy.
HEAD_ENERGY = 0.8
#: Products below this are exact in double precision.
EXACT = float(1 << 52)


def _matrix(column, width: int | None = None) -> np.ndarray:
    rows = [np.frombuffer(x, np.int64) for x in column]
    width = width or max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm, dim): scaled and floored vectors; unusable ones are left out."""

    def run(batches):
        for b in batches:
            ids, vs, norms = [], [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("x").to_pylist()):
                if i is None or x is None or any(c is None for c in x):
                    continue
                a = np.asarray(x, np.float64)
                if not np.isfinite(a).all():
                    continue
                v = np.floor(SCALE * a).astype(np.int64)
                ids.append(i)
                vs.append(v.tobytes())
                norms.append(float(np.sqrt((v.astype(float) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(norms, pa.float64()), pa.array([len(v) // 8 for v in vs], pa.int32())], names=["vec_id", "v", "norm", "dim"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x")).mapInArrow(run, "vec_id long, v binary, norm double, dim int")


def _rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Singular directions by falling energy, and how many carry ``HEAD_ENERGY``."""

    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), dim).astype(float)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size), pa.int32()), pa.array(g.ravel())], names=["i", "v"])

    g = np.zeros(dim * dim)
    for r in vectors.select("v").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        g[r["i"]] = r["v"]
    value, vector = np.linalg.eigh(g.reshape(dim, dim))
    order = np.argsort(-value)
    energy = np.cumsum(np.maximum(value[order], 0))
    first = int(np.searchsorted(energy, HEAD_ENERGY * energy[-1])) + 1 if dim and energy[-1] > 0 else dim
    return vector[:, order], min(max(first, 1), dim)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: higher score first, then smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    if bound < EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _asked(queries: DataFrame, head_ids: np.ndarray, head: np.ndarray, head_norm: float, dim: int, k: int) -> DataFrame:
    """(vec_id, v, q, norm, tau, least): a threshold for each query row, and the least length of a candidate that can reach it; q tells query rows of one id apart."""

    def run(batches):
        for b in batches:
            q = _matrix(b.column("v").to_pylist(), dim)
            if not len(q):
                continue
            ids, norm = b.column("vec_id").to_numpy(), b.column("norm").to_numpy()
            tau = np.full(len(q), np.iinfo(np.int64).min)
            for lo in range(0, len(q), 256):
                s = _products(q[lo : lo + 256], head, float(norm[lo : lo + 256].max()) * head_norm)
                for i in range(len(s)):
                    own = s[i][head_ids != ids[lo + i]]
                    if len(own) >= k:
                        tau[lo + i] = np.partition(own, len(own) - k)[len(own) - k]
            # by a margin for rounding; 0 where any candidate may do
            least = np.maximum((tau.astype(float) - 1e-6) / np.maximum(norm, 1e-300) / (1 + 1e-12), 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "v", "q", "norm")), pa.array(tau), pa.array(least)], names=["vec_id", "v", "q", "norm", "tau", "least"])

    return queries.select("vec_id", "v", "q", "norm").mapInArrow(run, "vec_id long, v binary, q long, norm double, tau long, least double")


def _cuts(df: DataFrame, column: str, rows: int, size: int) -> np.ndarray:
    """Values that cut a column of so many rows into intervals of about ``size``, ascending; wider ones from ``INTERVALS`` on, which are dealt out."""
    parts = min(-(-rows // size), INTERVALS)
    if parts < 2:
        return np.empty(0)
    return np.array(sorted(set(df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).first()[0])))


def _with_interval(df: DataFrame, column: str, cuts: np.ndarray) -> DataFrame:
    """``df`` with iv, the number of cuts at or below a column."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        for b in batches:
            iv = np.searchsorted(shared.value, b.column(column).to_numpy(), side="right")
            yield b.append_column("iv", pa.array(iv.astype(np.int32)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("iv", T.IntegerType())]))


def top_products(df: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query row.

    Null vectors and ids, and vectors with null or non-finite components, take
    no part.  Vectors of different lengths are compared over the components
    that both have; very long ones are scaled one at a time.  Rows with a
    query's own id are no candidates for it, so repeated ids never match each
    other.  Each row of a repeated query id is a query of its own, with its own
    list of k; a repeated candidate stands in a list once for each of its rows.
    Empty tables give no rows; other columns are not read.
    """
    spark = df.sparkSession
    vectors = written(integer_vectors(df), "topk-vectors")
    count, dim, asking = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0)), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not count or not asking or not dim:
        return spark.createDataFrame([], empty)
    rotation, first = _rotation(vectors, dim)
    head = vectors.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()
    head_ids = np.array([r["vec_id"] for r in head], np.int64)
    head_m = _matrix([r["v"] for r in head], dim)

    # Query rows, dealt out and told apart by a number of their own; written, so that it stays.
    rows = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).repartition(max(shuffle_width(spark), 1), F.xxhash64("vec_id", "v"))
    asked = written(_asked(rows.withColumn("q", F.monotonically_increasing_id()), head_ids, head_m, float(head[0]["norm"]), dim, k), "topk-asked")

    # Chunks of falling length, blocks of rising need; what very many share is dealt out by hash.
    laid = _with_interval(vectors, "norm", _cuts(vectors, "norm", count, CHUNK_ROWS))
    chunks = laid.groupBy("iv").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()
    waiting = _with_interval(asked, "least", _cuts(asked, "least", asking, QUERY_BLOCK))
    blocks = sorted(waiting.groupBy("iv").agg(F.count("*").alias("n"), F.min("least").alias("low")).collect(), key=lambda r: r["iv"])
    part, at = {}, 0
    for r in blocks:
        part[r["iv"]] = (at, -(-r["n"] // (2 * QUERY_BLOCK)))
        at += part[r["iv"]][1]
    # a chunk's rows go to the blocks before ``reach``; a query's to the chunks with a longest vector as long as it needs
    lows = np.array([r["low"] for r in blocks])
    ends = [sum(part[r["iv"]]) for r in blocks]
    meets = [(r["iv"], -(-r["n"] // (2 * CHUNK_ROWS)), float(r["top"]), ends[n - 1] if (n := int(np.searchsorted(lows, r["top"], side="right"))) else 0) for r in chunks]
    chunk = spark.createDataFrame(meets, "iv int, wide int, top double, reach int")
    block = spark.createDataFrame([(iv, b, n) for iv, (b, n) in part.items()], "iv int, base int, wide int")
    cand = laid.join(F.broadcast(chunk.filter("reach > 0")), "iv").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("wide")).cast("int"))
    cells = cand.select("iv", "part", "vec_id", "v", "norm", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("qb"))
    dealt = waiting.join(F.broadcast(block), "iv").select("vec_id", "v", "q", "norm", "tau", "least", (F.col("base") + F.pmod(F.xxhash64("q"), F.col("wide"))).cast("int").alias("qb"))
    tops = sorted(meets, key=lambda r: -r[2])
    shared = spark.sparkContext.broadcast(tops)

    def reached(batches):
        tops = shared.value
        lengths = -np.array([t for _, _, t, _ in tops])
        each = [[(iv, p) for p in range(wide)] for iv, wide, _, _ in tops]
        for b in batches:
            upto = np.searchsorted(lengths, -b.column("least").to_numpy(), side="right")
            for i, n in enumerate(upto):
                pairs = [p for e in each[:n] for p in e]
                for lo in range(0, len(pairs), 20_000):
                    some = pairs[lo : lo + 20_000]
                    same = pa.array(np.full(len(some), i))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(same) for c in ("vec_id", "v", "q", "norm", "tau", "qb")), pa.array([x for x, _ in some], pa.int32()), pa.array([x for _, x in some], pa.int32())], names=["vec_id", "v", "q", "norm", "tau", "qb", "iv", "part"])

    asks = dealt.mapInArrow(reached, "vec_id long, v binary, q long, norm double, tau long, qb int, iv int, part int")

    def meet(key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []}).astype("int64")
        if not len(c) or not len(q):
            return none
        c = c.sort_values(["norm", "vec_id"], ascending=[False, True])
        ci, cn, cm = c["vec_id"].to_numpy(), c["norm"].to_numpy(), _matrix(c["v"], dim)
        qi, qn, qm = q["vec_id"].to_numpy(), q["norm"].to_numpy(), _matrix(q["v"], dim)
        tau = q["tau"].to_numpy().astype(float)
        cr, qr = cm.astype(float) @ rotation, qm.astype(float) @ rotation
        crest, qrest = (np.sqrt(np.maximum((x[:, first:] ** 2).sum(1), 0)) for x in (cr, qr))
        held_s = [np.empty(0, np.int64)] * len(q)
        held_i = [np.empty(0, np.int64)] * len(q)
        for lo in range(0, len(c), BLOCK):
            hi = min(len(c), lo + BLOCK)
            live = np.flatnonzero(qn * cn[lo] * (1 + 1e-9) + 1e-3 >= tau)
            if not len(live):
                break  # lengths only fall from here
            bound = qr[live, :first] @ cr[lo:hi, :first].T + np.outer(qrest[live], crest[lo:hi])
            may = bound + 1e-9 * np.outer(qn[live], cn[lo:hi]) + 1e-3 >= tau[live, None]
            rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(rows):
                continue
            exact = _products(qm[live[rows]], cm[lo:hi][cols], float(qn.max() * cn[lo]))
            ids = ci[lo:hi][cols]
            for r, s in zip(live[rows], exact):
                ok = (s >= tau[r]) & (ids != qi[r])
                if not ok.any():
                    continue
                s, i = np.concatenate((held_s[r], s[ok])), np.concatenate((held_i[r], ids[ok]))
                best = _best(s, i, k)
                held_s[r], held_i[r] = s[best], i[best]
                if len(best) == k:
                    tau[r] = max(tau[r], float(s[best[-1]]))
        n = [len(x) for x in held_s]
        if not sum(n):
            return none
        return pd.DataFrame({"query_id": np.repeat(qi, n), "q": np.repeat(q["q"].to_numpy(), n), "vec_id": np.concatenate(held_i), "score": np.concatenate(held_s)})

    cell = ["iv", "part", "qb"]
    found = cells.groupBy(*cell).cogroup(asks.groupBy(*cell)).applyInPandas(meet, "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_products(read_table(spark, sf_dir, "embeddings"))
