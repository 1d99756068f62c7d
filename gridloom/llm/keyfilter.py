"""Bitmap of document keys, to keep texts that can't matter out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest bitmap sent to the executors, in bits; with more keys more rows hit it.
FILTER_BITS = 1 << 27


def _bitmap(keys: DataFrame):
    """(bits, broadcast words) of the keys in column ``uid``: no false negatives."""
    n = keys.count()
    bits = 1 << 10
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2
    words = keys.select(F.expr(f"pmod(uid, {bits}L) div 32L").alias("w"), F.expr("shiftleft(1L, cast(pmod(uid, 32L) as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toPandas()
    table = np.zeros(bits // 32, np.uint32)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return bits, keys.sparkSession.sparkContext.broadcast(table)


def squeezed(column: pa.Array) -> pa.Array:
    """Binary values, each compressed on its own."""
    coder = zstandard.ZstdCompressor(level=3)
    return pa.array([None if x is None else coder.compress(x) for x in column.to_pylist()], pa.binary())


def expand(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def _passing(df: DataFrame, bits: int, shared, want: bool, squeeze: str | None = None) -> DataFrame:
    def run(batches):
        t = shared.value
        for b in batches:
            s = np.mod(b.column("uid").to_numpy(), bits)
            hit = ((t[s >> 5] >> (s & 31).astype(np.uint32)) & 1).astype(bool)
            b = b.filter(pa.array(hit == want))
            if squeeze is not None:
                i = b.schema.get_field_index(squeeze)
                b = b.set_column(i, b.schema.field(i), squeezed(b.column(i)))
            yield b

    return df.mapInArrow(run, df.schema)


def key_filter(keys: DataFrame):
    """A filter on rows with column ``uid``: passes all with a key, and few others.

    With ``squeeze``, that binary column is compressed for the shuffle to come.
    """
    bits, shared = _bitmap(keys)
    return lambda df, squeeze=None: _passing(df, bits, shared, True, squeeze)


def key_split(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of ``keys``, rows that surely have none)."""
    bits, shared = _bitmap(keys)
    return _passing(df, bits, shared, True), _passing(df, bits, shared, False)


#: Keys held beside a bitmap at most; with more, a wider bitmap is taken.
EXCEPTIONS = 200_000
WIDEST_BITS = 1 << 31


def key_test(keys: DataFrame, others: DataFrame):
    """An exact membership test for tasks: true for ``keys``, false for ``others``.

    A bitmap of two probes, and the few keys of ``others`` that hit it by chance.
    """
    session = keys.sparkSession
    n, bits = keys.count(), 1 << 12
    while bits < 32 * n and bits < FILTER_BITS:
        bits *= 2
    while True:
        probe = [F.expr(f"pmod(uid, {bits}L)"), F.expr(f"pmod(shiftright(uid, 31), {bits}L)")]
        both = keys.select(F.explode(F.array(*probe)).alias("at"))
        words = both.groupBy(F.expr("at div 32L").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 32L) as int)))").alias("b")).toPandas()
        table = np.zeros(bits // 32, np.uint32)
        table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
        shared = session.sparkContext.broadcast(table)

        def hits(uid: np.ndarray, bits=bits, shared=shared) -> np.ndarray:
            t = shared.value
            spots = np.mod(uid, bits), np.mod(uid >> 31, bits)
            return np.logical_and(*[((t[a >> 5] >> (a & 31).astype(np.uint32)) & 1).astype(bool) for a in spots])

        def chance(batches, hits=hits):
            for b in batches:
                yield b.filter(pa.array(hits(b.column("uid").to_numpy())))

        false = others.mapInArrow(chance, "uid long")
        if bits >= WIDEST_BITS or false.count() <= EXCEPTIONS:
            break
        bits *= 4
    apart = session.sparkContext.broadcast(np.sort(false.toPandas()["uid"].to_numpy(np.int64)))

    def test(uid: np.ndarray) -> np.ndarray:
        return hits(uid) & ~np.isin(uid, apart.value)

    return test
