"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a ``LENGTH``-byte string over it also starts in a document with
a smaller id.  Any such string holds ``LENGTH - GRAM + 1`` grams of ``GRAM``
bytes, of which the least by hash, the leftmost of equals, is its anchor; equal
strings have equal anchors.  So the steps are:

0. A document whose whole text a smaller id has too is a copy and goes at once.
1. Anchors of all other documents; their hashes, packed by task, show which anchors
   occur in two documents or more.  Only those go on.
2. Each task sorts the suffixes at its anchors, with what stands before them,
   cut to the ``CONTEXT`` bytes that can matter.  Equal ones shrink to that of
   the smallest document (the others are marked at once), so a passage that a
   third of all documents hold is one entry a task.
3. The sorted runs travel front-coded (length of the prefix shared with the
   entry before, then the rest) and are combined by a loser tree that carries
   these lengths and so never compares a known prefix again.  The order gives
   equal contexts, and contexts that share an anchor but differ.
4. The latter, the borders of passages, are spelled out into their
   ``LENGTH``-byte windows, which are sorted, exchanged and merged likewise.

Marks are joined to the texts of marked documents alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, read_table, release, row_key, shuffle_width, trim, written
from .keyfilter import expand, key_filter, key_test

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM  # bytes before an anchor that its windows can take in
CONTEXT = REACH + LENGTH
#: Stands outside texts; no UTF-8 text has this byte.
PAD = 0xFF
#: An anchor in more places than this is dealt out by its whole context.
HOT_PLACES = 2000
#: Bytes of text taken up at once (a longer text is taken whole).
CHUNK = 1 << 20
#: Bytes of text, anchors and windows that one sorted run takes up.
RUN_BYTES, RUN_ANCHORS, RUN_WINDOWS = 4 << 20, 80_000, 6_000
POSITION_BITS = 28
HASH_BYTES = 5

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)

OUT = "kind int, part int, run long, uid long, blob binary"
MARK, CONTEXT_RUN, WINDOW_RUN = 0, 1, 2


# ---------------------------------------------------------------- anchors


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (the last ones run short)."""
    n = len(buf)
    h = buf.astype(np.uint64)
    full, step = None, 1
    for mult in MULTIPLIERS:
        if GRAM & step:  # lengths add up to GRAM, from the smallest power of two on
            if full is None:
                full = h
            else:
                out = h * np.uint64(0xA0761D6478BD642F)
                out[: n - step] += full[step:]
                full = out
        if step * 2 > GRAM:
            break
        out = h * np.uint64(mult)
        out[: n - step] += h[step:]
        h = out
        step *= 2
    return mix64(full)


def _chunks(texts: list[bytes]):
    """(index of the first, texts) of about CHUNK bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= CHUNK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _slices(batches):
    """Batches cut to about RUN_BYTES of text."""
    for b in batches:
        trim()
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + RUN_BYTES, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, anchor places in it, their hashes, their text's index, start of each text in it)."""
    gap = bytes([PAD]) * 64
    buf = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = 64 + np.concatenate(([0], np.cumsum(sizes + 64)[:-1])).astype(np.int64)
    long = sizes >= LENGTH
    h = _gram_hashes(buf)
    n = len(buf)
    x = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= REACH + 1:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = REACH + 1 - width
    x = np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
    edge = np.zeros(n + 1, np.int32)
    edge[starts[long]] += 1
    edge[starts[long] + sizes[long] - LENGTH + 1] -= 1
    valid = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    least = x[valid]
    place = np.unique((least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    return buf, place, h[place], np.searchsorted(starts, place, side="right") - 1, starts


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Even share of hashes; mixed again, as anchors have small ones."""
    return ((mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    """Low bytes, which name a hash within its part."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]


def _named(raw: bytes) -> np.ndarray:
    """Hashes in their low bytes, and above them whether they are hot."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES + 1)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : HASH_BYTES + 1] = low
    return wide.view("<u8").ravel()


# ---------------------------------------------------------------- front coding and the loser tree


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix with the row before, and the remaining bytes, of sorted rows."""
    n, width = keys.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = keys[1:] != keys[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return shared, keys[np.arange(width) >= shared[:, None]].tobytes()


def front_decode(shared: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    n = len(shared)
    own = np.arange(width) >= shared[:, None]
    keys = np.zeros((n, width), np.uint8)
    keys[own] = np.frombuffer(rest, np.uint8)
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    return keys[source, np.arange(width)]


def merge_runs(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Order of all entries (run after run numbered through) and each one's shared prefix with the one before.

    A tree of losers: each leaf's current key carries the length it shares with
    the last key put out.  Of two keys the one that shares more is the smaller;
    only where both share the same length are bytes compared, from there on.
    """
    runs = [r for r in runs]
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    keys = [r[0] for r in runs] + [[]] * (size - count)
    prefixes = [r[1] for r in runs] + [[]] * (size - count)
    lengths = [len(k) for k in keys]
    base, total = [], 0
    for n in lengths:
        base.append(total)
        total += n
    at = [0] * size
    current: list[bytes | None] = [k[0] if k else None for k in keys]
    known = [-1 if c is None else 0 for c in current]
    loser = [0] * size

    def contest(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known length becomes that with the winner."""
        x, y = current[a], current[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        i = known[a]
        if i != known[b]:
            return (a, b) if i > known[b] else (b, a)
        if x[i:] == y[i:]:
            known[b] = width
            return a, b
        while x[i] == y[i]:
            i += 1
        if x[i] < y[i]:
            known[b] = i
            return a, b
        known[a] = i
        return b, a

    winners = list(range(size))
    level = [*[0] * size, *winners]
    for node in range(size - 1, 0, -1):
        level[node], loser[node] = contest(level[2 * node], level[2 * node + 1])
    w = level[1] if size > 1 else 0
    order, shared = [], []
    for _ in range(total):
        i = at[w]
        order.append(base[w] + i)
        shared.append(known[w])
        i += 1
        at[w] = i
        if i < lengths[w]:
            x = current[w] = keys[w][i]
            k = prefixes[w][i]
        else:
            x, k = None, -1
            current[w] = None
        known[w] = k
        node = (size + w) >> 1
        while node:
            b = loser[node]
            kb = known[b]
            if k < kb:
                loser[node], w, k = w, b, kb
            elif k == kb and k >= 0:
                y, x = current[b], current[w]
                if x[k:] != y[k:]:
                    i = k
                    while x[i] == y[i]:
                        i += 1
                    if x[i] < y[i]:
                        known[b] = i
                    else:
                        known[w] = i
                        loser[node], w = w, b
                else:
                    known[b] = width
            node >>= 1
    return order, shared


def key_of(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A document's key: the high half of its id's xxHash64 (seed 42, as Spark has it), then the tag."""
    with np.errstate(over="ignore"):
        p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
        turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
        h = turn(doc.view(np.uint64) * p2, 31) * p1 ^ (np.uint64(42 + 8) + p5)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return (h & ~np.uint64(0xFFFFFFFF) | tag.astype(np.uint64)).view(np.int64)


class Rows:
    """Whose a key is: document, its key, and the places in its text where the key was found."""

    def __init__(self, doc, uid, places, count, back=None):
        self.doc, self.uid, self.places, self.count = doc, uid, places, count
        self.first = np.cumsum(count) - count
        self.back = np.zeros(len(doc), np.int64) if back is None else back

    @staticmethod
    def single(doc, uid, pos):
        return Rows(doc, uid, pos, np.ones(len(doc), np.int64))

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of all places of ``rows``, in their order."""
        c = self.count[rows]
        within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        which = np.repeat(rows, c)
        return which, self.places[self.first[which] + within] - self.back[which]


def _ends(at: np.ndarray, n: int) -> np.ndarray:
    return np.append(at[1:], n)


_squeeze = zstandard.ZstdCompressor(level=5)


def pack_run(keys: np.ndarray, rows: Rows, pick: np.ndarray) -> bytes:
    """Rows ``pick``, sorted by key and document; those of one document and key are one entry."""
    k, u = keys[pick], rows.uid[pick]
    new = np.ones(len(pick), bool)
    new[1:] = (u[1:] != u[:-1]) | (k[1:] != k[:-1]).any(1)
    at = np.flatnonzero(new)
    shared, rest = front_code(k[at])
    which, places = rows.expand(pick)
    count = np.add.reduceat(rows.count[pick], at)
    head = np.array([len(at), len(places)], np.int64).tobytes()
    return _squeeze.compress(head + rows.doc[pick][at].astype(np.int64).tobytes() + u[at].view(np.uint64).astype("<u4").tobytes() + count.astype("<u4").tobytes() + places.astype("<u4").tobytes() + shared.tobytes() + rest)


def unpack_run(blob: bytes, width: int):
    raw = expand(blob)
    n, m = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at = 16
    doc, tag = np.frombuffer(raw, np.int64, n, at), np.frombuffer(raw, "<u4", n, at + 8 * n)
    uid = key_of(doc, tag)
    at += 12 * n
    count, places = np.frombuffer(raw, "<u4", n, at), np.frombuffer(raw, "<u4", m, at + 4 * n)
    at += 4 * (n + m)
    shared = np.frombuffer(raw, np.uint8, n, at)
    return front_decode(shared, raw[at + n :], width), shared, doc, uid, count.astype(np.int64), places.astype(np.int64)


def merged(blobs, width: int) -> tuple[np.ndarray, np.ndarray, Rows]:
    """(keys, shared prefix, rows) of all runs in one order."""
    trim()
    runs = [unpack_run(b, width) for b in blobs]
    keys = np.concatenate([r[0] for r in runs])
    flat = keys.tobytes()
    named, base = [], 0
    for r in runs:
        n = len(r[1])
        named.append(([flat[(base + i) * width : (base + i + 1) * width] for i in range(n)], r[1].tolist()))
        base += n
    order, shared = merge_runs(named, width)
    del named, flat
    order = np.array(order, np.int64)
    doc, uid, count, places = (np.concatenate([r[i] for r in runs]) for i in (2, 3, 4, 5))
    whole = Rows(doc, uid, places, count)
    return keys[order], np.array(shared, np.int64), Rows(doc[order], uid[order], whole.expand(order)[1], count[order])


# ---------------------------------------------------------------- marks


def pack_marks(uid: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(uid, packed intervals) of each document, intervals joined where they meet."""
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    first = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1]))) if len(uid) else np.empty(0, np.int64)
    for lo, hi in zip(first, _ends(first, len(uid))):
        s, e = joined(start[lo:hi], end[lo:hi])
        yield int(uid[lo]), np.stack((s, e), 1).astype(np.int64).tobytes()


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted intervals."""
    if not len(start):
        return start, end
    upto = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > upto[:-1]))
    at = np.flatnonzero(new)
    return start[at], upto[_ends(at, len(start)) - 1]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "run", "uid", "blob"])


def _words(keys: np.ndarray) -> np.ndarray:
    """Rows as big-endian words, for sorting and comparing."""
    n, width = keys.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = keys
    return wide.view(">u8").astype(np.uint64)


def _row_hash(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        h = mix64(h ^ words[:, i])
    return h


def sorted_runs(keys, part, rows: Rows, span, run: int, kind: int) -> list[tuple]:
    """Sort rows, mark those that a smaller document of this task has too, pack the rest by part.

    ``span(row, place)`` gives (start, end) of what a key marks where it stands.
    """
    if not len(keys):
        return []
    words = _words(keys)
    order = np.lexsort((rows.uid, rows.doc, *[words[:, i] for i in range(words.shape[1] - 1, -1, -1)], part))
    words, part = words[order], part[order]
    new = np.ones(len(order), bool)
    new[1:] = (words[1:] != words[:-1]).any(1) | (part[1:] != part[:-1])
    del words
    at = np.flatnonzero(new)
    least = np.repeat(rows.doc[order[at]], _ends(at, len(order)) - at)  # rows of a group are in order of doc
    later = rows.doc[order] > least
    out = marks_of(rows, order[later], span)
    stay, part = order[~later], part[~later]
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    cuts = np.flatnonzero(new)
    return out + [(kind, int(part[lo]), run, 0, pack_run(keys, rows, stay[lo:hi])) for lo, hi in zip(cuts, _ends(cuts, len(part)))]


def marks_of(rows: Rows, some: np.ndarray, span) -> list[tuple]:
    if not len(some):
        return []
    which, place = rows.expand(some)
    s, e = span(which, place)
    ok = e - s >= LENGTH
    return [(MARK, -1, 0, u, b) for u, b in pack_marks(rows.uid[which][ok], s[ok], e[ok])]


#: A context's columns in sorting order: from the anchor on, then what stands before it, nearest first.
ORDER = np.concatenate((np.arange(REACH, CONTEXT), np.arange(REACH - 1, -1, -1)))
BACK = np.argsort(ORDER)


def borders(keys: np.ndarray, lcp: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes before the anchor that a window shared with another context can have.

    ``keys`` are distinct and sorted.  What a context shares with any other of
    its anchor, to the right and to the left, it shares with a neighbour in the
    order of that side.  Where contexts of one anchor are dealt ``apart``,
    neighbours say nothing and all windows count.
    """
    n = len(keys)
    if apart:
        return np.zeros(n, np.int64), np.full(n, REACH)
    first = np.where(lcp >= GRAM, lcp, 0)  # shared with the one before, if that has the same anchor
    first[0] = 0
    right = np.minimum(np.maximum(first, np.append(first[1:], 0)), LENGTH) - GRAM
    group = np.cumsum(first < GRAM)
    left = keys[:, LENGTH:]
    words = _words(left)
    order = np.lexsort((*[words[:, i] for i in range(words.shape[1] - 1, -1, -1)], group))
    sorted_ = left[order]
    same = np.zeros(n, np.int64)
    if n > 1:
        differ = sorted_[1:] != sorted_[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), REACH)
        same[1:] = np.where(group[order][1:] == group[order][:-1], shared, -1)
    same[0] = -1
    most = np.empty(n, np.int64)
    most[order] = np.maximum(same, np.append(same[1:], -1))
    return np.where(right < 0, REACH + 1, REACH - right), most


def windows_of(contexts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset before the anchor) of the windows in bounds whose anchor is the context's."""
    n = len(contexts)
    grams = CONTEXT - GRAM + 1
    h = _gram_hashes(np.concatenate((contexts.ravel(), np.zeros(CONTEXT, np.uint8))))[: n * CONTEXT].reshape(n, CONTEXT)[:, :grams]
    h = h & ~np.uint64((1 << POSITION_BITS) - 1)
    own = h[:, REACH]
    rows, offsets = [], []
    inside = contexts != PAD
    for o in range(REACH + 1):
        lo = REACH - o
        fits = inside[:, lo] & inside[:, lo + LENGTH - 1]
        left = (h[:, lo:REACH] > own[:, None]).all(1)
        right = (h[:, REACH + 1 : lo + REACH + 1] >= own[:, None]).all(1)
        r = np.flatnonzero(fits & left & right & (low <= o) & (o <= high))
        rows.append(r)
        offsets.append(np.full(len(r), o))
    return np.concatenate(rows), np.concatenate(offsets)


# ---------------------------------------------------------------- the operator


def decoded(parts: list[bytes]) -> str:
    """Text of the bytes between cuts; what a cut leaves of a character at an edge is dropped."""
    return "".join(p.decode("utf-8", "ignore") for p in parts)


def repeated_passages(docs: DataFrame, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sizes of all rows and which are copies of a smaller id's text, what is left of the others that lose something), by row key.

    Null texts are empty.  A row with a null id has no place in the order: it
    loses nothing and takes nothing from others.  Rows of one id don't take
    from each other, repeated rows get equal results; texts of fewer than
    LENGTH bytes are kept whole; an empty table gives no rows.  With ``texts``,
    what is left comes as whole characters in ``kept_text``, not as ``kept`` bytes.
    """
    spark = docs.sparkSession
    left, left_type, arrow_type = ("kept_text", "string", pa.string()) if texts else ("kept", "binary", pa.binary())
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    uid = F.expr("(xxhash64(cast(doc_id as bigint)) & -4294967296L) | (row_key & 4294967295L)")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text.alias("text")).select("doc_id", "row_key", uid.alias("uid"), "text")
    base = keyed.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    base = written(base, "suffix-base")
    # a whole text that a smaller id has too goes at once
    first_of = base.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)).groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first_of = written(first_of, "suffix-copied")
    base = written(base.join(first_of, "whole", "left").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "copies"), "suffix-marked")
    is_copy = key_test(base.filter("is_copy").select(F.col("row_key").alias("uid")), base.filter("NOT is_copy").select(F.col("row_key").alias("uid")))
    able = keyed.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    parts = max(shuffle_width(spark), 1)

    # 1. anchor hashes by part, with the low halves of their documents' keys
    def hashes(batches):
        for b in _slices(batches):
            b = b.filter(pa.array(~is_copy(b.column("row_key").to_numpy())))
            if not b.num_rows:
                continue
            texts, tags = b.column("text").to_pylist(), b.column("uid").to_numpy().view(np.uint64).astype("<u4")
            own_h, own_t = [], []
            for first, some in _chunks(texts):
                _, _, h, t, _ = anchors(some)
                own_h.append(h)
                own_t.append(t + first)
            h, t = np.concatenate(own_h), np.concatenate(own_t)
            p = _part(h, parts)
            order = np.lexsort((h, t, p))
            h, t, p = h[order], t[order], p[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
            h, t, p = h[new], t[new], p[new]
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            cuts = np.flatnonzero(new)
            rows = []
            for lo, hi in zip(cuts, _ends(cuts, len(p))):
                own, per = np.unique(t[lo:hi], return_counts=True)
                rows.append({"part": int(p[lo]), "tags": tags[own].tobytes(), "per": per.astype("<u4").tobytes(), "hashes": _low(h[lo:hi]).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("tags", pa.binary()), ("per", pa.binary()), ("hashes", pa.binary())]))

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        trim()
        low = np.frombuffer(b"".join(pdf["hashes"]), np.uint8).reshape(-1, HASH_BYTES)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :HASH_BYTES] = low
        h = wide.view("<u8").ravel()
        per = np.frombuffer(b"".join(pdf["per"]), "<u4")
        doc = np.repeat(np.arange(len(per), dtype=np.int32), per)  # a document of one task
        tags = np.frombuffer(b"".join(pdf["tags"]), "<u4")
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        size = _ends(at, len(s)) - at
        places = np.repeat(size, size)
        many = np.sort(order[places > 1])  # by document again
        hot = np.zeros(len(h), np.uint8)
        hot[order] = places > HOT_PLACES
        wide[:, HASH_BYTES] = hot
        doc = doc[many]
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        cuts = np.flatnonzero(new)
        named = np.ascontiguousarray(wide[many][:, : HASH_BYTES + 1])
        count = _ends(cuts, len(doc)) - cuts
        own = tags[doc[cuts]]
        to = (mix64(own.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        new = np.ones(len(to), bool)
        new[1:] = to[order][1:] != to[order][:-1]
        at = np.flatnonzero(new)
        rows = []
        for lo, hi in zip(at, _ends(at, len(to))):
            which = order[lo:hi]
            rows.append((int(to[which[0]]), own[which].tobytes(), count[which].astype("<u4").tobytes(), b"".join(named[cuts[i] : cuts[i] + count[i]].tobytes() for i in which)))
        return pd.DataFrame(rows, columns=["part", "tags", "per", "hashes"])

    def by_tag(pdf: pd.DataFrame) -> pd.DataFrame:
        tags = np.frombuffer(b"".join(pdf["tags"]), "<u4")
        per = np.frombuffer(b"".join(pdf["per"]), "<u4").astype(np.int64)
        named = np.frombuffer(b"".join(pdf["hashes"]), np.uint8).reshape(-1, HASH_BYTES + 1)
        first = np.cumsum(per) - per
        order = np.argsort(tags, kind="stable")
        new = np.ones(len(tags), bool)
        new[1:] = tags[order][1:] != tags[order][:-1]
        at = np.flatnonzero(new)
        out = [(int(tags[order[lo]]), b"".join(named[first[i] : first[i] + per[i]].tobytes() for i in order[lo:hi])) for lo, hi in zip(at, _ends(at, len(tags)))]
        return pd.DataFrame(out, columns=["tag", "shared"]).astype({"tag": "int64"})

    some = able.select("uid", "row_key", "text").mapInArrow(hashes, "part int, tags binary, per binary, hashes binary").groupBy("part").applyInPandas(repeated, "part int, tags binary, per binary, hashes binary")
    shared = written(some.groupBy("part").applyInPandas(by_tag, "tag long, shared binary"), "suffix-shared")

    del some
    release(spark)

    # 2. runs of contexts; a tag that two documents share only lets more anchors through
    pass_shared = key_filter(shared.select(F.col("tag").alias("uid")))
    tagged = pass_shared(able.select("doc_id", F.col("uid").alias("key"), F.expr("uid & 4294967295L").alias("uid"), "text"), squeeze="text")
    joined_text = tagged.join(shared, tagged["uid"] == shared["tag"]).select("doc_id", F.col("key").alias("uid"), "text", "shared")
    low_mask = np.uint64((1 << (8 * HASH_BYTES)) - 1)

    def flush(held):
        if not held:
            return
        keys, part, doc, uid, pos = (np.concatenate(x) for x in zip(*held))
        before = (keys[:, LENGTH:] != PAD).sum(1)
        after = (keys[:, :LENGTH] != PAD).sum(1)
        rows = sorted_runs(keys, part, Rows.single(doc, uid, pos), lambda r, q: (q - before[r], q + after[r]), uuid.uuid4().int & ((1 << 62) - 1), CONTEXT_RUN)
        if rows:
            yield pa.RecordBatch.from_pandas(_frame(rows).astype({"kind": "int32", "part": "int32", "run": "int64", "uid": "int64"}), preserve_index=False)

    def contexts(batches):
        for b in _slices(batches):
            texts = [expand(x) for x in b.column("text").to_pylist()]
            docs_, uids = b.column("doc_id").to_numpy(), b.column("uid").to_numpy()
            want = [_named(x) for x in b.column("shared").to_pylist()]
            held, count = [], 0
            for first, lot in _chunks(texts):
                buf, place, h, t, starts = anchors(lot)
                low = h & low_mask
                pick = np.zeros(len(h), bool)
                hot = np.zeros(len(h), bool)
                edges = np.searchsorted(t, np.arange(len(lot) + 1))
                for i in range(len(lot)):
                    w = want[first + i]
                    lo, hi = edges[i], edges[i + 1]
                    pick[lo:hi] = np.isin(low[lo:hi], w & low_mask)
                    heat = w[w > low_mask]
                    if len(heat):
                        hot[lo:hi] = np.isin(low[lo:hi], heat & low_mask)
                place, h, t, hot = place[pick], h[pick], t[pick], hot[pick]
                ctx = buf[place[:, None] + np.arange(-REACH, LENGTH)]
                # what lies beyond the text's own padding is padding too
                gone = np.logical_or.accumulate(ctx[:, REACH:] == PAD, axis=1)
                ctx[:, REACH:][gone] = PAD
                gone = np.logical_or.accumulate(ctx[:, :REACH][:, ::-1] == PAD, axis=1)[:, ::-1]
                ctx[:, :REACH][gone] = PAD
                k = ctx[:, ORDER]
                p = _part(h, parts)
                if hot.any():
                    p[hot] = parts + _part(_row_hash(_words(k[hot])), parts)
                held.append((k, p, docs_[first + t], uids[first + t], place - starts[t]))
                count += len(k)
                if count >= RUN_ANCHORS:
                    yield from flush(held)
                    held, count = [], 0
            yield from flush(held)

    # marks travel with the runs, dealt by document, so that nothing need be read twice
    first = joined_text.mapInArrow(contexts, OUT)

    # 3. merge of contexts; borders go on as windows
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = pdf["kind"] == CONTEXT_RUN
        passed = list(pdf[~runs].itertuples(index=False, name=None))
        pdf = pdf[runs]
        if not len(pdf):
            return _frame(passed)
        p = int(pdf["part"].iloc[0])
        keys, lcp, rows = merged(pdf["blob"], CONTEXT)
        n = len(keys)
        before, after = (keys[:, LENGTH:] != PAD).sum(1), (keys[:, :LENGTH] != PAD).sum(1)
        new = lcp < CONTEXT
        new[0] = True
        at = np.flatnonzero(new)
        size = _ends(at, n) - at
        least = np.repeat(np.minimum.reduceat(rows.doc, at), size)
        later = rows.doc > least
        out = passed + marks_of(rows, np.flatnonzero(later), lambda r, q: (q - before[r], q + after[r]))
        low, high = borders(keys[at], lcp[at], p >= parts)
        low, high = np.repeat(low, size), np.repeat(high, size)
        mine = np.flatnonzero(~later & (low <= high))
        for lo in range(0, len(mine), RUN_WINDOWS):
            r0 = mine[lo : lo + RUN_WINDOWS]
            c = keys[r0][:, BACK]
            row, off = windows_of(c, low[r0], high[r0])
            if not len(row):
                continue
            w = c.ravel()[(row * CONTEXT + REACH - off)[:, None] + np.arange(LENGTH)]
            which, place = rows.expand(r0)
            some = Rows(rows.doc[r0], rows.uid[r0], place, rows.count[r0])
            own = Rows(some.doc[row], some.uid[row], some.places, some.count[row], off)
            own.first = some.first[row]
            out += sorted_runs(w, _part(_row_hash(_words(w)), parts), own, lambda r, q: (q, q + LENGTH), (p << 20) + lo, WINDOW_RUN)
        return _frame(out)

    dealt = F.when(F.col("part") < 0, F.pmod("uid", F.lit(parts)).cast("int")).otherwise(F.col("part"))
    second = first.withColumn("part", dealt).groupBy("part").applyInPandas(meet, OUT)

    # 4. merge of windows
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = pdf["kind"] == WINDOW_RUN
        passed = list(pdf[~runs].itertuples(index=False, name=None))
        pdf = pdf[runs]
        if not len(pdf):
            return _frame(passed)
        _, lcp, rows = merged(pdf["blob"], LENGTH)
        new = lcp < LENGTH
        new[0] = True
        at = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(rows.doc, at), _ends(at, len(lcp)) - at)
        return _frame(passed + marks_of(rows, np.flatnonzero(rows.doc > least), lambda r, q: (q, q + LENGTH)))

    third = second.withColumn("part", dealt).groupBy("part").applyInPandas(settle, OUT)
    marks = written(third.select("uid", "blob").groupBy("uid").agg(F.collect_list("blob").alias("marks")), "suffix-marks")

    del first, second, third, joined_text, tagged
    release(spark)

    def remove(batches):
        for b in batches:
            out = []
            for raw, blobs in zip(map(expand, b.column("text").to_pylist()), b.column("marks").to_pylist()):
                m = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
                m = m[np.argsort(m[:, 0], kind="stable")]
                s, e = joined(m[:, 0], m[:, 1])
                kept, last, gone = [], 0, 0
                for x, y in zip(s.tolist(), e.tolist()):
                    kept.append(raw[last:x])
                    gone += y - x
                    last = y
                kept.append(raw[last:])
                out.append((gone, len(s), decoded(kept) if texts else b"".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column("row_key"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], arrow_type)], names=["row_key", "n_removed", "n_spans", left])

    pass_marked = key_filter(marks.select("uid"))
    cut = pass_marked(able.select("uid", "row_key", "text"), squeeze="text").join(marks, "uid").mapInArrow(remove, f"row_key long, n_removed long, n_spans long, {left} {left_type}")
    return base, cut


def removal_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: sizes and the digest of what is left."""
    base, cut = repeated_passages(docs)
    done = cut.select("row_key", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).groupBy("row_key").agg(F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max("sha").alias("sha"))
    zero, copy = F.lit(0).cast("long"), F.col("is_copy")
    return base.join(done, "row_key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digests(read_table(spark, sf_dir, "documents"))
