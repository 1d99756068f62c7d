"""Exact n-gram Jaccard join by token-combination prefixes.

Tokens are hashed shingles, ordered by how many nodes hold them, rare before
frequent, then by hash; a node is a distinct token set.  A node of n tokens
differs from any partner in at most slack(n) = n - ceil(0.8 n) of them.

1. Counting.  Each task sorts the tokens of a batch and sends every distinct one
   once to the part of the hash range it falls in: with its owner, or, where
   several nodes of the batch hold it, with their number alone.  The parts add up
   and answer only for tokens in two nodes or more; back at its batch, a node with
   more than slack(n) tokens of its own has no partner and is done.  What is left,
   equal sets as one, is counted once more among itself.
2. Index.  A node's prefix runs through its tokens in order until their units
   exceed slack(n): a rare token is a unit.  Frequent tokens fall into groups by
   class and hash; in a group of class k, l tokens are max(0, l - k + 1) units, so
   the prefix is longer there, and all k-token combinations within the group are
   its keys.  Two linked nodes have a key in common: slack(n) differing tokens
   can't use up more units than that.  The number of groups follows the power of
   two that n lies over; a node whose partners may lie under it is indexed for
   that power too.
3. Candidates, in turns.  Lists of the same nodes are one list.  Short lists are
   taken in full; long ones against a few pivots, first the most central nodes.
   Lists that still join different components go on to the next turn, with eight
   times as many pivots, drawn by hash, until they count as short and are taken in
   full.  Components are contracted after each turn and only pairs between two of
   them are taken, so a node that has many links in a list is joined by its first
   few, and what is left for a fuller turn has few.  A pair is taken in the first
   list only that it has in common (as far as the last ``WINDOW`` keys of both
   tell), and only where sizes and xor sketches of the sets allow a link.
4. Verification on the whole token sets (tokens of one node alone can't meet).

Counts, order and sketches set the work alone, never the result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import combine, drop_written, mix64, read_table, release, row_key, shuffle_width, trim, written
from .keyfilter import key_filter, key_test

WORDS = 5
#: Similarity as a ratio of whole numbers.
ABOVE, UNDER = 4, 5
#: Nodes that hold a token, as a power of two, from which its class is 2 and 3.
PAIRS_FROM, TRIPLES_FROM = 5, 16
#: Lists of up to so many nodes are taken in full at once.
SHORT_LIST = 32
#: Nodes that a long list is held against in the first turn: the most central of each of so many shares.
PIVOTS = 4
#: Both grow by this in each turn.
GROWTH = SHORT_LIST // PIVOTS
#: Earlier keys of a node that are looked at to see a pair's first list.
WINDOW = 16
#: 64-bit words of a sketch.
SKETCH = 8
#: Bytes of text, and documents, whose tokens are held at once.
RUN_BYTES, RUN_DOCS = 3 << 20, 60_000
#: Bytes of text whose tokens make up a part of the hash range.
PART_BYTES = 4 << 20
#: A token is a 56-bit hash.
SPARE = np.uint64(8)
#: Owner of a token that several nodes of its batch hold.
SEVERAL = 0xFFFF

POSTINGS = "dest int, batch long, tokens binary, owners binary, counts binary, nodes binary, shared binary, info binary"
NODES = "node long, th binary, sets binary, n int, r int, tokens array<long>, classes binary"


def tokens(text: str | None) -> np.ndarray:
    """Distinct hashed shingles of a whole text, ascending; fewer words than a shingle are one token."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return (combine(h, len(words)) ^ np.uint64(len(words))) >> SPARE
    h = combine(h, WORDS) >> SPARE
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _uid() -> Column:
    """A node's name, hashed one to one, as the key tests take it."""
    return F.xxhash64("node").alias("uid")


def need(n):
    """Least overlap of a set of n tokens with any partner."""
    return -(-ABOVE * n // UNDER)


def _slices(batches):
    """Batches cut to about RUN_BYTES of text."""
    for b in batches:
        trim()
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(sizes, before + RUN_BYTES, side="right"))), lo + RUN_DOCS)
            yield b.slice(lo, hi - lo)
            lo = hi


# --- counting ---------------------------------------------------------------------


def _starts(s: np.ndarray) -> np.ndarray:
    """Where runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)


def _planes(t: np.ndarray) -> bytes:
    """Ascending tokens as the bytes of their differences, lowest bytes first: the high ones are nearly all zero and cost a shuffle little."""
    return np.diff(t, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:7].tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    d = np.zeros((len(raw) // 7, 8), np.uint8)
    d[:, :7] = np.frombuffer(raw, np.uint8).reshape(7, -1).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def _posted(batch: int, ths: list[bytes], sets: list[bytes], sizes: list[int], names: list[int], held: list[np.ndarray], parts: int):
    """The rows of POSTINGS of one batch of nodes; ``held``: the tokens of each that may be shared."""
    owner = np.repeat(np.arange(len(held)), [len(t) for t in held])
    h = np.concatenate([*held, np.empty(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    at = _starts(h)
    times = np.diff([*at, len(h)])
    several = times > 1
    kept = np.repeat(several, times)
    token, own = h[at], np.where(several, SEVERAL, owner[at]).astype("<u2")
    dest = ((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    cuts = _starts(dest)
    rows = []
    for lo, hi in zip(cuts, [*cuts[1:], len(dest)]):
        rows.append({"dest": int(dest[lo]), "batch": batch, "tokens": _planes(token[lo:hi]), "owners": own[lo:hi].tobytes(), "counts": times[lo:hi][several[lo:hi]].astype("<u4").tobytes()})
    # what the batch keeps for itself goes along and is passed on
    info = b"".join(a + b for a, b in zip(ths, sets))
    nodes = np.array(names, "<i8").tobytes() + np.array(sizes, "<u4").tobytes()
    rows.append({"dest": batch % parts, "batch": batch, "tokens": _planes(token[several]), "owners": owner[kept].astype("<u2").tobytes(), "counts": times[several].astype("<u4").tobytes(), "nodes": nodes, "info": info})
    return rows


_POSTING_SCHEMA = pa.schema([("dest", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("tokens", "owners", "counts", "nodes", "shared", "info")]])


def _from_texts(docs: DataFrame, parts: int) -> DataFrame:
    """POSTINGS of the distinct texts of each task; th is the digest of a text."""

    def run(batches):
        pid, k, seen = TaskContext.get().partitionId(), 0, set()
        for b in _slices(batches):
            ths, sets, sizes, names, held = [], [], [], [], []
            batch = pid * (1 << 23) + k
            for th, text in zip(b.column("th").to_pylist(), b.column("text").to_pylist()):
                if th in seen:
                    continue
                seen.add(th)
                t = tokens(text)
                ths.append(th)
                sets.append(xxhash.xxh3_128_digest(t.tobytes()))
                sizes.append(len(t))
                names.append(batch * 65536 + len(names))
                held.append(t)
            k += 1
            if ths:
                yield pa.RecordBatch.from_pylist(_posted(batch, ths, sets, sizes, names, held, parts), schema=_POSTING_SCHEMA)

    return docs.select("th", "text").mapInArrow(run, POSTINGS)


def _from_nodes(nodes: DataFrame, first, parts: int) -> DataFrame:
    """POSTINGS of those nodes of a written table of NODES that ``first`` is true for, by the hashes of their names."""

    def run(batches):
        pid, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            trim()
            whole = whole.filter(pa.array(first(whole.column("uid").to_numpy())))
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                col = {c: b.column(c).to_pylist() for c in ("th", "sets", "n", "node")}
                held = [np.asarray(x.values, np.int64).view(np.uint64) for x in b.column("tokens")]
                yield pa.RecordBatch.from_pylist(_posted(pid * (1 << 23) + k, col["th"], col["sets"], col["n"], col["node"], held, parts), schema=_POSTING_SCHEMA)
                k += 1

    return nodes.select("th", "sets", "n", "node", "tokens", _uid()).mapInArrow(run, POSTINGS)


def _added(table: pa.Table) -> pa.Table:
    """Of one part: the tokens that two nodes or more hold, for each batch, with their count as a power of two."""
    trim()
    rows, out = table.to_pylist(), []
    del table
    out += [r | {"dest": 0} for r in rows if r["nodes"] is not None]
    rows = [r for r in rows if r["nodes"] is None]
    token = [_from_planes(r["tokens"]) for r in rows]
    own = [np.frombuffer(r["owners"], "<u2") for r in rows]
    weight = []
    for o, r in zip(own, rows):
        w = np.ones(len(o), np.int64)
        w[o == SEVERAL] = np.frombuffer(r["counts"], "<u4")
        weight.append(w)
    if rows:
        every = np.concatenate(token)
        order = np.argsort(every, kind="stable")
        at = _starts(every[order])
        total = np.add.reduceat(np.concatenate(weight)[order], at)
        level = np.empty(len(every), np.uint8)
        level[order] = np.repeat(np.where(total > 1, np.floor(np.log2(total)), 0).astype(np.uint8), np.diff([*at, len(every)]))
        del every, order
        lo = 0
        for r, t, o in zip(rows, token, own):
            c = level[lo : lo + len(t)]
            lo += len(t)
            more = c > 0
            if more.any():
                out.append({"dest": 0, "batch": r["batch"], "tokens": _planes(t[more]), "owners": o[more].tobytes(), "shared": c[more].tobytes()})
    return pa.Table.from_pylist(out, schema=_POSTING_SCHEMA)


_NODE_SCHEMA = pa.schema([("node", pa.int64()), ("th", pa.binary()), ("sets", pa.binary()), ("n", pa.int32()), ("r", pa.int32()), ("tokens", pa.list_(pa.int64())), ("classes", pa.binary())])


def _regrouped(table: pa.Table) -> pa.Table:
    """Of one batch: its nodes, with the shared tokens of those that may have a partner, in order."""
    trim()
    rows = table.to_pylist()
    own_rows = [r for r in rows if r["nodes"] is not None]
    if len(own_rows) != 1:
        raise RuntimeError("the rows of a batch don't belong together; the input must give the same rows in the same order when a task is run again")
    me, rows = own_rows[0], [r for r in rows if r["nodes"] is None]
    m = len(me["nodes"]) // 12
    names, sizes = np.frombuffer(me["nodes"][: 8 * m], "<i8"), np.frombuffer(me["nodes"][8 * m :], "<u4").astype(np.int64)
    token = np.concatenate([np.empty(0, np.uint64), *[_from_planes(r["tokens"]) for r in rows]])
    own = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r["owners"], "<u2").astype(np.int64) for r in rows]])
    level = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(r["shared"], np.uint8) for r in rows]])
    many = own == SEVERAL
    if many.any():
        mine, times = _from_planes(me["tokens"]), np.frombuffer(me["counts"], "<u4").astype(np.int64)
        owners, first = np.frombuffer(me["owners"], "<u2").astype(np.int64), np.concatenate(([0], np.cumsum(times)[:-1]))
        at = np.searchsorted(mine, token[many])
        each = times[at]
        spots = np.repeat(first[at] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        token, own, level = [np.concatenate(x) for x in ((token[~many], np.repeat(token[many], each)), (own[~many], owners[spots]), (level[~many], np.repeat(level[many], each)))]
    shared = np.bincount(own, minlength=m)
    # tokens that no other node holds must not outnumber the slack; a set without tokens links with nothing
    stay = (sizes - shared <= sizes - need(sizes)) & (sizes > 0)
    keep = stay[own]
    token, own, level = token[keep], own[keep], level[keep]
    order = np.lexsort((token, level, own))
    token, own, level = token[order], own[order], level[order]
    per = np.bincount(own, minlength=m)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(token.view(np.int64)))
    ends, raw = np.concatenate(([0], np.cumsum(per))), level.tobytes()
    none = pa.array(~stay)
    return pa.Table.from_arrays(
        [
            pa.array(names, pa.int64()),
            pa.array([me["info"][32 * i : 32 * i + 16] for i in range(m)], pa.binary()),
            pa.array([me["info"][32 * i + 16 : 32 * i + 32] for i in range(m)], pa.binary()),
            pa.array(sizes, pa.int32()),
            pa.array(shared, pa.int32()),
            pc.if_else(none, pa.scalar(None, pa.list_(pa.int64())), lists),
            pa.array([raw[a:b] if s else None for a, b, s in zip(ends, ends[1:], stay)], pa.binary()),
        ],
        schema=_NODE_SCHEMA,
    )


def _counted(postings: DataFrame, name: str) -> DataFrame:
    """NODES, with tokens for those that may have a partner."""
    part = postings.groupBy("dest").applyInArrow(_added, POSTINGS)
    return written(part.groupBy("batch").applyInArrow(_regrouped, NODES), name)


# --- index ------------------------------------------------------------------------


@cache
def _chosen(l: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(l), k)), np.int64).reshape(-1, k)


def _mixed(columns: list[np.ndarray], tag: int) -> np.ndarray:
    x = np.full(len(columns[0]), tag, np.uint64)
    for c in columns:
        x = mix64(x ^ c) + c * np.uint64(0x9E3779B97F4A7C15)
    return mix64(x)


def schemes(n: int) -> list[int]:
    """Powers of two that a node of n tokens is indexed for: the one below n, and the next lower if partners may be under it."""
    b = n.bit_length() - 1
    return [b, b - 1] if b and need(n) < 1 << b else [b]


def groups(b: int, k: int) -> int:
    """Groups of class k for sizes from 2 ** b.

    As many as can be, for small groups have the fewest combinations a unit; a
    group costs k - 1 units, 0.8 * 2 ** b in all, less than any such set may lose.
    """
    return max(1, (2 << b) // 5 if k == 2 else (1 << b) // 5)


def index_keys(t: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """Keys of a node with shared tokens ``t``, ordered by ``level`` and hash, out of n tokens."""
    left = n - need(n) + 1 - (n - len(t))  # tokens of its own come first: units without a list
    often = level >= PAIRS_FROM if n >= 4 else np.zeros(len(t), bool)
    rare = t[~often][:left]
    keys, left = [_mixed([rare], 1)], left - len(rare)
    many, grade = t[often], np.where(level[often] >= TRIPLES_FROM, 3, 2)
    for b in schemes(n) if left > 0 else []:
        g = (grade << 48) + (mix64(many ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24)).astype(np.int64) % np.where(grade == 2, groups(b, 2), groups(b, 3))
        order = np.lexsort((many, g))
        s, g = many[order], g[order]
        at, units = _starts(g), left
        for lo, hi in zip(at, [*at[1:], len(g)]):
            k = int(g[lo]) >> 48
            l = min(hi - lo, units + k - 1)
            if l >= k:
                pick = s[lo : lo + l][_chosen(l, k)]
                keys.append(_mixed(list(pick.T), 16 * b + k))
                units -= l - k + 1
                if not units:
                    break
    return np.concatenate(keys)


def sketch(t: np.ndarray) -> np.ndarray:
    """Bits of 64 * SKETCH that an odd number of tokens falls on: two sets differ in as many tokens at least as their sketches do in bits."""
    h = mix64(t ^ np.uint64(0xA0761D6478BD642F))
    odd = np.bincount((h % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _indexed(nodes: DataFrame) -> DataFrame:
    """(node, key) for each key of each node."""

    def run(batches):
        for b in batches:
            trim()
            for lo in range(0, b.num_rows, 200):
                c = b.slice(lo, 200)
                keys = [index_keys(np.asarray(t.values, np.int64).view(np.uint64), np.frombuffer(v, np.uint8), n).view(np.int64) for t, v, n in zip(c.column("tokens"), c.column("classes").to_pylist(), c.column("n").to_pylist())]
                per = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c.column("node").to_numpy(), per)), pa.array(np.concatenate(keys))], names=["node", "key"])

    return nodes.select("node", "n", "tokens", "classes").mapInArrow(run, "node long, key long")


def _outlined(nodes: DataFrame) -> DataFrame:
    """(node, n, r, mid, s0 .. ): sketches, and how central a node is."""
    words = [f"s{i}" for i in range(SKETCH)]

    def run(batches):
        for b in batches:
            s = [sketch(np.asarray(t.values, np.int64).view(np.uint64)) for t in b.column("tokens")]
            mid = [float(np.exp2(np.minimum(np.frombuffer(v, np.uint8), 40), dtype=float).sum() / n) for v, n in zip(b.column("classes").to_pylist(), b.column("n").to_pylist())]
            if s:
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), b.column("r"), pa.array(mid), *map(pa.array, np.stack(s).T)], names=["node", "n", "r", "mid", *words])

    return nodes.select("node", "n", "r", "tokens", "classes").mapInArrow(run, "node long, n int, r int, mid double, " + ", ".join(f"{w} long" for w in words))


def _lists(nodes: DataFrame) -> DataFrame:
    """Entries (key, m, node, n, r, mid, sketch, before) of the lists of two nodes or more, a list of the same nodes once."""
    keys = written(_indexed(nodes), "jaccard-keys")
    prints = keys.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("g")).filter("m > 1")
    one = prints.groupBy("m", "f", "g").agg(F.min("key").alias("key"))
    held = keys.join(one.select("key", "m"), "key")
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-WINDOW, -1))
    held = held.withColumn("before", before).join(_outlined(nodes), "node")
    out = written(held, "jaccard-lists")
    drop_written(keys)
    return out


# --- candidates and links -------------------------------------------------------------


def _other(table: DataFrame) -> DataFrame:
    """Columns but the key under other names."""
    return table.select("key", *[F.col(c).alias(f"o_{c}") for c in table.columns if c not in ("key", "m")])


def _may_link() -> Column:
    """Sizes and sketches of an entry and another leave a link possible."""
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"o_s{i}"))) for i in range(SKETCH)), F.lit(0))
    n = F.col("n") + F.col("o_n")
    # the overlap is at most half of what the shared tokens of both leave beside those that differ
    return (UNDER * F.col("n") >= ABOVE * F.col("o_n")) & (UNDER * F.col("o_n") >= ABOVE * F.col("n")) & ((ABOVE + UNDER) * (F.col("r") + F.col("o_r") - apart) >= 2 * ABOVE * n)


def _first_list() -> Column:
    return ~F.arrays_overlap("before", "o_before")


def _candidates(left: DataFrame, right: DataFrame, once: Column | None = None) -> DataFrame:
    """Pairs (a, b), of components (ca, cb), of a list's entries on the left and on the right; ``once``: which of a pair's two orders is taken."""
    other = _other(right).withColumnRenamed("key", "o_key")
    on = (F.col("key") == F.col("o_key")) & (F.col("comp") != F.col("o_comp"))
    if once is not None:
        on &= once
    both = left.join(other, on & _may_link() & _first_list())
    low = F.col("node") < F.col("o_node")
    return both.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"), F.when(low, F.col("comp")).otherwise(F.col("o_comp")).alias("ca"), F.when(low, F.col("o_comp")).otherwise(F.col("comp")).alias("cb")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with Jaccard similarity at or above the threshold, as a written table."""
    # a late turn has few pairs: the tokens of the other nodes stay out of its shuffles
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(_uid())
    held = written(key_filter(ends)(nodes.select("node", "n", "tokens", _uid())).drop("uid"), "jaccard-ends")
    side = lambda x: held.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    meet = F.size(F.array_intersect("t_a", "t_b"))
    links = written(both.filter(UNDER * meet >= ABOVE * (F.col("n_a") + F.col("n_b") - meet)).select(*pairs.columns), "jaccard-links")
    drop_written(held)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each node's component, by alternating stars."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = written(small, "components")
        was, state = state, small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        drop_written(edges)
        edges = small
        if state == was:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")


def _turn(entries: DataFrame, pivots: int) -> DataFrame:
    """Candidates of one turn: lists of up to GROWTH * pivots nodes in full, longer ones against their pivots."""
    order = F.col("node") < F.col("o_node")
    if pivots > PIVOTS:
        # the same nodes are drawn in lists of like length, so a pair's first list has the pivot that its others have
        drawn = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(1 << 30)) * F.col("m") < F.lit(pivots << 30)
        marked = entries.withColumn("pivot", (F.col("m") <= GROWTH * pivots) | drawn)
        return _candidates(marked, marked.filter("pivot").drop("pivot"), ~F.col("pivot") | order)
    short, long_ = entries.filter(F.col("m") <= SHORT_LIST), entries.filter(F.col("m") > SHORT_LIST)
    bucket = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    middle = long_.groupBy("key", bucket.alias("bucket")).agg(F.max(F.struct("mid", "node")).alias("x")).select("key", F.col("x.node").alias("node"))
    return _candidates(short, short, order).union(_candidates(long_, long_.join(middle, ["key", "node"])))


def joined(nodes: DataFrame) -> DataFrame | None:
    """(node, comp) of each node but the least of its component, or None without any link."""
    lists = _lists(nodes)
    entries, comp, pivots = lists.withColumn("comp", F.col("node")), None, PIVOTS
    while True:
        pairs = written(_turn(entries, pivots), "jaccard-pairs")
        links = _verified(pairs, nodes)
        drop_written(pairs)
        if not links.isEmpty():
            # edges between the components so far: their number falls with every turn
            hop = written(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "jaccard-hops")
            if comp is None:
                comp = hop
            else:
                to = hop.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
                comp = written(comp.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).union(hop), "jaccard-comp")
        # longer lists that still join different components
        left = entries.filter(F.col("m") > GROWTH * pivots).drop("comp")
        left = left.withColumn("comp", F.col("node")) if comp is None else left.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        left = written(left, "jaccard-entries")
        open_ = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        entries, done = written(left.join(open_, "key", "left_semi"), "jaccard-open"), (left, lists if pivots == PIVOTS else entries)
        for table in done:
            drop_written(table)
        if entries.isEmpty():
            drop_written(entries)
            return comp
        pivots *= GROWTH


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row.

    Null and empty texts, and texts of white space, have no shingle, link with
    nothing and are their own component.  A row with a null id keeps a null
    component and gives its group no name, but links like others.  Repeated
    rows share a component; an empty table gives no rows.  Very long texts are
    read whole, in a batch of their own.  Other columns are not looked at.

    ``docs`` is read twice and must give the same rows in the same order when a
    lost task is run again, as files do.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.unhex(F.md5("text")).alias("th"), "text")
    rows = written(keyed.select("doc_id", "row_key", "th", F.octet_length("text").cast("long").alias("size")), "jaccard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_width(spark), -(-total // PART_BYTES))
    table = _counted(_from_texts(keyed.filter(F.col("text").isNotNull()), parts), "jaccard-nodes")
    release(spark)
    able = table.filter(F.col("tokens").isNotNull())
    of = able.select("node", "sets", F.size("tokens").alias("held")).withColumn("rep", F.min("node").over(Window.partitionBy("sets")))
    of = written(of.select("node", "rep", "held"), "jaccard-equal")
    held = of.filter("node = rep").agg(F.sum("held")).first()[0] or 0
    # equal sets are told apart where they lie; a join would send all tokens through a shuffle
    is_first = key_test(of.filter("node = rep").select(_uid()), of.filter("node <> rep").select(_uid()))
    nodes = _counted(_from_nodes(able, is_first, max(shuffle_width(spark), -(-8 * held // PART_BYTES))), "jaccard-able").filter(F.col("tokens").isNotNull())
    comp = joined(nodes)
    release(spark)
    # names: each text's node, its set's first node, its component
    texts = table.select("th", "node", "n").join(of, "node", "left").select("th", "n", F.coalesce("rep", "node").alias("node"))
    if comp is not None:
        texts = texts.join(comp, "node", "left").select("th", "n", F.coalesce("comp", "node").alias("node"))
    texts = texts.groupBy("th").agg(F.max("n").alias("n"), F.min("node").alias("node"))
    first = rows.filter("th IS NOT NULL").groupBy("th").agg(F.min("doc_id").alias("first"))
    texts = written(texts.join(first, "th", "left"), "jaccard-texts")
    # written, so that a component of very many texts can be split between tasks in the join
    name = written(texts.groupBy("node").agg(F.min("first").alias("component_id")), "jaccard-components")
    texts = written(texts.join(name, "node").select("th", "n", F.when(F.col("n") > 0, F.col("component_id")).alias("component_id")), "jaccard-names")
    out = rows.join(texts, "th", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "row_key")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents")).drop("row_key")
