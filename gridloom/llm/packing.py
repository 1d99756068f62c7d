"""Packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is a
histogram of at most ``capacity`` counts whatever the corpus's size; it is
solved on the driver for all documents together.  Around the largest piece an
undominated filling of the room left is searched for; the sums that the pieces
left can make bound its waste, and branches that miss that bound are not
followed, so the search of a sequence is exact.  Best fit decreasing is the
incumbent; greedy completions, with large or with small pieces first, replace it
while they use fewer sequences.  While the lower bound isn't met, the search then
goes back over sequences: every undominated filling of the largest piece, by
waste, each as often as its pieces last and then less often, as long as all
waste so far leaves a plan better than the incumbent.  It ends when the bound
is met, when nothing is left to try, or after ``SEARCH_STEPS`` fillings, for
the problem has no fast exact solution; all pieces are placed in any case.
Pieces then find their place by their rank among those
of the same length, counted in buckets, so that a very common length is no
single task's work.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, shuffle_width, written

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Fillings, besides two for each of a plan, that the search over sequences tries before it leaves the plan as it is.
SEARCH_STEPS = 60_000

#: A run of blanks beyond which the rank file's codec, whose pattern steps back over it, gives way to the tokenizer's library.
LONG_BLANKS = re.compile(r"\s{20000}")

_codecs: dict[str, object] = {}


def _codec(path: str):
    """The byte-level BPE whose ranks are at ``path``."""
    if path not in _codecs:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return _codecs[path]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a shorter first one."""
    rest = length % capacity
    out = [(0, rest)] if rest else []
    return out + [(s, capacity) for s in range(rest, length, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; the end id counts."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            at, number, starts, lengths, crcs = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                tokens = np.array([*encode(text or "", path), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    at.append(row)
                    number.append(k)
                    starts.append(s)
                    lengths.append(n)
                    crcs.append(zlib.crc32(tokens[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def encode(text: str, path: str) -> list[int]:
    """Ids of a whole text, the same by either library; ``path`` names the rank file, beside which the tokenizer's lies."""
    if not LONG_BLANKS.search(text):
        return _codec(path).encode(text, allowed_special="all")
    whole = path.removesuffix(".tiktoken") + ".json"
    if whole not in _codecs:
        from tokenizers import Tokenizer

        _codecs[whole] = Tokenizer.from_file(whole)
    return _codecs[whole].encode(text, add_special_tokens=False).ids


class Shelf:
    """Counts of pieces by length, with the lengths still there in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.sizes = sorted(self.left)

    def take(self, filling: list[int], times: int) -> None:
        for n in filling:
            self.left[n] -= times
        for n in set(filling):
            if not self.left[n]:
                del self.left[n]
                self.sizes.remove(n)

    def put(self, filling: list[int], times: int) -> None:
        """Undo :meth:`take`."""
        for n in filling:
            if n not in self.left:
                self.left[n] = 0
                insort(self.sizes, n)
            self.left[n] += times

    def lasts(self, filling: list[int]) -> int:
        need: dict[int, int] = {}
        for n in filling:
            need[n] = need.get(n, 0) + 1
        return min(self.left[n] // k for n, k in need.items())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """The incumbent: every piece, longest first, into the sequence with the least room that takes it."""
    rooms: list[int] = []
    held: dict[int, list[tuple[int, list[int]]]] = {}

    def put(times: int, filling: list[int], room: int) -> None:
        if room not in held:
            insort(rooms, room)
        held.setdefault(room, []).append((times, filling))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left > 0:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                room, times, filling = capacity, left, []
            else:
                room = rooms[i]
                times, filling = held[room].pop()
                if not held[room]:
                    del held[room], rooms[i]
            # after a piece the same sequence has the least room, so it takes as many as fit
            each = room // n
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            if full:
                put(full, filling + [n] * each, room - each * n)
            if 0 < rest:
                put(1, filling + [n] * rest, room - rest * n)
            if filling and times > full + (rest > 0):
                put(times - full - (rest > 0), filling, room)
            left -= full * each + rest
    return [x for group in held.values() for x in group]


def reachable(shelf: Shelf, first: int, room: int) -> list[tuple[int, int, int]]:
    """(length, how many are there, bits of the sums up to ``room`` that this length and shorter ones make), shortest first."""
    whole, bits, out = (1 << (room + 1)) - 1, 1, []
    for n in shelf.sizes:
        if n > room:
            break
        count = min(shelf.left[n] - (n == first), room // n)
        left, step = count, 1
        while left > 0:
            k = min(step, left)
            bits |= bits << (n * k) & whole
            left, step = left - k, 2 * step
        out.append((n, count, bits))
    return out


def completion(shelf: Shelf, first: int, room: int, large: bool = True) -> list[int]:
    """An undominated filling of least waste, found exactly.

    A filling is dominated if a piece in it could give way to a larger one that
    still fits, or another piece be added; one of least waste never is.  The sums
    that the pieces can make bound the waste from below; the search follows only
    branches that reach that bound, larger pieces first or, not ``large``, as
    few of them as will do.
    """
    if shelf.left.get(room, 0) - (room == first) > 0 and large:
        return [room]
    sums = reachable(shelf, first, room)
    if not sums:
        return []
    target = sums[-1][2].bit_length() - 1
    out: list[int] = []
    for i in range(len(sums) - 1, -1, -1):
        n, count, _ = sums[i]
        below = sums[i - 1][2] if i else 1
        takes = range(min(count, target // n) + 1)
        k = next(k for k in (reversed(takes) if large else takes) if below >> (target - k * n) & 1)
        out += [n] * k
        target -= k * n
    return out


def _exactly(sums: list[tuple[int, int, int]], i: int, target: int):
    """Every filling of the first ``i`` lengths of ``sums`` that makes ``target``, larger pieces first."""
    if not target:
        yield []
        return
    for j in range(i - 1, -1, -1):
        n, count, bits = sums[j]
        if not bits >> target & 1:
            return
        below = sums[j - 1][2] if j else 1
        for k in range(min(count, target // n), 0, -1):
            if below >> (target - k * n) & 1:
                for rest in _exactly(sums, j, target - k * n):
                    yield [n] * k + rest


def dominated(shelf: Shelf, first: int, filling: list[int], room: int) -> bool:
    """A piece left over fits beside the filling, or in place of smaller pieces in it that together are no longer."""
    slack, bits, at = room - sum(filling), 1, len(filling)
    for n in shelf.sizes:
        if n > room:
            break
        while at and filling[at - 1] < n:
            at -= 1
            bits |= bits << filling[at]
        if shelf.left[n] - (n == first) > filling.count(n) and bits >> max(0, n - slack) & ((1 << (min(n, slack) + 1)) - 1):
            return True
    return False


def fillings(shelf: Shelf, first: int, room: int, spare: int, steps: list[int]):
    """(waste, pieces) of each undominated filling that wastes up to ``spare``, least waste first; a dominated one is a step, too."""
    sums = reachable(shelf, first, room)
    for waste in range(min(spare, room) + 1):
        if (sums[-1][2] if sums else 1) >> (room - waste) & 1:
            for filling in _exactly(sums, len(sums), room - waste):
                steps[0] -= 1
                if steps[0] < 0:
                    return
                if not dominated(shelf, first, filling, room):
                    yield waste, filling


def search(counts: dict[int, int], capacity: int, incumbent: list[tuple[int, list[int]]], least: int, steps: int) -> list[tuple[int, list[int]]]:
    """The best plan that branching over fillings, and back over sequences, finds in so many steps; the incumbent if none is better."""
    total = sum(n * c for n, c in counts.items())
    best = sum(t for t, _ in incumbent)
    shelf, steps_left = Shelf(counts), [steps]

    def branches(first: int, after: tuple | None, wasted: int):
        room = capacity - first
        for waste, filling in fillings(shelf, first, room, (best - 1) * capacity - total - wasted, steps_left):
            key = (waste, [-n for n in filling])
            if after is None or key > after:
                for times in range(shelf.lasts([first, *filling]), 0, -1):
                    if wasted + waste * times <= (best - 1) * capacity - total:
                        yield waste, filling, times, key

    # (branches, largest piece, waste so far, what of it is in use)
    stack = [[branches(shelf.sizes[-1], None, 0), shelf.sizes[-1], 0, None]]
    while stack and best > least and steps_left[0] > 0:
        frame = stack[-1]
        if frame[3]:
            shelf.put(*frame[3])
            frame[3] = None
        found = next(frame[0], None)
        if found is None:
            stack.pop()
            continue
        steps_left[0] -= 1
        waste, filling, times, key = found
        frame[3] = [frame[1], *filling], times
        shelf.take(*frame[3])
        wasted = frame[2] + waste * times
        if shelf.sizes:
            first = shelf.sizes[-1]
            stack.append([branches(first, key if first == frame[1] else None, wasted), first, wasted, None])
        elif sum(f[3][1] for f in stack) < best:
            incumbent = [(f[3][1], f[3][0]) for f in stack]
            best = sum(t for t, _ in incumbent)
    return incumbent


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: total length, and pieces that can't share one."""
    total = sum(n * c for n, c in counts.items())
    bound = -(-total // capacity)
    for t in range(1, capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - t)
        big = sum(c for n, c in counts.items() if capacity / 2 < n <= capacity - t)
        room = sum(c * (capacity - n) for n, c in counts.items() if capacity / 2 < n <= capacity - t)
        small = sum(n * c for n, c in counts.items() if t <= n <= capacity / 2)
        bound = max(bound, alone + big + max(0, -(-(small - room) // capacity)))
    return bound


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths in order) of each filling; every piece is used once."""

    def run(fill) -> list[tuple[int, list[int]]]:
        shelf, out = Shelf(counts), []
        while shelf.sizes:
            first = shelf.sizes[-1]
            filling = [first, *fill(shelf, first, capacity - first)]
            times = shelf.lasts(filling)
            shelf.take(filling, times)
            out.append((times, filling))
        return out

    bins = lambda p: sum(t for t, _ in p)
    least, incumbent = lower_bound(counts, capacity), best_fit(counts, capacity)
    for branch in (completion, lambda *a: completion(*a, large=False)):
        if bins(incumbent) == least:
            break
        incumbent = min(incumbent, run(branch), key=bins)
    if bins(incumbent) == least:
        return incumbent
    return search(counts, capacity, incumbent, least, SEARCH_STEPS + 2 * len(incumbent))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece.

    Null and empty texts are a lone end id.  Very long texts are encoded whole,
    long runs of blanks included.  Rows with a null id and repeated rows are packed
    like others, each in its own place; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    cuts = written(pieces(docs, path, capacity), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, filling in plan(counts, capacity):
        offset = 0
        for n in filling:
            slots.setdefault(n, []).append((rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    table = {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in slots.items()}

    buckets = 4 * shuffle_width(spark)
    dealt = cuts.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    per = dealt.groupBy("length", "b").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "b", "before")
    ranked = dealt.withColumn("k", inside).join(before, ["length", "b"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("k"))

    def place(batches):
        for b in batches:
            n, k = b.column("length").to_numpy(), b.column("k").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(n):
                rows = n == size
                starts, base, offset = table[int(size)]
                at = np.searchsorted(starts, k[rows], side="right") - 1
                seq[rows] = base[at] + k[rows] - starts[at]
                off[rows] = offset[at]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
