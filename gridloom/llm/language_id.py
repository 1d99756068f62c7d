"""Language identification by language-bitmask n-gram filters.

The most frequent character n-grams of each language, counted over all
training documents, go into a bit-sliced Bloom filter: a slot holds one bit a
language, so that a few look-ups and an AND give every language that has an
n-gram.  A document's n-grams are counted language by language, corrected for
the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, read_table, shuffle_width, written

HELD_OUT_MOD, HELD_OUT_REST = 3, 1
GRAM = 4
#: n-grams kept a language: the filter's size doesn't grow with the corpus.
TOP_GRAMS = 6_000
#: An n-gram belongs to a language where its rate is at least this share of its highest rate.
RATE_SHARE = 0.1
SLOT_BITS, PROBES = 18, 3
#: Characters handled at once; longer texts are cut for memory only, n-grams over the cut included.
CHUNK = 400_000

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None], gaps: int = GRAM - 2, lead: int = 0, cut: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters and word ends with up to ``gaps`` gaps, and the index of each one's text.

    Of a part of a text, those wholly in its ``lead`` first symbols don't count,
    nor, where it is ``cut`` at its end, those that reach beyond.
    """
    gap = "\0" * (GRAM - 1)
    lowered = [(t or "").lower() for t in texts]
    joined = gap + gap.join(lowered) + gap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + len(gap) for t in lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(lowered)), sizes)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each word
    keep[: GRAM - 1] = True
    # the gaps between texts stay whole: no n-gram spans two texts
    ends = np.cumsum(sizes)
    for i in range(GRAM - 1):
        keep[ends + i] = True
    value = np.where(letter, points, 0)[keep].astype(np.uint64)
    own = np.concatenate((np.zeros(GRAM - 1, np.int64), owner))[keep]
    n = len(value) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc, held, owners = np.zeros(n, np.uint64), np.zeros(n, np.int8), np.zeros(n, np.int64)
    for i in range(GRAM):
        part = value[i : i + n]
        acc = acc * np.uint64(0x1F123BB5F4A7C15D) + part
        has = part > 0
        owners[has] = own[i : i + n][has]  # all letters of a window are of one text
        held += has
    some = (held > 0) & (held >= GRAM - gaps)
    some[:lead] = False
    if cut:
        some[n - GRAM + 1 :] = False
    return mix64(acc[some]), owners[some]


def _parts(texts: list[str | None]):
    """(indices, texts, lead, cut) of about ``CHUNK`` characters, the last two as :func:`grams` takes them.

    A longer text comes in parts cut after words.  A part begins with the last
    symbols of those before it, one fewer than an n-gram has, so that n-grams
    over the cut are there and none counts twice.
    """
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if len(t) > CHUNK:
            t = t.lower()  # whole, as a letter's form may depend on its neighbours
            start, lead = 0, ""
            while start < len(t):
                end = min(len(t), start + CHUNK)
                while end < len(t) and not (t[end - 2].isalpha() and not t[end - 1].isalpha()) and end - start < 2 * CHUNK:
                    end += 1
                part = lead + t[start:end]
                yield [i], [part], len(lead.lstrip()), end < len(t)
                lead, tail = _symbols(part[-400:]), 400
                while len(lead) < GRAM and tail < len(part):
                    tail *= 4
                    lead = _symbols(part[-tail:])
                lead = lead[1 - GRAM :]
                start = end
            continue
        at.append(i)
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield at, held, 0, False
            at, held, size = [], [], 0
    if at:
        yield at, held, 0, False


def _symbols(text: str) -> str:
    """Letters, and one blank after each word."""
    return "".join(c if c.isalpha() else " " for i, c in enumerate(text) if c.isalpha() or (i and text[i - 1].isalpha()))


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training texts, counted within each task first."""

    def run(batches):
        held: dict[str, list] = {}

        def flush():
            for lang, parts in held.items():
                g = np.concatenate([p[0] for p in parts])
                c = np.concatenate([p[1] for p in parts])
                order = np.argsort(g, kind="stable")
                g, c = g[order], c[order]
                first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
                yield lang, g[first], np.add.reduceat(c, first) if len(g) else c

        def out():
            for lang, g, c in flush():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

        waiting = 0
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in set(langs):
                for _, part, lead, cut in _parts([t for t, x in zip(texts, langs) if x == lang]):
                    g, c = np.unique(grams(part, lead=lead, cut=cut)[0], return_counts=True)
                    held.setdefault(lang, []).append((g, c))
                    waiting += len(g)
            if waiting > 3_000_000:
                merged = list(flush())
                held.clear()
                for lang, g, c in merged:
                    held[lang] = [(g, c)]
                waiting = sum(len(g) for _, g, _ in merged)
                if waiting > 2_000_000:
                    yield from out()
                    held.clear()
                    waiting = 0
        yield from out()

    return train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Slots of language bits, with each language's false-positive rate and coverage."""

    def __init__(self, langs: list[str], rows: list[tuple[int, int, float]]):
        """rows: (gram, language index, the gram's share of the language's n-grams)."""
        self.langs = langs
        self.words = max(1, -(-len(langs) // 64))
        self.slots = np.zeros((1 << SLOT_BITS, self.words), np.uint64)
        self.cover = np.zeros(len(langs))
        by: dict[int, list[int]] = {}
        for g, k, share in rows:
            by.setdefault(k, []).append(g)
            self.cover[k] += share
        self.false = np.zeros(len(langs))
        for k, gs in by.items():
            h = np.array(gs, np.int64).view(np.uint64)
            for at in self._probes(h):
                self.slots[at, k // 64] |= np.uint64(1 << (k % 64))
            full = ((self.slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
            self.false[k] = full**PROBES

    @staticmethod
    def _probes(h: np.ndarray):
        for i in range(PROBES):
            yield ((h >> np.uint64(i * 21)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def counts(self, h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts [text, language] and the n-grams of each text."""
        total = np.bincount(owner, minlength=texts).astype(float)
        out = np.zeros((texts, len(self.langs)))
        mask = None
        for at in self._probes(h):
            mask = self.slots[at] if mask is None else mask & self.slots[at]
        for k in range(len(self.langs)):
            hit = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) if len(h) else np.empty(0)
            out[:, k] = np.bincount(owner, weights=hit.astype(float), minlength=texts)
        return (out - total[:, None] * self.false) / (1 - self.false), total


def train_filters(docs: DataFrame) -> Filters | None:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    train = docs.select(F.col("lang").cast("string").alias("lang"), "text", crc.alias("crc")).filter(F.col("lang").isNotNull() & F.col("crc").isNotNull() & (F.col("crc") % HELD_OUT_MOD != HELD_OUT_REST)).select("lang", "text")
    counted = written(gram_counts(train), "lang-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    top = (
        rated.join(best, "gram")
        .filter(F.col("rate") >= RATE_SHARE * F.col("best"))
        .withColumn("b", F.pmod(F.xxhash64("gram"), F.lit(shuffle_width(docs.sparkSession))).cast("int"))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang", "b").orderBy(F.desc("n"), "gram")))
        .filter(F.col("k") <= TOP_GRAMS)  # of each bucket first: a language is no single task's work
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .filter(F.col("k") <= TOP_GRAMS)
        .select("lang", "gram", "rate")
    )
    rows = top.collect()  # at most TOP_GRAMS a language
    langs = sorted({r["lang"] for r in rows})
    index = {x: i for i, x in enumerate(langs)}
    return Filters(langs, [(r["gram"], index[r["lang"]], r["rate"]) for r in rows]) if rows else None


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts = np.zeros((len(texts), len(filters.langs) if filters else 0))
        total = np.zeros(len(texts))
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        for at, part, lead, cut in _parts(texts):
            h, owner = grams(part, lead=lead, cut=cut)
            if filters is not None:
                c, n = filters.counts(h, owner, len(part))
                np.add.at(counts, at, c)
            else:
                n = np.bincount(owner, minlength=len(part)).astype(float)
            np.add.at(total, at, n)
        if filters is None:
            return ["und"] * len(texts), [0.0] * len(texts)
        share = np.clip(counts, 0, None) / np.maximum(filters.cover, 1e-9) / np.maximum(total, 1)[:, None]
        best = share.argmax(1)
        # log-odds against the mean of the n-grams' evidence: sharpened shares
        power = np.minimum(np.maximum(total, 1), 60)[:, None] / 4
        w = np.exp(power * (share - share.max(1, keepdims=True)))
        score = w[np.arange(len(texts)), best] / w.sum(1)
        return [filters.langs[b] if t else "und" for b, t in zip(best, lettered)], [float(s) if t else 0.0 for s, t in zip(score, lettered)]

    def run(batches):
        for b in batches:
            lang, score = predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = F.coalesce(crc % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per input row.

    ``und`` (score 0) for null texts, texts without a letter, and all texts if
    nothing can be learned.  Rows with a null id are predicted, not learned
    from.  Repeated rows get equal predictions; ties, and
    letters too few for an n-gram, go to the first language by name; an empty table gives no rows; other columns are not read.
    """
    return identify(docs, train_filters(docs))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))
