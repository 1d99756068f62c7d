"""BPE encoding and decoding as streaming transducers.

A piece of text (a word) is encoded in one pass with bounded lookahead.  From
the merge list follows how far to the right any merge can depend on what comes:
a pair of rank i waits for its right part to be whole, which only a pair of a
lower rank that starts with a suffix of that part can prevent, and so on down
the ranks.  The longest such chain is the sufficient lookahead; a token whose
end lies that far before the end of the window is final, is emitted, and the
window moves on, so memory is constant however long the text is.  Short words
are whole windows; their tokens are kept in a bounded memo.

Decoding is a state machine over ids that emits text as soon as it is complete.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, read_table

#: Words in one generation of the memo; two generations are held.
MEMO_WORDS = 300_000
NO_PAIR = 1 << 62
#: Characters taken up at once from a long text.
SEGMENT = 500_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Transducer:
    """Encodes one piece after another by the merges of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = self.vocab
        #: left id << 20 | right id -> rank << 20 | id of the whole
        self.pairs: dict[int, int] = {}
        made: dict[int, tuple[int, int]] = {}
        length = {i: len(s) - (len(self.end) if self.end and s.endswith(self.end) and len(s) > len(self.end) else 0) for s, i in ids.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        reach_of_left: dict[int, int] = {}
        self.lookahead = 1
        for rank, (a, b) in enumerate(merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.pairs.setdefault((left << 20) | right, (rank << 20) | whole)
            made.setdefault(whole, (left, right))
            # right parts of the right part: what a pair of a lower rank may take away from it
            reach, part = 0, right
            while True:
                reach = max(reach, reach_of_left.get(part, 0))
                if part not in made:
                    break
                part = made[part][1]
            reach += length[right]
            reach_of_left[left] = max(reach_of_left.get(left, 0), reach)
            self.lookahead = max(self.lookahead, reach)
        self.longest = max(length.values())
        self.window = 2 * self.lookahead + 2 * self.longest
        self.base = [ids[c] for c in self.letters]
        self.final = [ids[c + self.end] for c in self.letters]
        self.text = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in [*ids.items(), *self.special.items()]:
            self.text[i] = s

    def _merged(self, ids: list[int]) -> list[int]:
        """All merges of a window, lowest rank first, leftmost first among equals."""
        get = self.pairs.get
        wait = [get((a << 20) | b, NO_PAIR) for a, b in zip(ids, ids[1:])]
        while wait:
            low = min(wait)
            if low == NO_PAIR:
                break
            i = wait.index(low)
            whole = low & 0xFFFFF
            ids[i : i + 2] = (whole,)
            del wait[i]
            if i:
                wait[i - 1] = get((ids[i - 1] << 20) | whole, NO_PAIR)
            if i < len(wait):
                wait[i] = get((whole << 20) | ids[i + 1], NO_PAIR)
        return ids

    def stream(self, symbols):
        """Ids of one word, from an iterator over its bytes; holds one window at most."""
        sizes: dict[int, int] = {}
        window: list[int] = []
        source = iter(symbols)
        ended = False
        while True:
            while not ended and len(window) < self.window:
                b = next(source, None)
                if b is None:
                    ended = True
                else:
                    window.append(b)
            # the word's last byte is known only once the source has ended
            if ended:
                if window:
                    yield from self._merged([self.base[b] for b in window[:-1]] + [self.final[window[-1]]])
                return
            tokens = self._merged([self.base[b] for b in window])
            done = 0
            for t in tokens:
                size = sizes.get(t) or sizes.setdefault(t, len(self.text[t]) - (len(self.end) if self.end and self.text[t].endswith(self.end) and len(self.text[t]) > len(self.end) else 0))
                if done + size > len(window) - self.lookahead:
                    break
                yield t
                done += size
            del window[:done]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= self.window:
            return self._merged([self.base[b] for b in raw[:-1]] + [self.final[raw[-1]]])
        return list(self.stream(raw))


class Decoder:
    """Ids in, text out: a token's text leaves at once, with the gap that joins it to what came before."""

    def __init__(self, text: list[str]):
        self.pieces = [x.encode() for x in text]
        self.begun = False

    def feed(self, ids: list[int]) -> bytes:
        if not ids:
            return b""
        out = b" ".join(map(self.pieces.__getitem__, ids))
        out = b" " + out if self.begun else out
        self.begun = True
        return out


#: Text for which the standard library's classes agree with the Unicode ones below.
PLAIN = re.compile(r"[\t-\r -~\xa0\xa1\xa3-\xb1\xb4-\xb8\xba\xbb\xbf-Ɂ‐-‧€]*")
FAST_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Fixed pattern of the tokenizer file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V0)


def _lower(text: str) -> str:
    return text.replace("Σ", "σ").lower()


class Encoder:
    """Whole texts to packed ids (little-endian unsigned 32-bit), piece by piece."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.transducer.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

        class Memo(dict):
            def __missing__(memo, word: str) -> bytes:
                packed = self.old.get(word)
                if packed is None:
                    packed = np.array(self.transducer.word(word), "<u4").tobytes()
                if len(word) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        self.old = dict(memo)
                        memo.clear()
                    memo[word] = packed
                return packed

        self.memo = Memo()

    def segments(self, text: str):
        """Parts that no word, composition or special token crosses, in order."""
        start, n = 0, len(text)
        while n - start > SEGMENT:
            cut = next((i for i in range(start + SEGMENT, n - 1) if text[i] in " \n" and text[i + 1].isascii()), n)
            yield text[start:cut]
            start = cut
        yield text[start:]

    def packed(self, text: str):
        """Byte strings of ids, as they become known."""
        for part in self.segments(text):
            for piece in self.splitter.split(part) if self.splitter else [part]:
                if piece in self.special:
                    yield self.special[piece]
                elif piece:
                    plain = PLAIN.fullmatch(piece) is not None
                    if not plain or not piece.isascii():
                        piece = unicodedata.normalize("NFC", piece)
                    yield b"".join(map(self.memo.__getitem__, (FAST_WORDS if plain else WORDS).findall(_lower(piece))))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per input row.

    Null and empty texts give no ids, and the digests of nothing.  Special
    tokens' strings in a text become those tokens.  Rows with a null id and
    repeated rows are encoded like others; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(path)
        count, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            decoder, n = Decoder.__new__(Decoder), 0
            decoder.pieces, decoder.begun = _pieces(encoder), False
            a, b = hashlib.sha256(), hashlib.sha256()
            for packed in encoder.packed(text or ""):
                a.update(packed)
                n += len(packed) // 4
                b.update(decoder.feed(np.frombuffer(packed, "<u4").tolist()))
            count.append(n)
            ids_sha.append(a.hexdigest())
            text_sha.append(b.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _pieces(encoder: Encoder) -> list[bytes]:
    if not hasattr(encoder, "pieces"):
        encoder.pieces = [x.encode() for x in encoder.transducer.text]
    return encoder.pieces


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
