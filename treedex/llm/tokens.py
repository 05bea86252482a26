"""Token ids of whole texts with a public tokenizer file, by distinct pieces with a bounded cache."""

from __future__ import annotations

import contextlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Pieces a worker keeps before it forgets the rarer ones, and bytes of those that are no array keys.
CACHE_PIECES, CACHE_LONG = 800_000, 16 << 20
#: Bytes of a piece that its key holds whole.
KEY = 16
#: Between chunks: white space to every tokenizer that drops white space.
IS_CHUNK = common.word_class([(0x09, 0x0D), (0x20, 0x20)])
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Classes of bytes. A LATIN letter of two bytes begins with one of these and isn't one of the pairs below, which have other forms under NFC or lower case, or are no letters.
SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)
LATIN = (0xC3, 0xC4, 0xC5)
NOT_LATIN = (0xC397, 0xC3B7, 0xC4B0, 0xC589, 0xC5BF)
_CLASS = np.full(256, FOREIGN, np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[~IS_CHUNK] = SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *LATIN]] = LETTER
_CLASS[0x30:0x3A] = DIGIT


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte; a Latin letter's bytes are letters."""
    out = _CLASS[raw]
    tail = np.flatnonzero((raw[1:] & 0xC0 == 0x80) & (raw[:-1] >= LATIN[0]) & (raw[:-1] <= LATIN[-1]))
    out[tail + 1] = LETTER
    odd = tail[np.isin(raw[tail].astype(np.int64) << 8 | raw[tail + 1], NOT_LATIN)]
    out[odd], out[odd + 1] = FOREIGN, FOREIGN
    return out


class WordEncoder:
    """The tokenizers library, called once for each distinct piece that is not in its cache.

    For a tokenizer of the form below, a text of Latin letters, ASCII digits and signs is cut into its pieces with array operations: runs of letters, single
    digits, runs of other signs, and the endings of PATTERN. A piece's key is its bytes themselves (up to KEY of them, in two words) and its length, found by
    open addressing, so that equal keys are equal pieces; longer pieces are in a dictionary. Each piece is encoded by the file's own model. A chunk between
    white space that holds anything else, or a special token's mark, is encoded whole by the library. That equals encoding whole texts, as nothing is
    joined across white space; `probe` texts and tests hold it against that. Any other tokenizer encodes whole texts.
    """

    #: The only way of cutting that block() knows; fixed by the tokenizer's file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, end_id: int = END_ID, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.end_id, self.cache_pieces = Tokenizer.from_file(path), end_id, cache_pieces
        self.model, spec = self.tok.model, json.loads(self.tok.to_str())
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_piece, self.marks = False, [x["content"].encode() for x in spec["added_tokens"]]
        self.reset()
        with contextlib.suppress(KeyError, TypeError, IndexError):
            if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != self.PATTERN:
                return
            self.by_piece = True
            probe = ["one two\nTHREE  four", "it's 12 x.,<y> z|", "é  ñandú ab-c Ÿž ÉCOLE×2", " ", "a \n\n b", "I'LL we're 'sea ''s ,'s 7's é's 'r'd'", "\x1c\t\x85q\xa0r\x0b", "ΣΑΣ Σ <|x ΐ か\u3099", "İ ſ e\u0301 \u0301a \u2028 q", "x<|endoftext|>Y <|ENDOFTEXT|>"]
            self.by_piece = all(np.array_equal(self._whole(t), self.encode([t])[0]) for t in probe)
        self.reset()

    def reset(self) -> None:
        """Piece 0 is the end of a text: its end id alone."""
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys, self.used = np.zeros((1, 2), np.uint64), np.zeros(1, np.int64)
        self.flat, self.starts, self.lens = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.long: dict[tuple[bool, bytes], int] = {}
        self.long_bytes = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[bytes], whole: list[bool]) -> int:
        """Ids of distinct new pieces, or of whole chunks, go to the tables; the number of the first."""
        first, lens, flat = len(self.lens), np.zeros(len(pieces), np.int64), []
        for i, (p, w) in enumerate(zip(pieces, whole, strict=True)):
            if w:
                ids = self._whole(p.decode()).tolist()
            else:
                t = p.decode().lower()
                ids = [x.id for x in self.model.tokenize(t if t.isascii() else self.letters.pre_tokenize_str(t)[0][0])]
            flat += ids
            lens[i] = len(ids)
        starts = np.cumsum(lens) - lens
        self.starts, self.lens = np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])
        return first

    def _slot(self, a, b):
        return (common.mix(a ^ b * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of short pieces by their keys, -1 if unknown. No piece holds a zero byte, so a key tells its length."""
        out = np.full(len(a), -1, np.int64)
        mask, slot, left = len(self.slots) - 1, self._slot(a, b), None
        while True:
            k = self.slots[slot]
            key = self.keys.take(k, axis=0)  # an empty slot's -1 is the last key, and no match
            same = (key[:, 0] == a) & (key[:, 1] == b) & (k >= 0)
            if left is None:
                np.copyto(out, k, where=same)
                left = np.flatnonzero(~same & (k >= 0))
                a, b, slot = a[left], b[left], slot[left] + 1 & mask
            else:
                out[left[same]] = k[same]
                on = ~same & (k >= 0)
                a, b, slot, left = a[on], b[on], slot[on] + 1 & mask, left[on]
            if not len(left):
                return out

    def _put(self, numbers: np.ndarray) -> None:
        """Slots for pieces that have none."""
        mask = len(self.slots) - 1
        slot = self._slot(self.keys[numbers, 0], self.keys[numbers, 1])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]  # of several for one slot the last stays
            on = self.slots[slot] != numbers
            numbers, slot = numbers[on], slot[on] + 1 & mask

    def _fill(self) -> None:
        self.slots = np.full(1 << (4 * len(self.lens)).bit_length(), -1, np.int32)
        self._put(np.flatnonzero(self.keys[:, 0] != 0))

    def _short(self, low, s, n) -> np.ndarray:
        """Numbers of pieces of at most KEY bytes."""
        word = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        a, b = word[s] & _MASK[np.minimum(n, 8)], word[s + 8] & _MASK[np.maximum(n - 8, 0)]
        number = self._find(a, b)
        new = np.flatnonzero(number < 0)
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            one = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])]
            first = self._learn([low[x : x + k].tobytes() for x, k in zip(s[one].tolist(), n[one].tolist(), strict=True)], [False] * len(one))
            self.keys = np.concatenate([self.keys, np.column_stack([a[one], b[one]])])
            if 2 * len(self.lens) > len(self.slots):
                self._fill()
            else:
                self._put(np.arange(first, len(self.lens)))
            number[new] = self._find(a[new], b[new])
        return number

    def _forget(self) -> None:
        """Keep the pieces used more than the median, at most half of them."""
        kept = np.flatnonzero(self.used > max(1, np.median(self.used)))
        kept = np.concatenate([[0], kept[(kept > 0) & (self.keys[kept, 0] != 0)]])
        lens = self.lens[kept]
        starts = np.cumsum(lens) - lens
        self.flat = self.flat[np.repeat(self.starts[kept] - starts, lens) + np.arange(int(lens.sum()))]
        self.keys, self.starts, self.lens, self.used = self.keys[kept], starts, lens, np.zeros(len(kept), np.int64)
        self.long, self.long_bytes = {}, 0
        self._fill()

    def _long(self, keys: list[tuple[bool, bytes]]) -> list[int]:
        fresh = list({k for k in keys if k not in self.long})
        if fresh:
            first = self._learn([p for _, p in fresh], [w for w, _ in fresh])
            self.keys = np.concatenate([self.keys, np.zeros((len(fresh), 2), np.uint64)])
            self.long.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.long_bytes += sum(len(p) for _, p in fresh)
        return [self.long[k] for k in keys]

    def _cut(self, raw: np.ndarray, low: np.ndarray, off: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces: start, end, and whether one is a chunk to encode whole."""
        kind = classes(raw)
        odd = [np.flatnonzero(kind == FOREIGN), *(np.array([x.start() for x in re.finditer(re.escape(m), body)], np.int64) for m in self.marks)]
        if any(map(len, odd)):
            starts, ends, _ = common.words(raw, off, IS_CHUNK)
            which = np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1)
            level = np.zeros(len(raw) + 1, np.int8)
            np.add.at(level, starts[which], 1)
            np.add.at(level, ends[which], -1)
            kind[np.cumsum(level[:-1], dtype=np.int8) > 0] = FOREIGN
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[off] = True
        at = np.flatnonzero(edge)
        of = kind[at[:-1]]
        real = of != SPACE
        starts, ends, of = at[:-1][real], at[1:][real], of[real]
        quote = np.flatnonzero((of[:-1] == OTHER) & (of[1:] == LETTER) & (ends[:-1] == starts[1:]) & (ends[:-1] - starts[:-1] == 1) & (low[starts[:-1]] == 39))
        quote = quote[~np.isin(ends[quote], off)]
        if len(quote):
            x, size = starts[quote + 1], (ends - starts)[quote + 1]
            f, g = low[x], low[x + 1]
            more = np.where(np.isin(f, [*b"stmd"]), 1, 0)
            more[(size > 1) & ((np.isin(f, [*b"rv"]) & (g == 101)) | ((f == 108) & (g == 108)))] = 2
            ends[quote] += more
            starts[quote + 1] += more
            some = ends > starts
            starts, ends, of = starts[some], ends[some], of[some]
        return starts, ends, of == FOREIGN

    def block(self, raw: np.ndarray, off: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, each with the end id behind it, and how many each has."""
        if not self.by_piece:
            body = raw.tobytes()
            found = [np.append(self._whole(body[x:y].decode()), [np.uint32(self.end_id)] * end) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.uint32), np.array([len(x) for x in found], np.int64)
        if len(self.lens) > self.cache_pieces or self.long_bytes > CACHE_LONG:
            self._forget()
        low = np.zeros(len(raw) + KEY, np.uint8)
        low[: len(raw)] = common.LOWER[raw]
        body = raw.tobytes()
        starts, ends, whole = self._cut(raw, low, off, body)
        short = (ends - starts <= KEY) & ~whole
        number = np.empty(len(starts), np.int64)
        number[short] = self._short(low, starts[short], (ends - starts)[short])
        rest = np.flatnonzero(~short)
        if len(rest):
            text = low.tobytes()
            number[rest] = self._long([(w, (body if w else text)[x:y]) for x, y, w in zip(starts[rest].tolist(), ends[rest].tolist(), whole[rest].tolist(), strict=True)])
        self.used += np.bincount(number, minlength=len(self.lens))
        first = np.searchsorted(starts, off)
        if end:
            number, first = np.insert(number, first[1:], 0), first + np.arange(len(first))
        n = self.lens[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[number] - upto[:-1], n) + np.arange(int(upto[-1]))]
        return ids, np.diff(upto[first])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without the end id."""
        raw = [t.encode() for t in texts]
        ids, n = self.block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), end=False)
        return np.split(ids, np.cumsum(n)[:-1])

    def stream(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """block(), with a text of several blocks cut at white space on the way, so that memory follows the block's size."""
        if len(off) > 2 or len(raw) <= 2 * common.BLOCK_BYTES or not self.by_piece:
            return self.block(raw, off)
        parts, at, kind = [], 0, id_type(self.tok.get_vocab_size(), self.end_id)
        while at < len(raw):
            to = at + common.BLOCK_BYTES
            while to < len(raw) and not len(gap := np.flatnonzero(~IS_CHUNK[raw[to : to + common.BLOCK_BYTES]])):
                to += common.BLOCK_BYTES
            to = min(len(raw), to + int(gap[0])) if to < len(raw) else len(raw)
            parts.append(self.block(raw[at:to], np.array([0, to - at]), end=False)[0].astype(kind))
            at = to
        ids = np.concatenate([*parts, np.array([self.end_id], kind)])
        return ids, np.array([len(ids)])


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, keep: list[str], tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """keep and `ids`: each whole text's ids and the end id, little-endian unsigned 16 bits, or 32 for a larger vocabulary; `n_tokens`.

    Null text counts as empty: the end id alone. tokenizer is a file's name or its path on the executors.
    """
    kinds = {f.name: f for f in docs.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k].dataType.simpleString()}" for k in keep) + ", ids binary, n_tokens bigint"

    def run(batches):
        enc = encoder(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer), end_id)
        kind = id_type(enc.tok.get_vocab_size(), end_id)
        for batch in batches:
            for rows, raw, off in common.text_blocks(batch.column(len(keep))):
                ids, n = enc.stream(raw, off)
                cuts = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(rows.start, len(n)) for k in range(len(keep))), data, pa.array(n)], [*keep, "ids", "n_tokens"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def id_type(vocabulary: int, end_id: int = END_ID) -> np.dtype:
    return np.dtype("<u2") if max(vocabulary, end_id + 1) <= 1 << 16 else np.dtype("<u4")


def id_bytes(tokenizer: str = TOKENIZER, end_id: int = END_ID) -> int:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)).get_vocab_size(), end_id).itemsize
