"""BPE encoding and decoding with a public vocabulary, exactly as the tokenizers library does it for whole texts.

Texts of more than LONG bytes are encoded by tree concatenation, with a byte-level vocabulary: they are cut in halves,
wherever these fall, down to leaves of at most LEAF bytes; all leaves are encoded side by side; and around each join a
window of tokens is encoded again, twice as wide each time, until it agrees with both sides exactly. It does on a side if
it reaches that side's end; or if its outermost tokens are that side's own up to a place at which every text splits
(white space behind something else); or if they are in letters alone, in digits alone or in signs alone, where the
splitting has no place and merges are all: a sequence of tokens is the encoding of its text if each pair of neighbours
is that of theirs, and then each pair comes from one encoding.

Leaves and short texts fall into units that the vocabulary's own splitting never joins (a run of white space with the
word behind it, or a word alone where white space is dropped); each distinct unit of a few megabytes is encoded once.

Defined results: a null text is empty; the empty text has no ids; strings of special tokens become their ids, as in the
library; invalid bytes decode to replacement characters, as in the library. A vocabulary that drops white space or
changes letters (by_word) has no bytes to go back to: its texts are never cut but between words.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import arrow_schema, column, pieces, ship, spread, utf8, word_hashes, words, working_for

#: Bytes of a leaf of the tree, tokens of the first window on each side, and bytes from which a text takes the tree.
LEAF, WINDOW, LONG = 16384, 16, 32768
#: Tokens of one kind of character on which a window and a side must agree.
AGREE = 4
#: Units that an encoder remembers, pieces that it remembers, bytes of a unit that is known by its hash, new units merged at once.
UNITS, PIECES, SHORT, MERGED = 1_500_000, 150_000, 64, 1 << 17
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20

#: Letters of Latin-1, and texts of printable ASCII and these letters behind white space. For such texts
#: the patterns below cut as the vocabularies' own patterns do; all other texts go through the library's splitting.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(rf"[ \t\n\x0b\x0c\r]*[\x21-\x7e{_LETTERS}]*")
_WITH_BLANKS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_BY_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Characters after which white space is always a place to split, and runs that the splitting leaves whole.
_SPLIT = re.compile(r"[\x21-\x7e](?=[ \t\n\x0b\x0c\r])")
_ALIKE = re.compile(r"[A-Za-z]+|[0-9]+|[\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


class Tree:
    """Tree concatenation for one byte-level vocabulary: encodings of a text's parts become the encoding of the whole.

    whole: encodes a string in one pass. decoder: the bytes of ids. windows: how many were encoded, for tests.
    """

    def __init__(self, whole: Callable[[str], list[int]], decoder: Decoder) -> None:
        self.whole, self.decoder, self.windows = whole, decoder, 0

    def _bytes(self, ids: np.ndarray) -> bytes:
        size = self.decoder.size[ids]
        return self.decoder.data[spread(self.decoder.start[ids], size)].tobytes()

    def _agrees(self, window: np.ndarray, side: np.ndarray, back: bool) -> bool:
        """Whether the window's first tokens (last ones, if back) are the side's as far as they must be."""
        n = min(len(window), len(side))
        step = slice(None, None, -1) if back else slice(None)
        same = int(np.argmin(np.append(window[step][:n] == side[step][:n], False)))
        if not same:
            return False
        own = self._bytes(window[len(window) - same :] if back else window[:same])
        text = own.decode(errors="replace")
        if _SPLIT.search(text):
            return True
        return same >= AGREE and _ALIKE.fullmatch(text) is not None

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of a text from those of its two parts."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        wide = WINDOW
        while True:
            a, b = max(0, len(left) - wide), min(len(right), wide)
            # a window begins and ends with whole characters
            while a and self.decoder.inside[left[a]]:
                a -= 1
            while b < len(right) and self.decoder.inside[right[b]]:
                b += 1
            window = np.array(self.whole(self._bytes(np.concatenate([left[a:], right[:b]])).decode()), left.dtype)
            self.windows += 1
            if (a == 0 or self._agrees(window, left[a:], False)) and (b == len(right) or self._agrees(window, right[:b], True)):
                return np.concatenate([left[:a], window, right[b:]])
            wide *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def halves(data: np.ndarray, begin: int, end: int) -> list[int]:
    """Where the leaves of a text begin: halves of halves, down to LEAF bytes, cut between characters."""
    if end - begin <= LEAF:
        return [begin]
    middle = (begin + end) // 2
    while middle > begin and data[middle] & 0xC0 == 0x80:
        middle -= 1
    return [begin] if middle == begin else halves(data, begin, middle) + halves(data, middle, end)


class Encoder:
    """Ids of many texts. by_word: the vocabulary drops white space, so words are units; else a unit is a word with the white space before it.

    Units are cut and told apart by array operations over the bytes of many texts at once (a unit of up to SHORT bytes is
    known by a 64-bit hash and its length); each distinct one is split and encoded once, and its ids are kept.
    """

    def __init__(self, path: str, by_word: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.by_word = Tokenizer.from_file(path), by_word
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(re.escape(t).encode().decode() for t in self.special).encode()) if self.special else None
        letters = {b: c for c, b in byte_letters().items()}
        self.as_bytes = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(256)}
        self.tree = None if by_word else Tree(lambda text: self.tok.encode(text, add_special_tokens=False).ids, Decoder(path))
        self.clear()

    def clear(self) -> None:
        # hashes in order with the units' numbers, most in one pair of arrays, new ones in another that is merged now and then
        self.old, self.new = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.count = 0
        self.width, self.start, self.size = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, text: str) -> list[int]:
        """Ids of what the vocabulary's splitting leaves whole, by its merges alone."""
        out = self.pieces.get(text)
        if out is None:
            if len(self.pieces) >= PIECES:
                self.pieces = {}
            out = self.pieces[text] = [t.id for t in self.model.tokenize(text.translate(self.as_bytes))]
        return out

    def _unit(self, raw: bytes) -> list[int]:
        text = raw.decode()
        if self.special and "<" in text and any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        parts = _BY_WORD.findall(text.lower()) if self.by_word else _WITH_BLANKS.findall(text)
        if len(parts) == 1:
            return self._piece(parts[0])
        return [i for p in parts for i in self._piece(p)]

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units of all texts, and the text of each."""
        if self.by_word:
            return words(data, at)
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        begin = np.zeros(len(data), bool)
        begin[1:] = blank[1:] & ~blank[:-1]
        odd = _odd_places(data)
        if self.has_special:
            odd = np.concatenate([odd, np.array([m.start() for m in self.has_special.finditer(data.tobytes())], np.int64)])
        for row in np.unique(np.searchsorted(at, odd, "right") - 1):
            begin[at[row] : at[row + 1]] = False
        begin[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(at, starts, "right") - 1

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The units' numbers, -1 for those that aren't known."""
        out = np.full(len(key), -1, np.int64)
        for known, number in (self.old, self.new):
            if len(known):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                out[hit] = number[place[hit]]
        return out

    def _keep(self, key: np.ndarray, width: np.ndarray, ids: list[list[int]]) -> None:
        """key rises and holds nothing known."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(size.sum()), self.count + len(ids)
        if len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used // 2 + 2 * total, np.uint32)])
        if len(self.start) < n:
            more = np.zeros(n // 2 + len(ids), np.int64)
            self.width, self.start, self.size = (np.concatenate([x[: self.count], more]) for x in (self.width, self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.width[self.count : n], self.size[self.count : n] = width, size
        self.start[self.count : n] = self.used + np.cumsum(size) - size
        self.new = self._merged(self.new, (key, np.arange(self.count, n, dtype=np.int32)))
        self.used, self.count = self.used + total, n
        if len(self.new[0]) > MERGED:
            self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(a[0], b[0])
        return np.insert(a[0], place, b[0]), np.insert(a[1], place, b[1])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (their bytes, and where each begins and ends), one after the other, and where each text's begin and end."""
        size = np.diff(at)
        if self.by_word or not (size > LONG).any():
            return self._encode(data, at)
        leaves = [halves(data, int(a), int(b)) if b - a > LONG else [int(a)] for a, b in zip(at[:-1], at[1:], strict=True)]
        ids, ends = self._encode(data, np.array([c for x in leaves for c in x] + [int(at[-1])]))
        parts, n = [], 0
        for x in leaves:
            own = [ids[a:b] for a, b in zip(ends[n : n + len(x)], ends[n + 1 : n + len(x) + 1], strict=True)]
            parts.append(self.tree.concatenate(own))
            n += len(x)
        return np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])])

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, row = self.units(data, at)
        texts = len(at) - 1
        if self.count > UNITS:
            self.clear()
        raw = data.tobytes()
        width = ends - starts
        short = width <= SHORT
        key, first, unit = np.unique(word_hashes(data, starts[short], ends[short]), return_index=True, return_inverse=True)
        first = np.flatnonzero(short)[first]
        number = self._find(key)
        new = np.flatnonzero(number < 0)
        if len(new):
            before = self.count
            self._keep(key[new], width[first[new]], [self._unit(raw[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            number[new] = np.arange(before, self.count)
        own, each = np.flatnonzero(short), number[unit.reshape(-1)]
        start, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        start[own], size[own] = self.start[each], self.size[each]
        flat = self.flat[: self.used]
        # long units, and any whose length is not that of the unit with its hash
        alone = np.concatenate([np.flatnonzero(~short), own[self.width[each] != width[own]]])
        extra, used = [], len(flat)
        for i in alone.tolist():
            ids = self._unit(raw[starts[i] : ends[i]])
            extra.append(np.array(ids, np.uint32))
            start[i], size[i] = used, len(ids)
            used += len(ids)
        if extra:
            flat = np.concatenate([flat, *extra])
        per_text = np.bincount(row, size, minlength=texts).astype(np.int64) if len(row) else np.zeros(texts, np.int64)
        return flat[spread(start, size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Bytes at which white space beyond ASCII begins, or controls that some count as white space."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        after = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = after[lead], after[lead + 1], after[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        other = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        found.append(lead[two | general | other])
    return np.concatenate(found)


class Decoder:
    """Texts of ids of a byte-level vocabulary, as UTF-8."""

    def __init__(self, path: str) -> None:
        saved = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        tokens = {i: bytes(letters[c] for c in t) for t, i in saved["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in saved["added_tokens"]}
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.data = np.frombuffer(b"".join(every), np.uint8)
        self.size = np.array([len(t) for t in every], np.int64)
        self.start = np.cumsum(self.size) - self.size
        #: Tokens that begin inside a character.
        self.inside = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in every])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        sizes = self.size[ids]
        data = self.data[spread(self.start[ids], sizes)].tobytes()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[at]
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            text = data[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode(errors="replace").encode()
            out.append(text)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, by_word: bool) -> Encoder:
    return Encoder(path, by_word)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, by_word: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    ship(docs.sparkSession)
    schema = arrow_schema("doc_id long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("bpe", encoder.cache_clear, decoder.cache_clear)
        for batch in pieces(batches, "text", TOGETHER):
            ids, at = encoder(path, by_word).encode(*utf8(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)), type=schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of encode(); a null list is empty."""
    ship(tokens.sparkSession)
    schema = arrow_schema("doc_id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in column(batch, "ids").to_pylist()]
            at = np.cumsum([0, *map(len, lists)])
            ids = np.fromiter((i for x in lists for i in x), np.int64, int(at[-1]))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([t.decode() for t in decoder(path).decode(ids, at)])], schema=schema)

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Of each row, the number of ids, and digests of the ids and of the text decoded from them.

    with_ids: the ids too, as little-endian unsigned integers of two bytes, or of four for vocabularies beyond 65,536 ids:
    as lists of integers they would take many times the memory on their way to a file.
    """
    ship(docs.sparkSession)
    form = _DIGEST + ", ids binary" * with_ids
    schema = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("bpe", encoder.cache_clear, decoder.cache_clear)
        for batch in pieces(batches, "text", TOGETHER):
            ids, at = encoder(path, False).encode(*utf8(column(batch, "text")))
            raw = ids.astype("<u4").tobytes()
            hashed = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            decoded = [hashlib.sha256(t).hexdigest() for t in decoder(path).decode(ids, at)]
            cols = [column(batch, "doc_id"), pa.array(np.diff(at)), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                wide = 2 if len(decoder(path).size) <= 1 << 16 else 4
                thin = ids.astype(f"<u{wide}").tobytes()
                cols.append(pa.array([thin[wide * a : wide * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, form)
