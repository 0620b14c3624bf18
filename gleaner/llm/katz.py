"""Language-model scores by Katz backoff of any order: Good-Turing discounts, exactly normalised backoff weights.

p(w | h) = d(c(hw)) c(hw) / c(h) if hw was seen, else alpha(h) p(w | h'), h' being h without its first word; at the end of
the recursion p(w) = d(c(w)) c(w) / N, and what its discounts leave is the probability of a word never seen. alpha(h) is
what the discounts leave of h's mass, over the mass p(. | h') gives to the words not seen after h, so each context's
probabilities add up to one. Each order has its own discounts. A text begins with a start, which is only a context, and
ends with an end, which is only a word; its first words have no more words before them than there are.

Counts never become a row for each token. Texts are taken in chunks of CHUNK bytes; a chunk asks, in one packed list for
each bucket of words, for the ids and counts of its distinct words, and then, order by order, in one for each bucket of
contexts, for the counts of its distinct grams. A bucket adds up what the chunks' training texts bring and answers each
chunk in the order it asked: counts, ids (a gram's id names it as a context of the next order; the last order has none), and,
where the chunk backs off, what the context's weight is computed from. The tables of words (by bucket of the word) and of
grams (by bucket of the context) are the model. A context with more than a bucket's share of all tokens is dealt over all
buckets by the next word, and its sums are added up from them.

A chunk's tokens, the ids and counts of its words, and what it was told at each order but the last lie in files of the shared
folder, under names of their task's own, so that they aren't shuffled again; rows name the files of the tasks whose output is
read. Hashes of words go once words have ids, and a table's answers once they lie in the chunks' files.

Defined results: a null text is empty and scores its end alone; a null doc_id counts as the empty text in the choice of
training rows; without training rows every probability is 1; contexts never seen in training back off with weight 1;
where Good-Turing estimates don't exist (a count of counts is 0, a discount outside (0, 1]) fewer counts are discounted,
or, if none can be, half a count is taken off each; a context that no discount leaves mass gets one count more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.language_id import fold
from gleaner.llm.shared import arrow_schema, column, drop, materialise, mixed, pack, partitions, pieces, scratch, ship, unpack, utf8, word_hashes, words

#: Bytes of text of a chunk, counts that are discounted, entries of a bucket, about.
CHUNK, K, WORD_BUCKET, GRAM_BUCKET = 4 << 20, 5, 2_000_000, 1_000_000
#: Words of the longest gram.
ORDER = 3
#: Ids: 0 for a word that training never saw, 1 for the start; the end is a word like others, named by this hash.
UNKNOWN, START = 0, 1
END_HASH = 0xE0D0E0D0E0D0E0D1
_REPEATED = 64  # no first byte of pack()


@dataclass(frozen=True)
class Discounts:
    """d[r] for a count r (d[0] unused, d[K + 1] for all larger counts), from counts of counts n[r], r from 1 to K + 1."""

    d: tuple[float, ...]

    @classmethod
    def good_turing(cls, n: list[int]) -> Discounts:
        for k in range(K, 0, -1):
            if all(n[r] for r in range(1, k + 2)):
                top = (k + 1) * n[k + 1] / n[1]
                if top < 1:
                    d = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, k + 1)]
                    if all(0 < x <= 1 for x in d) and min(d) < 1:
                        return cls((0.0, *d, *[1.0] * (K + 1 - k)))
        return cls((0.0, *[(r - 0.5) / r for r in range(1, K + 1)], 1.0))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.array(self.d)[np.minimum(counts, K + 1).astype(np.int64)]


@dataclass(frozen=True)
class Words:
    """N, V and the unigram model."""

    n: int
    v: int
    discounts: Discounts
    unknown: float
    scale: float

    @classmethod
    def of(cls, n: int, v: int, counts: list[int]) -> Words:
        d = Discounts.good_turing(counts)
        left = sum((1 - d.d[r]) * r * counts[r] for r in range(1, K + 1)) / n if n else 1.0
        return cls(n, v, d, left, 1.0) if left > 0 else cls(n, v, Discounts((0.0, *[1.0] * (K + 1))), 1 / (n + 1), n / (n + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        """Of words by their counts; 0 is a word never seen."""
        seen = self.scale * self.discounts.of(counts) * counts / max(1, self.n)
        return np.where(counts > 0, seen, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))


def pack_repeated(x: np.ndarray) -> bytes:
    """Integers that repeat: their distinct values and each one's place among these, if that is shorter than pack()."""
    values, at = np.unique(x, return_inverse=True)
    head = pack(values, True)
    return min(pack(x), bytes([_REPEATED]) + len(head).to_bytes(8, "little") + head + pack(at.reshape(-1)), key=len)


def unpack_repeated(b: bytes) -> np.ndarray:
    if b[0] != _REPEATED:
        return unpack(b)
    end = 9 + int.from_bytes(b[1:9], "little")
    return unpack(b[9:end])[unpack(b[end:]).astype(np.int64)]


def _delete(folder: str, names: list[str], spark) -> None:
    """Files that no later job reads, once the table that was made from them is written."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)


def _store(folder: str, row: dict, kind: str = "chunk") -> str:
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    path = f"{root}/{kind}/{uuid.uuid4().hex}"
    fs.create_dir(f"{root}/{kind}")
    with fs.open_output_stream(path) as f:
        pq.write_table(pa.Table.from_pylist([row]), f, compression="none", write_statistics=False)
    return path


def _load(folder: str, path: str) -> dict:
    from pyarrow.fs import FileSystem

    fs, _ = FileSystem.from_uri(folder)
    with fs.open_input_file(path) as f:
        return pq.read_table(f).to_pylist()[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK bytes of text: small ones put together, large ones cut."""
    held, size = [], 0
    for piece in pieces(batches, "text", CHUNK):
        n = piece.get_total_buffer_size() if len(held) > 64 else len(utf8(column(piece, "text"))[0])
        if held and size + n > CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += n
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end behind each text's words, and the number of each text's tokens."""
    data, at = utf8(column(batch, "text"))
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends, row = words(data, at)
    h = word_hashes(data, starts, ends)
    n = np.bincount(row, minlength=batch.num_rows) + 1
    out = np.full(int(n.sum()), END_HASH, np.uint64)
    body = np.ones(len(out), bool)
    body[np.cumsum(n) - 1] = False
    out[body] = h
    return out, n


def _bucketed(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(key, 21) % np.uint64(buckets)).astype(np.int64)


def _asked_words(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk asks for its words, by bucket and hash, and where each bucket's begin and end."""
    bucket = _bucketed(hashes, buckets)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_CHUNKS = "chunk long, path string, words long, tokens long, texts long"


def _read_chunks(folder: str):
    schema = arrow_schema(_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, batch in enumerate(_chunks(batches)):
            h, sizes = tokens(batch)
            held = column(batch, "held_out").to_numpy(zero_copy_only=False).astype(bool)
            own, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
            number = np.empty(len(own), np.int64)
            number[rank] = np.arange(len(own))
            token = number[inverse.reshape(-1)]
            train = np.bincount(token[np.repeat(~held, sizes)], minlength=len(own))
            ids = column(batch, "doc_id")
            row = {"tokens": pack(token), "sizes": pack(sizes), "held": np.packbits(held).tobytes(), "known": np.packbits(np.array(ids.is_valid())).tobytes(), "ids": np.array(ids.fill_null(0)).astype("<i8").tobytes()}
            yield pa.RecordBatch.from_pylist([{"chunk": part << 32 | n, "path": _store(folder, row) + "\n" + _store(folder, {"hashes": pack(own[rank]), "train": pack(train)}, "asked"), "words": len(own), "tokens": len(h), "texts": int((~held).sum())}], schema=schema)

    return run


_WORD_ASK = "bucket int, chunk long, hashes binary, train binary"


def _ask_words(folder: str, buckets: int):
    schema = arrow_schema(_WORD_ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, path in zip(column(batch, "chunk").to_pylist(), column(batch, "path").to_pylist(), strict=True):
                row = _load(folder, path.split("\n")[1])
                hashes, train = unpack(row["hashes"]), unpack(row["train"])
                order, at = _asked_words(hashes, buckets)
                out = [{"bucket": b, "chunk": chunk, "hashes": pack(hashes[order[i:j]], True), "train": pack(train[order[i:j]])} for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_WORD_TOLD = "bucket int, chunk long, ids binary, counts binary, n long, v long, of_counts array<long>"


def _count_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c[c > 0], K + 2).astype(np.int64), minlength=K + 3)[: K + 2].tolist()


def _tell_words(buckets: int):
    """A bucket's answers; the row with chunk -1 is its part of the table of words."""
    schema = arrow_schema(_WORD_TOLD)

    def run(table: pa.Table) -> pa.Table:
        bucket = column(table, "bucket")[0].as_py()
        asked = [unpack(b) for b in column(table, "hashes").to_pylist()]
        train = np.concatenate([unpack(b) for b in column(table, "train").to_pylist()])
        every, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse.reshape(-1), train, minlength=len(every)).astype(np.int64)
        rank = np.empty(len(every), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(every))  # frequent words get small ids, which pack well
        ids = np.where(total > 0, 2 + rank * buckets + bucket, UNKNOWN)
        if len(every) and int(ids.max()) >= 1 << 32:
            raise ValueError("more than 2^32 words")
        out = [{"bucket": bucket, "chunk": -1, "ids": pack(ids), "counts": pack(total), "n": int(total.sum()), "v": int((total > 0).sum()), "of_counts": _count_of_counts(total)}]
        at = np.cumsum([0, *map(len, asked)])
        for chunk, a, b in zip(column(table, "chunk").to_pylist(), at[:-1], at[1:], strict=True):
            own = inverse.reshape(-1)[a:b]
            out.append({"bucket": bucket, "chunk": chunk, "ids": pack(ids[own]), "counts": pack(total[own])})
        return pa.Table.from_pylist(out, schema=schema)

    return run


@dataclass(frozen=True)
class Level:
    """An order above one: its contexts that are dealt over all buckets with their sums, and its discounts."""

    order: int
    buckets: int
    hot: np.ndarray
    d: Discounts | None = None
    hot_low: np.ndarray | None = None
    hot_mass: np.ndarray | None = None


@dataclass
class Tokens:
    """A chunk's tokens at an order: ids and counts of the grams that end there, and what counts are divided by."""

    first: np.ndarray  # positions where texts begin
    train: np.ndarray
    word: np.ndarray
    id: np.ndarray  # 0: never seen in training
    count: np.ndarray
    over: np.ndarray  # the context's count, and one more where no discount leaves it mass


@dataclass
class Grams:
    """A chunk's distinct contexts of an order, and its distinct grams by context and word (0: a word never seen)."""

    gram: np.ndarray  # of each token: its gram's number, -1 if the context is unknown
    context: np.ndarray  # of each token: its context's number, -1 if unknown
    contexts: np.ndarray  # ids
    context_count: np.ndarray
    lower_over: np.ndarray  # of each context: what the counts of the order below are divided by
    owner: np.ndarray  # of each gram: its context's number
    word: np.ndarray
    lower_count: np.ndarray  # of each gram: the count of the gram without its first word
    train: np.ndarray
    bucket: np.ndarray


@dataclass
class Found:
    """What the buckets say of a chunk's grams and contexts."""

    total: np.ndarray
    id: np.ndarray
    none: np.ndarray  # of each context: no discount leaves it mass
    alpha: np.ndarray  # of each context: its backoff weight, if the chunk needs it


def _named(folder: str, path: str, told: list[dict], buckets: int) -> str:
    """Store the ids and counts of a chunk's words beside its tokens; the path of both."""
    path, asked = path.split("\n")
    hashes = unpack(_load(folder, asked)["hashes"])
    order, at = _asked_words(hashes, buckets)
    ids, counts = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64)
    for t in told:
        own = order[at[t["bucket"]] : at[t["bucket"] + 1]]
        ids[own], counts[own] = unpack(t["ids"]), unpack(t["counts"])
    return path + "\n" + _store(folder, {"ids": pack(ids), "counts": pack(counts)})


def _words_of(row: dict, names: dict, model: Words) -> Tokens:
    token, sizes = unpack(row["tokens"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
    held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(sizes)).astype(bool)
    word = unpack(names["ids"])[token]
    return Tokens(np.cumsum(sizes) - sizes, np.repeat(~held, sizes), word, word, unpack(names["counts"]).astype(np.int64)[token], np.full(len(word), model.n + (model.scale < 1)))


def _grams(t: Tokens, level: Level, starts: int) -> Grams:
    before, before_count = np.roll(t.id, 1), np.roll(t.count, 1)
    before[t.first], before_count[t.first] = (START, starts) if level.order == 2 else (0, 0)
    known = np.flatnonzero((before != 0) & (before_count > 0))
    contexts, at, of = np.unique(before[known], return_index=True, return_inverse=True)
    of = of.reshape(-1)
    keys, first, inverse = np.unique(of.astype(np.uint64) << np.uint64(32) | t.word[known], return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    gram, context = np.full(len(t.word), -1), np.full(len(t.word), -1)
    gram[known], context[known] = inverse, of
    owner, word = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
    by, is_hot = contexts[owner], np.isin(contexts, level.hot)[owner]
    by[is_hot] = mixed(by[is_hot], 22) ^ word[is_hot]
    train = np.bincount(inverse, t.train[known], minlength=len(keys)).astype(np.int64)
    return Grams(gram, context, contexts, before_count[known][at], t.over[known][at], owner, word, t.count[known][first], train, _bucketed(by, level.buckets))


def _asked(g: Grams, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What a chunk asks of each bucket: numbers of grams, of their contexts, and how many grams each context has there."""
    order = np.argsort(g.bucket.astype(np.uint16) if buckets <= 1 << 16 else g.bucket, kind="stable")
    at = np.searchsorted(g.bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        own = order[at[b] : at[b + 1]]
        if len(own):
            owner = g.owner[own]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            yield b, own, owner[starts], np.diff(starts, append=len(own))


def _needy(total: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of contexts with their numbers of grams: which have a gram without counts, so that their weight is needed."""
    return np.flatnonzero(np.add.reduceat(total == 0, np.cumsum(lengths) - lengths)) if len(lengths) else np.zeros(0, np.int64)


_ASK = "bucket int, chunk long, path string, contexts binary, lengths binary, words binary, train binary, counts binary"


@dataclass(frozen=True)
class _Replay:
    """A chunk's tokens at all orders so far, from its files and, if that isn't in one, what the last order's buckets told."""

    folder: str
    model: Words
    starts: int
    levels: tuple[Level, ...]

    def of(self, path: str, *last: list[dict]) -> tuple[dict, list[tuple[Tokens, Grams | None, Found | None]]]:
        row, names, *files = (_load(self.folder, p) for p in path.split("\n"))
        out = [(_words_of(row, names, self.model), None, None)]
        for level, told in zip(self.levels, [*(f["told"] for f in files), *last], strict=True):
            t = out[-1][0]
            g = _grams(t, level, self.starts)
            f = _found(g, told, level)
            ok, known = g.gram >= 0, g.context >= 0
            ids, count, over = np.zeros(len(ok), np.uint64), np.zeros(len(ok), np.int64), np.ones(len(ok), np.int64)
            ids[ok], count[ok] = f.id[g.gram[ok]], f.total[g.gram[ok]]
            over[known] = (g.context_count + f.none)[g.context[known]]
            out.append((Tokens(t.first, t.train, t.word, ids, count, over), g, f))
        return row, out


def _ask(replay: _Replay, level: Level, word_buckets: int):
    schema = arrow_schema(_ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                path = _named(replay.folder, r["path"], r["told"], word_buckets) if level.order == 2 else r["path"]
                g = _grams(replay.of(path)[1][-1][0], level, replay.starts)
                out = []
                for b, own, contexts, lengths in _asked(g, level.buckets):
                    out.append({"bucket": b, "chunk": r["chunk"], "path": path, "contexts": pack(g.contexts[contexts], True), "lengths": pack(lengths), "words": pack_repeated(g.word[own]), "train": pack(g.train[own]), "counts": pack_repeated(g.lower_count[own])})
                none = pack(np.zeros(0))
                yield pa.RecordBatch.from_pylist(out or [{"bucket": 0, "chunk": r["chunk"], "path": path, **dict.fromkeys(("contexts", "lengths", "words", "train", "counts"), none)}], schema=schema)

    return run


_TOLD = ("totals", "ranks", "present", "low", "mass")
_TELL = "bucket int, chunk long, path string, totals binary, ranks binary, present binary, low binary, mass binary, of_counts array<long>, hot binary, hot_low binary, hot_mass binary, table_contexts binary, table_lengths binary, table_words binary, table_counts binary"


def _tell(level: Level, lower: Discounts, keep: bool, last: bool):
    """A bucket's answers: counts and, but for the last order, ranks of grams; of contexts which counts from 1 to K occur, and,
    where a gram has none, how many grams have each of them and the discounted counts of the words seen in the order below
    (the chunk knows what these are divided by).

    The row with chunk -1 has the bucket's counts of counts, its parts of the sums of hot contexts, and its grams.
    """
    schema = arrow_schema(_TELL)

    def run(table: pa.Table) -> pa.Table:
        bucket = column(table, "bucket")[0].as_py()
        each = {c: [unpack(b) for b in column(table, c).to_pylist()] for c in ("contexts", "lengths")}
        whole = lambda c: np.concatenate([unpack_repeated(b) for b in column(table, c).to_pylist()])
        lengths = np.concatenate(each["lengths"]).astype(np.int64)
        contexts, of = np.unique(np.concatenate(each["contexts"]), return_inverse=True)
        of = of.reshape(-1)
        every, first, inverse = np.unique(np.repeat(of, lengths).astype(np.uint64) << np.uint64(32) | whole("words"), return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        total = np.bincount(inverse, whole("train"), minlength=len(every)).astype(np.int64)
        owner, seen = (every >> np.uint64(32)).astype(np.int64), total > 0
        count = whole("counts")[first].astype(np.int64)
        # a gram that was seen was seen without its first word, too: no recursion here
        part_of_mass = np.where(seen, lower.of(count) * count, 0.0)
        low, mass = np.zeros((K, len(contexts)), np.int64), np.zeros(len(contexts))
        if len(contexts):
            start = np.searchsorted(owner, np.arange(len(contexts)))
            for r in range(1, K + 1):
                low[r - 1] = np.add.reduceat((total == r).astype(np.int64), start)
            mass = np.add.reduceat(part_of_mass, start)
        present = sum((low[r] > 0).astype(np.int64) << r for r in range(K))
        rank = np.maximum(np.cumsum(seen) - 1, 0)
        part = np.flatnonzero(np.isin(contexts, level.hot))
        out = [{"bucket": bucket, "chunk": -1, "of_counts": _count_of_counts(total), "hot": pack(contexts[part]), "hot_low": pack(low[:, part].reshape(-1)), "hot_mass": mass[part].astype("<f8").tobytes(), "table_counts": pack(total[seen])}]
        if keep:
            names, n = np.unique(owner[seen], return_counts=True)
            out[0] |= {"table_contexts": pack(contexts[names], True), "table_lengths": pack(n), "table_words": pack_repeated(every[seen] & np.uint64(0xFFFFFFFF))}
        grams, places = np.cumsum([0, *(int(n.sum()) for n in each["lengths"])]), np.cumsum([0, *map(len, each["contexts"])])
        for i, (chunk, path) in enumerate(zip(column(table, "chunk").to_pylist(), column(table, "path").to_pylist(), strict=True)):
            own, at = inverse[grams[i] : grams[i + 1]], of[places[i] : places[i + 1]]
            need = at[_needy(total[own], lengths[places[i] : places[i + 1]])]
            out.append({"bucket": bucket, "chunk": chunk, "path": path, "totals": pack(total[own]), "ranks": None if last else pack(rank[own], True), "present": pack(present[at]), "low": pack(low[:, need].reshape(-1)), "mass": mass[need].astype("<f8").tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("id long, low array<long>, mass double")
    for batch in batches:
        for r in batch.to_pylist():
            ids, low, mass = unpack(r["hot"]), unpack(r["hot_low"]).reshape(K, -1), np.frombuffer(r["hot_mass"], "<f8")
            yield pa.RecordBatch.from_pylist([{"id": int(i), "low": low[:, k].tolist(), "mass": float(mass[k])} for k, i in enumerate(ids)], schema=schema)


def _gram_ids(rank: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    return rank.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)


def _found(g: Grams, told: list[dict], level: Level) -> Found:
    asked = {b: x for b, *x in _asked(g, level.buckets)}
    total, ids = np.zeros(len(g.word), np.int64), np.zeros(len(g.word), np.uint64)
    n = len(g.contexts)
    present, low, mass = np.zeros(n, np.int64), np.zeros((K, n), np.int64), np.zeros(n)
    for t in told:
        if t["bucket"] in asked:
            own, contexts, lengths = asked[t["bucket"]]
            total[own], present[contexts] = unpack(t["totals"]), unpack(t["present"])
            if t["ranks"] is not None:
                ids[own] = _gram_ids(unpack(t["ranks"]), t["bucket"], level.buckets)
            need = contexts[_needy(total[own], lengths)]
            low[:, need], mass[need] = unpack(t["low"]).reshape(K, -1), np.frombuffer(t["mass"], "<f8")
    ids[total == 0] = 0
    is_hot = np.isin(g.contexts, level.hot)
    place = np.searchsorted(level.hot, g.contexts[is_hot])
    low[:, is_hot], mass[is_hot] = level.hot_low[:, place], level.hot_mass[place]
    present[is_hot] = sum((level.hot_low[r, place] > 0).astype(np.int64) << r for r in range(K))
    return Found(total, ids, *backoff(g.context_count, present, low, mass / g.lower_over, level.d))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def backoff(count: np.ndarray, present: np.ndarray, low: np.ndarray, mass: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with their counts, which counts from 1 to K their grams have (bits), how many have each (K by contexts), and
    the p of the words seen: whether no discount leaves mass, and alpha."""
    none = (present & sum(1 << (r - 1) for r in range(1, K + 1) if d.d[r] < 1)) == 0
    left = sum((1 - d.d[r]) * r * low[r - 1] for r in range(1, K + 1)) / np.maximum(1, count)
    return none, np.where(none, 1 / (count + 1), left) / np.maximum(1e-300, 1 - mass)


def _scored(replay: _Replay):
    schema = arrow_schema(_SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row, orders = replay.of(r["path"], r["told"])
                t = orders[0][0]
                model, prob = replay.model, replay.model.p(t.count)
                for level, (own, g, f) in zip(replay.levels, orders[1:], strict=True):
                    seen = own.count > 0
                    back = (g.context >= 0) & ~seen
                    prob[back] *= f.alpha[g.context[back]]
                    prob[seen] = level.d.of(own.count[seen]) * own.count[seen] / own.over[seen]
                n = np.diff(t.first, append=len(t.word))
                held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(n)).astype(bool)
                valid = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(n)).astype(bool)
                add = lambda x: np.add.reduceat(x, t.first)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], "<i8"), mask=~valid), pa.array(held), pa.array(n), pa.array(add((t.count > 0).astype(np.int64))), pa.array(np.full(len(n), model.n)), pa.array(add(model.base(t.count))), pa.array(add(np.log10(prob)))], schema=schema)

    return run


def _by_chunk(table: DataFrame) -> DataFrame:
    """What a table of answers tells each chunk."""
    return table.filter("chunk >= 0").groupBy("chunk").agg(F.first("path").alias("path"), F.collect_list(F.struct("bucket", *_TOLD)).alias("told"))


_PATHS = "chunk long, path string"


def _kept(folder: str):
    """Store what a chunk was told beside its other files; the path of all."""
    schema = arrow_schema(_PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"chunk": r["chunk"], "path": r["path"] + "\n" + _store(folder, {"told": r["told"]})}], schema=schema)

    return run


def score(docs: DataFrame, held_out, order: int = ORDER, folder: str | None = None, keep_model: bool = True) -> DataFrame:
    """docs (doc_id, text), held_out: a Column, true for rows that don't teach. Columns as in _SCORES.

    order: words of the longest gram. keep_model: the words and the grams of each bucket (contexts, words and counts) stay in
    tables of the folder, in rows with chunk -1, that of the last order beside its answers.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    chunks = materialise(rows.mapInArrow(_read_chunks(folder), _CHUNKS), folder)
    n_words, n_tokens, n_chunks, texts = chunks.agg(F.sum("words"), F.sum("tokens"), F.count("*"), F.sum("texts")).first()
    starts = texts or 0  # training texts: occurrences of the start as a context
    least = partitions(spark)
    word_buckets = max(least, -(-(n_words or 0) // WORD_BUCKET))
    buckets = max(least, -(-(n_tokens or 0) // GRAM_BUCKET))
    tasks = max(least, min(n_chunks or 1, 4 * least))
    chunks = chunks.repartition(tasks, "chunk")

    asked = chunks.mapInArrow(_ask_words(folder, word_buckets), _WORD_ASK)
    table = materialise(asked.groupBy("bucket").applyInArrow(_tell_words(word_buckets), _WORD_TOLD), folder)
    named = table
    if keep_model:
        materialise(table.filter("chunk = -1"), folder)
    sums = table.filter("chunk = -1").agg(F.sum("n"), F.sum("v"), *(F.sum(F.col("of_counts")[r]) for r in range(1, K + 2))).first()
    model = Words.of(sums[0] or 0, sums[1] or 0, [0, *(x or 0 for x in sums[2:])])
    by_chunk = table.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ids", "counts")).alias("told"))
    told = chunks.select("chunk", "path").join(by_chunk, "chunk")
    replay = _Replay(folder, model, starts, ())
    lower, most = model.discounts, max(1, model.n // buckets)
    if order < 2:
        raise ValueError("an order of two at least")
    for m in range(2, order + 1):
        # contexts with more than a bucket's share: fewer than there are buckets
        hot = _frequent(table, most, m - 1, buckets)
        if m == 2 and starts > most:
            hot = np.union1d(hot, np.array([START], np.uint64))
        level = Level(m, buckets, hot)
        table = materialise(told.mapInArrow(_ask(replay, level, word_buckets), _ASK).groupBy("bucket").applyInArrow(_tell(level, lower, keep_model, m == order), _TELL), folder)
        told = _by_chunk(table)
        parts = table.filter("chunk = -1")
        counts = parts.agg(*(F.sum(F.col("of_counts")[r]) for r in range(1, K + 2))).first()
        lower = Discounts.good_turing([0, *(x or 0 for x in counts)])
        low, mass = np.zeros((K, len(hot)), np.int64), np.zeros(len(hot))
        summed = parts.select("hot", "hot_low", "hot_mass").mapInArrow(_hot_rows, "id long, low array<long>, mass double").groupBy("id").agg(*(F.sum(F.col("low")[r]).alias(f"n{r}") for r in range(K)), F.sum("mass").alias("mass"))
        for r in summed.collect():  # a row for each hot context: fewer than buckets
            k = int(np.searchsorted(hot, np.uint64(r["id"])))
            low[:, k], mass[k] = [r[f"n{i}"] for i in range(K)], r["mass"]
        replay = replace(replay, levels=(*replay.levels, replace(level, d=lower, hot_low=low, hot_mass=mass)))
        if m == 2:
            _delete(folder, ["asked"], spark)
            drop(named)
        spark._jvm.System.gc()  # Spark deletes the files of shuffles that nothing can read any more when the driver's JVM collects
        if m < order:
            told = materialise(told.mapInArrow(_kept(folder), _PATHS), folder).repartition(tasks, "chunk")
            parts = materialise(parts, folder)
            drop(table)
            table = parts
            spark._jvm.System.gc()
    return told.mapInArrow(_scored(replay), _SCORES)


def _frequent(table: DataFrame, most: int, order: int, buckets: int) -> np.ndarray:
    """Ids of words or grams with more than `most` occurrences in training, sorted."""
    names = ("ids", "counts") if order == 1 else ("table_counts",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("id long")
        for batch in batches:
            for bucket, *lists in zip(*(column(batch, c).to_pylist() for c in ("bucket", *names)), strict=True):
                counts = unpack(lists[-1])
                ids = unpack(lists[0]) if order == 1 else _gram_ids(np.arange(len(counts)), bucket, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(ids[counts > most].astype(np.int64))], schema=schema)

    return np.sort(np.array([r["id"] for r in table.filter("chunk = -1").select("bucket", *names).mapInArrow(run, "id long").collect()], np.uint64))


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from the rows whose fold is not 0; score all."""
    return score(docs, fold("doc_id", 10) == 0, order)
