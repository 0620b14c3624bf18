"""Token ids in binary files: canonical length-limited Huffman codes from global counts, independent blocks, checkpoints.

A file: MAGIC, a header's length, the header as JSON (sizes, code lengths' limit), then its sections: code lengths of all
ids (zstd), doc ids and token counts of its documents, the bit offset of every STEP-th id (the checkpoints: each starts a
block that decodes by itself), and the codes. Files and the documents in them are in ascending doc_id order. Decoding
takes a table of 2^limit entries (id and length for each next bits) and reads all blocks of a file side by side.

A task writes each file under a name of its own and moves it into place; the table of files holds only those of tasks
that ended well, so a task that ran twice leaves nothing behind that is read.

Defined results: a null text is empty; an empty text has the end id alone; null doc_ids come first, equal doc_ids in the
order of their ids' bytes; an empty table gives no files; columns other than the id and the text play no part.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import TOGETHER, encoder
from gleaner.llm.shared import arrow_schema, column, materialise, pack, partitions, pieces, scratch, ship, unpack, utf8, working_for

MAGIC = b"TOKHUFF1"
#: Bits of a code at most (more where so many ids need it), ids of a block, ids of a file.
LIMIT, STEP, FILE_IDS = 16, 512, 2 << 20
_NONE = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `limit` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    kinds, level = [], leaves
    for _ in range(limit):
        kinds.append(None)
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1) if kinds[:-1] else np.zeros(0)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        kinds[-1] = rank < n
        level = both[rank]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(kinds):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (min(take, len(leaf)) - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: in order of length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    long = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(long[-1])
        weight = np.left_shift(1, top - long)
        codes[order] = (np.cumsum(weight) - weight) >> (top - long)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of the ids, first bit first, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(size.sum())
    out = np.zeros(total // 32 + 3, np.uint64)
    if len(ids):
        value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        place = word[first]
        out[place] += np.add.reduceat(value >> np.uint64(32), first)
        out[place + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::STEP].astype(np.uint64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    used = np.flatnonzero(lengths)
    top = int(lengths.max()) if len(used) else 1
    order = used[np.argsort(lengths[used], kind="stable")]
    times = np.left_shift(1, top - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    n = int(times.sum())
    ids[:n], size[:n] = np.repeat(order, times), np.repeat(lengths[order], times)
    return ids, size, top


def decode_bits(data: bytes, starts: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """n ids; the block at each start is decoded by itself, all side by side."""
    ids, size, top = decode_table(lengths)
    raw = np.frombuffer(data + bytes(STEP * 8), np.uint8).astype(np.uint64)
    window = np.zeros(len(raw) - 3, np.uint64)
    for i in range(4):
        window |= raw[i : len(raw) - 3 + i] << np.uint64(24 - 8 * i)
    at = starts.astype(np.int64).copy()
    most = len(window) - 1
    out = np.zeros((min(STEP, n) if n else 0, len(at)), np.uint32)
    mask, drop = (1 << top) - 1, 32 - top
    for i in range(len(out)):
        bits = (window[np.minimum(at >> 3, most)] >> (drop - (at & 7)).astype(np.uint64)).astype(np.int64) & mask
        out[i] = ids[bits]
        at += size[bits]
    return out.T.reshape(-1)[:n]


def write_file(path_or_fs, path: str, docs: list, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> int:
    bits, starts = encode_bits(ids, lengths, codes)
    known = np.array([d is not None for d in docs], bool)
    numbers = np.array([d if d is not None else 0 for d in docs], np.int64)
    sections = [zstandard.ZstdCompressor(level=3).compress(lengths.tobytes()), np.packbits(known).tobytes(), zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i8").tobytes()), pack(counts), pack(starts, True), bits]
    head = json.dumps({"docs": len(docs), "ids": len(ids), "vocabulary": len(lengths), "step": STEP, "sections": [len(s) for s in sections]}).encode()
    body = MAGIC + len(head).to_bytes(4, "little") + head + b"".join(sections)
    with path_or_fs.open_output_stream(f"{path}.part") as f:
        f.write(body)
    path_or_fs.move(f"{path}.part", path)
    return len(body)


def read_file(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, token counts, all ids."""
    if body[:8] != MAGIC:
        raise ValueError("not a token file")
    end = 12 + int.from_bytes(body[8:12], "little")
    head = json.loads(body[12:end])
    parts = []
    for n in head["sections"]:
        parts.append(body[end : end + n])
        end += n
    lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[0], max_output_size=max(1, head["vocabulary"])), np.uint8)
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=head["docs"])
    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[2], max_output_size=max(1, 8 * head["docs"])), "<i8")
    docs = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
    return docs, unpack(parts[3]).astype(np.int64), decode_bits(parts[5], unpack(parts[4]), head["ids"], lengths)


def _tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    schema = arrow_schema("doc_id long, n long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("bpe", encoder.cache_clear)
        for batch in pieces(batches, "text", TOGETHER):
            ids, at = encoder(path, True).encode(*utf8(column(batch, "text")))
            each = [np.append(ids[a:b], np.uint32(end)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(at) + 1), pa.array([_thin(x) for x in each], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def _thin(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough; the first byte tells."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.uint32)


def _counts(tokens: DataFrame, size: int) -> np.ndarray:
    schema = arrow_schema("id int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for b in column(batch, "ids").to_pylist():
                total += np.bincount(_wide(b), minlength=size) if len(b) > size else 0
            small = [_wide(b) for b in column(batch, "ids").to_pylist() if len(b) <= size]
            if small:
                total += np.bincount(np.concatenate(small), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], schema=schema)

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary at most
        out[row["id"]] = row["n"]
    return out


_FILES = "path string, part int, seq int, docs long, ids long, bytes long"


def write(docs: DataFrame, path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Write the token files of docs; returns their table: path, part and seq (their order), docs, ids, bytes."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark)
    tokens = materialise(_tokens(docs, path, end), folder)
    size = max(_vocabulary_size(path), end + 1)
    lengths = code_lengths(_counts(tokens, size))
    codes = canonical(lengths)
    schema = arrow_schema(_FILES)
    packed = zstandard.ZstdCompressor().compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        fs, root = FileSystem.from_uri(folder)
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, size)), np.uint8)
        words = canonical(own)
        held: list = []
        names: list = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, names
            ids = np.concatenate(held)
            name = f"{root}/{uuid.uuid4().hex}.tok"
            n = write_file(fs, name, names, np.array([len(x) for x in held]), ids, own, words)
            out = pa.RecordBatch.from_pylist([{"path": name, "part": part, "seq": seq, "docs": len(held), "ids": len(ids), "bytes": n}], schema=schema)
            seq, held, names = seq + 1, [], []
            return out

        total = 0
        for batch in batches:
            for d, b in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                held.append(_wide(b))
                names.append(d)
                total += len(held[-1])
                if total >= FILE_IDS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    del codes
    ordered = tokens.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return materialise(ordered.mapInArrow(run, _FILES), folder)


def _vocabulary_size(path: str) -> int:
    saved = json.load(open(path, encoding="utf-8"))
    return max([*saved["model"]["vocab"].values(), *(t["id"] for t in saved["added_tokens"])]) + 1


def read(files: DataFrame, folder: str) -> DataFrame:
    """A row per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, in file order."""
    # a row for each file of about FILE_IDS ids: a million files for 2 * 10^12 ids
    first = files.withColumn("base", F.sum("ids").over(Window.orderBy("part", "seq")) - F.col("ids"))
    schema = arrow_schema("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(row["path"]) as f:
                    docs, counts, ids = read_file(f.read())
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - counts + row["base"]), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    return first.select("path", "base").repartition(partitions(files.sparkSession), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    folder = scratch(docs.sparkSession)
    return read(write(docs, path, end, folder), folder)
