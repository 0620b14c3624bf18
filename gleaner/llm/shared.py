"""What the operators share: tables in the cluster's shared folder, Arrow columns as numpy arrays, packed integers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that all contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"

_SHIPPED = "_gleaner_shipped"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per context: they need no shared code folder."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # Spark's default: rows of a batch that JVM and Python both hold
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def scratch(spark: SparkSession) -> str:
    """A new folder (as a URI) under spark.checkpoint.dir, which driver and executors share; it goes when the JVM ends.

    Where the setting is unset a temporary folder of this machine serves in local mode; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/gleaner-scratch"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path if "://" in path else fs.makeQualified(hadoop).toString()


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read it again: lineage ends, lost executors lose nothing."""
    path = f"{folder or scratch(df.sparkSession)}/{uuid.uuid4().hex[:8]}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table of materialise() that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row's begin and end; a null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of the named column, one row at least; then memory that is free goes back."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most if len(size) else size
        starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(size) else []
        for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
            yield batch.slice(int(a), int(b - a))
    release()


_WORKER: dict = {"of": "", "forget": []}


def working_for(name: str, *forget) -> None:
    """Say which operator's task this Python worker runs. Workers are used again: what another operator remembers in one goes.

    forget: functions that let go of what this operator remembers from task to task.
    """
    if _WORKER["of"] != name:
        for f in _WORKER["forget"]:
            f()
        _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
        release()
    _WORKER.update(of=name, forget=list(forget))


def release() -> None:
    """Give free memory of this process back to the system, as a worker that waits for its next task keeps it else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not everywhere is there a malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of many ranges, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = lengths > 0
    starts, lengths = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out, out=out)


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over all bytes from prefix sums, shifted to the range's start."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=sums[1:])
    del terms
    return mixed((sums[ends] - sums[starts]) * down[starts], 1) ^ mixed((ends - starts).astype(np.uint64), 2)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (between white space) of all rows, and the row of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = np.ones(len(data) + 1, bool)
    ink[:-1] = (data != 32) & ((data < 9) | (data > 13))
    ink[-1] = False
    begins = ink[:-1].copy()
    begins[1:] &= ~ink[:-2]
    edge = at[:-1][at[:-1] < len(data)]
    begins[edge] = ink[edge]
    starts = np.flatnonzero(begins)
    stops = ink[:-1] & ~ink[1:]
    last = at[1:][at[1:] > 0] - 1
    stops[last] = ink[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers as bytes: differences if they rise, the narrowest type, byte planes, zstd."""
    x = np.ascontiguousarray(x, np.uint64)
    if rising and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << (8 * w))
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    return bytes([width | 128 * rising]) + len(x).to_bytes(8, "little") + body


def unpack(b: bytes) -> np.ndarray:
    width, rising, n = b[0] & 127, b[0] >> 7, int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=max(1, n * width)), np.uint8)
    x = np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.uint64)
    return np.cumsum(x, dtype=np.uint64) if rising else x


def row_key(text: str = "text") -> Column:
    """A 64-bit key of a text, for rows that are found again by doc_id and text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\x00null")))


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """Each row of docs as one column `row`, so that no name of its columns can clash, beside the named columns and the text's key.

    `row.*` gives the columns back; `form` orders rows that are the same in all but other columns, the same way each time.
    """
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), *(F.col(k).alias(k) for k in keys), row_key().alias("key"))


def row_form() -> Column:
    """A row of packed() as text: to order rows by all their columns, whatever the types of these."""
    return F.to_json("row")


def retain(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that decided (doc_id, key, kept: a row for each of docs) keeps.

    doc_id may be null or repeated, so rows are found by doc_id and key; of rows that are the same in both, the one whose
    columns come first as JSON stays. Other columns may have any names.
    """
    kept = decided.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("kept")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "n")
    found = packed(docs, "doc_id").join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    by = Window.partitionBy("kept_id", "kept_key").orderBy("form")
    more = found.filter("n > 1").withColumn("form", row_form()).withColumn("r", F.row_number().over(by)).filter("r = 1")
    return found.filter("n = 1").select("row.*").unionByName(more.select("row.*"))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(form: str) -> pa.Schema:
    """The Arrow form of "name type, name type, ..."."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in form.split(","))])
