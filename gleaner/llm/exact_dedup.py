"""Exact duplicates by composable polynomial fingerprints, then a chunkwise comparison of whole texts.

A fingerprint is four polynomials, modulo primes below 2^31, of the text's UTF-8 bytes without white space. The hash of a
concatenation is hash(left) * base^length(right) + hash(right), so chunks of one text are hashed apart, in any task,
and combined by the lengths behind them. Rows with equal fingerprints and lengths are candidates; their texts are then
compared with their group's first text chunk by chunk, and rows that differ are grouped anew until all agree.

Defined results: a null text counts as empty, empty texts are equal to each other; a null doc_id loses every tie and is
kept only if all ids of its group are null; of rows that are the same in everything exactly one is kept; columns other
than the id and the text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import BLANKS, arrow_schema, column, materialise, partitions, pieces, row_key, scratch, ship, working_for

#: Primes below 2^31 and a base for each.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1402024253, 1812433253, 1566083941)
#: Bytes hashed at once: 2^8 * 2^31 * 2^16 stays below 2^64.
CHUNK = 1 << 16
#: Characters from which a text's chunks are rows of their own, dealt over all tasks.
HUGE = 16 << 20
#: Characters of a chunk in the comparison, rows compared with one copy of the first text, and bits of the candidates' map.
COMPARED, SALTED, MAP_BITS = 1 << 16, 64, 26

_DROP = r"[\x20\x09-\x0D]"
_FOUND = "doc_id long, key long, n_cp long, n_bytes long, h0 long, h1 long, h2 long, h3 long, text_sha256 string"
FINGERPRINT = ["n_bytes", "h0", "h1", "h2", "h3"]
_TABLES: dict[tuple, list[np.ndarray]] = {}


def _weights(moduli: tuple[int, ...]) -> list[np.ndarray]:
    """base^(CHUNK-1), ..., base, 1 for each modulus."""
    if moduli not in _TABLES:
        out = []
        for p, b in zip(moduli, BASES, strict=True):
            w, done = np.ones(CHUNK, np.uint64), 1
            while done < CHUNK:
                w[done : 2 * done] = w[:done] * np.uint64(pow(b, done, p)) % np.uint64(p)
                done *= 2
            out.append(np.ascontiguousarray(w[::-1]))
        _TABLES[moduli] = out
    return _TABLES[moduli]


def hash_chunk(data: bytes, moduli: tuple[int, ...] = MODULI) -> tuple[int, list[int]]:
    """Length and polynomials of at most CHUNK bytes; a zero byte counts too, as bytes are taken plus one."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return len(x), [int(np.dot(x, w[CHUNK - len(x) :])) % p for w, p in zip(_weights(moduli), moduli, strict=True)]


def combine(left: tuple[int, list[int]], right: tuple[int, list[int]], moduli: tuple[int, ...] = MODULI) -> tuple[int, list[int]]:
    """The fingerprint of a concatenation."""
    n = right[0]
    return left[0] + n, [(a * pow(b, n, p) + c) % p for a, c, b, p in zip(left[1], right[1], BASES, moduli, strict=True)]


def fingerprint(data: bytes, moduli: tuple[int, ...] = MODULI) -> tuple[int, list[int]]:
    out = hash_chunk(data[:CHUNK], moduli)
    for i in range(CHUNK, len(data), CHUNK):
        out = combine(out, hash_chunk(data[i : i + CHUNK], moduli), moduli)
    return out


def _small(moduli: tuple[int, ...]):
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("exact_dedup")
        for batch in pieces(batches, "text"):
            ids, keys = column(batch, "doc_id"), column(batch, "key")
            cols: list[list] = [[] for _ in range(7)]
            for text in column(batch, "text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                bare = raw.translate(None, BLANKS)
                n, h = fingerprint(bare, moduli)
                for c, v in zip(cols, (len(text or ""), n, *h, hashlib.sha256(bare).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([ids, keys, *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)

    return run


def _huge(rows: DataFrame, moduli: tuple[int, ...]) -> DataFrame:
    """Texts of HUGE characters and more: each chunk is a row, hashed where it falls, and sums of shifted hashes combine them."""
    chunks = (
        rows.withColumn("whole", F.sha2("text", 256))
        .withColumn("bare", F.regexp_replace("text", _DROP, ""))
        .select("doc_id", "key", "whole", F.length("text").cast("long").alias("n_cp"), F.sha2("bare", 256).alias("text_sha256"), F.octet_length("bare").cast("long").alias("n_bytes"), "bare")
        .select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("bare") / F.lit(1 << 20)).cast("int") - 1))).alias("ix"))
        .withColumn("part", F.substring("bare", F.col("ix") * F.lit(1 << 20) + 1, F.lit(1 << 20)))
        .drop("bare")
        .repartition(partitions(rows.sparkSession), "whole", "ix")
    )
    form = arrow_schema("whole string, ix int, n long, h0 long, h1 long, h2 long, h3 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.encode(), moduli) for x in column(batch, "part").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "whole"), column(batch, "ix"), pa.array([n for n, _ in found], pa.int64()), *(pa.array([h[i] for _, h in found], pa.int64()) for i in range(4))], schema=form)

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("whole string, h0 long, h1 long, h2 long, h3 long")
        for batch in parts:
            out = []
            for row in batch.to_pylist():
                total: tuple[int, list[int]] = (0, [0] * 4)
                for x in sorted(row["parts"], key=lambda x: x["ix"]):
                    total = combine(total, (x["n"], [x[f"h{i}"] for i in range(4)]), moduli)
                out.append({"whole": row["whole"]} | {f"h{i}": total[1][i] for i in range(4)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    hashed = chunks.mapInArrow(run, "whole string, ix int, n long, h0 long, h1 long, h2 long, h3 long")
    totals = hashed.distinct().groupBy("whole").agg(F.collect_list(F.struct("ix", "n", "h0", "h1", "h2", "h3")).alias("parts")).mapInArrow(joined, "whole string, h0 long, h1 long, h2 long, h3 long")
    heads = rows.select("doc_id", "key", F.sha2("text", 256).alias("whole"), F.length("text").cast("long").alias("n_cp"), F.regexp_replace("text", _DROP, "").alias("bare"))
    return heads.select("doc_id", "key", "whole", "n_cp", F.octet_length("bare").cast("long").alias("n_bytes"), F.sha2("bare", 256).alias("text_sha256")).join(totals, "whole").select("doc_id", "key", "n_cp", *FINGERPRINT, "text_sha256")


def fingerprints(docs: DataFrame, moduli: tuple[int, ...] = MODULI, huge: int = HUGE) -> DataFrame:
    """A row per document: doc_id, key, code points, bytes without white space, the four polynomials, SHA-256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    long = F.coalesce(F.length("text"), F.lit(0)) >= huge
    return rows.filter(~long).mapInArrow(_small(moduli), _FOUND).unionByName(_huge(rows.filter(long), moduli))


def candidates(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of docs that may be members (key, ...): those whose key's bit is set in a map of at most 2^MAP_BITS bits, 8 MB."""
    at = F.pmod(F.col("key"), F.lit(1 << MAP_BITS))
    slot, bit = F.expr("bitmap_bucket_number(at)"), F.expr("bitmap_bit_position(at)")
    bits = members.select(at.alias("at")).select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key")).withColumn("at", at).withColumn("slot", slot).withColumn("bit", bit)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), "slot").filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).select("doc_id", "key", "text")


def _differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Of members (uid, doc_id, key, n_cp, gid, first: the uid it is held against, size), those whose text differs from the first's.

    Chunks meet by group, place and salt: one copy of the first text for SALTED members.
    """
    texts = candidates(docs, members).withColumnRenamed("key", "_key").withColumnRenamed("doc_id", "_id").dropDuplicates(["_id", "_key"])
    rows = members.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), _DROP, "")
    rows = rows.select("uid", "gid", "first", "size", bare.alias("bare")).withColumn("salts", F.ceil(F.col("size") / SALTED).cast("int"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("bare") / COMPARED).cast("int") - 1))
    cut = F.transform(places, lambda i: F.named_struct(F.lit("ix"), i, F.lit("part"), F.substring("bare", i * F.lit(COMPARED) + 1, F.lit(COMPARED))))
    others = rows.filter("uid <> first").select("uid", "gid", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int").alias("salt"), F.explode(cut).alias("c")).select("uid", "gid", "salt", "c.*")
    firsts = rows.filter("uid = first").select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), cut.alias("cs")).select("gid", "salt", F.explode("cs").alias("c")).select("gid", "salt", F.col("c.ix").alias("ix"), F.col("c.part").alias("held"))
    seen = others.join(firsts, ["gid", "salt", "ix"], "left")
    return seen.groupBy("uid").agg(F.bool_and(F.col("part").eqNullSafe(F.col("held"))).alias("same")).filter("NOT same").select("uid")


def groups(docs: DataFrame, moduli: tuple[int, ...] = MODULI, huge: int = HUGE) -> DataFrame:
    """A row per row of docs: uid, doc_id, key, n_cp, n_bytes, text_sha256, keep_id, keep_uid, group_size, kept."""
    spark = docs.sparkSession
    ship(spark)
    folder = scratch(spark)
    rows = materialise(fingerprints(docs, moduli, huge), folder)
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), folder)
    best = F.max(F.struct("n_cp", F.bitwise_not(F.col("doc_id")).alias("id"), F.bitwise_not(F.col("uid")).alias("uid"))).alias("best")
    by = [*FINGERPRINT, "class"]
    rows = rows.withColumn("class", F.lit(0).cast("long"))
    turn = 0
    while True:
        turn += 1
        found = materialise(rows.groupBy(by).agg(F.count("*").alias("size"), F.min("uid").alias("first"), best), folder)
        shared = found.filter("size > 1").withColumn("gid", F.xxhash64(*by))
        if turn > 1:  # only the classes that came out of a mismatch
            shared = shared.filter(F.col("class") == turn - 1)
        members = materialise(rows.join(shared.drop("best"), by).select("uid", "doc_id", "key", "n_cp", "gid", "first", "size"), folder)
        odd = materialise(_differing(docs, members), folder)
        if odd.isEmpty():
            break
        rows = rows.join(odd.withColumn("odd", F.lit(True)), "uid", "left").withColumn("class", F.when(F.col("odd"), F.lit(turn).cast("long")).otherwise(F.col("class"))).drop("odd")
        rows = materialise(rows, folder)
    joined = rows.join(found.drop("first"), by)
    keep = F.bitwise_not(F.col("best.uid"))
    return joined.select("uid", "doc_id", "key", "n_cp", "n_bytes", "text_sha256", F.bitwise_not(F.col("best.id")).alias("keep_id"), keep.alias("keep_uid"), F.col("size").alias("group_size"), (F.col("uid") == keep).alias("kept"))


def decisions(docs: DataFrame) -> DataFrame:
    """The contract's digest of groups()."""
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
