"""Products of a stated set of query vectors with all vectors, a block of each at a time.

Neither side is broadcast by hand or collected: blocks of some hundred queries meet blocks of some thousand vectors, a
task makes one product of two blocks and hands on the best of each query alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES, VECTORS = 256, 4096


def _blocks(rows: DataFrame, ident: str, size: int, name: str) -> DataFrame:
    """Rows (ident, vector) as blocks of about `size`; rows without id or vector take no part."""
    rows = rows.filter(F.col(ident).isNotNull() & F.col("vector").isNotNull()).select(ident, F.col("vector").cast("array<double>").alias("vector"))
    count = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("blocks"))
    dealt = rows.crossJoin(F.broadcast(count))  # one row
    return dealt.groupBy(F.pmod(F.xxhash64(ident), F.col("blocks")).alias("b")).agg(F.collect_list(F.struct(F.col(ident).cast("long").alias("id"), "vector")).alias(name)).select(name)


def _best(n: int, cut: float | None, others: bool):
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def read(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            rows = lists.flatten()
            vectors = rows.field("vector")
            return rows.field("id").to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                (q_ids, q), (v_ids, v) = (read(one.column(one.schema.get_field_index(c))) for c in ("asked", "held"))
                scores = np.round(q @ v.T, 9)
                if others:
                    scores[q_ids[:, None] == v_ids] = -np.inf
                order = np.lexsort((np.broadcast_to(v_ids, scores.shape), -scores), axis=1)[:, :n]
                best = np.take_along_axis(scores, order, 1)
                row, col = np.nonzero(best > (cut if cut is not None else -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(v_ids[order[row, col]]), pa.array(best[row, col])], schema=schema)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, n: int, cut: float | None = None, others: bool = False) -> DataFrame:
    """queries (qid, vector), vectors (vec_id, vector) of one width: qid, vec_id, score, rank of the n largest products above the cut.

    Scores are rounded to nine places, ties go to the smaller vec_id; others: a query's own id is passed over.
    """
    pairs = _blocks(vectors, "vec_id", VECTORS, "held").crossJoin(_blocks(queries, "qid", QUERIES, "asked"))  # the stated queries, in blocks
    found = pairs.mapInArrow(_best(n, cut, others), "qid long, vec_id long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def largest(queries: DataFrame, vectors: DataFrame, others: bool = False) -> DataFrame:
    """qid, similarity: the largest product of each query."""
    return nearest(queries, vectors, 1, None, others).select("qid", F.col("score").alias("similarity"))
