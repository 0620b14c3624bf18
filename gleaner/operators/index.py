"""The index as tables: blocks with their tokens, inverted chunks of blocks, term statistics, heads of structural lists.

Texts are tokenised once: a block's body when the block is written, a document's context when its row is. A chunk is a
row: some ten thousand blocks, turned round, so that a ranking looks up the terms asked for and reads their postings
alone (operators/scan.py). save() keeps an index, load() reads it again.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.wordlists import STRUCTURAL
from gleaner.sources import corpus
from gleaner.sources.stage import drop, staged

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents with terms in how many blocks at least, and in what share of them at most, count for TF-IDF.
LEAST_DF, MOST_DF = 2, 0.6
#: Blocks of a chunk, at most 2^16: a block's number in it has two bytes. More take more memory, fewer more time.
CHUNK = 1 << 14
#: Ids of so many blocks are sent to all tasks; more are joined by a shuffle.
FEW = 500_000


class Index:
    """blocks: block_ix, doc_id, n, body, terms (of the body), ctx, ctx_terms, names, dl (tokens of context and body), tokens, structure, previous, next, position.
    docs: as corpus.documents, with ctx and ctx_terms. chunks: see CHUNKS.
    stats: term, df (of both), body_df."""

    def __init__(self, blocks: DataFrame, docs: DataFrame, chunks: DataFrame, stats: DataFrame) -> None:
        self.blocks, self.docs, self.chunks, self.stats = blocks, docs, chunks, stats

    @cached_property
    def size(self) -> tuple[int, float]:
        """Blocks (those without a token, too) and their mean length; one row."""
        n, mean = self.blocks.agg(F.count("*"), F.avg("dl")).first()
        return n, mean or 0.0

    @cached_property
    def mean_idf(self) -> float:
        return self.stats.agg(F.avg(_raw_idf(F.col("df"), self.size[0]))).first()[0] or 0.0

    @property
    def postings(self) -> DataFrame:
        """block_ix, dl, term, tf (of context and body), ctf (of the context): all of them, for looking at; rankings read the chunks."""
        return _counted(self.blocks.select("block_ix", "dl", "terms", "ctx_terms"))

    def narrowed(self, ids: DataFrame, *columns: str) -> Index:
        """The index with the given blocks (block_ix), and these columns of them, alone to be looked up; statistics and chunks stay those of all blocks."""
        self.size  # noqa: B018  (counted over all blocks)
        ids = staged(ids.select("block_ix").distinct())
        out = copy.copy(self)
        out.blocks = staged(self.blocks.select(*(columns or self.blocks.columns)).join(F.broadcast(ids) if ids.count() <= FEW else ids, "block_ix", "left_semi"))
        return out

    @property
    def bm25_idf(self) -> DataFrame:
        """term, df, idf."""
        return self.stats.filter("df > 0").select("term", "df", bm25_idf(F.col("df"), self.size[0], self.mean_idf).alias("idf"))

    @property
    def tfidf_idf(self) -> DataFrame:
        """term, idf of the terms that are neither too rare nor too common."""
        n = self.size[0]
        return self.stats.filter((F.col("df") >= LEAST_DF) & (F.col("df") <= MOST_DF * n)).select("term", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))

    @property
    def cover_idf(self) -> DataFrame:
        """term, idf over bodies."""
        return self.stats.filter("body_df > 0").select("term", (F.log((self.size[0] + 1.0) / (F.col("body_df") + 1)) + 1).alias("idf"))

    @cached_property
    def heads(self) -> DataFrame:
        """key, value, block_ix: the first STRUCTURAL blocks of each week, unit and kind. A few hundred rows."""
        out = None
        for key in ("week", "unit", "kind"):
            rows = self.blocks.filter(F.col(key).isNotNull()).select(F.lit(key).alias("key"), F.col(key).cast("string").alias("value"), "block_ix")
            first = rows.withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy("block_ix"))).filter(F.col("r") <= STRUCTURAL).drop("r")
            out = first if out is None else out.unionByName(first)
        return staged(out)

    @cached_property
    def authors(self) -> DataFrame:
        """doc_id, term: runs of letters and digits in the authors' names."""
        return self.docs.select("doc_id", F.explode(corpus.author_terms(F.col("author"))).alias("term")).distinct()

    def save(self, path: str) -> None:
        for name in ("blocks", "docs", "chunks", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "docs", "chunks", "stats")))


_BUILT: dict[tuple, Index] = {}


def of(spark: SparkSession, folder: str) -> Index:
    """The index of a folder's documents, built the first time in this application and kept in the shared folder; new files, a new index."""
    key = (spark.sparkContext.applicationId, folder, *sorted(corpus.table(spark, folder, "documents").inputFiles()))
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[:2] == key[:2] or k[0] != key[0]]:
            del _BUILT[old]
        _BUILT[key] = build(spark, folder)
    return _BUILT[key]


def build(spark: SparkSession, folder: str) -> Index:
    docs = corpus.documents(spark, folder).withColumn("ctx", corpus.context())
    docs = staged(docs.withColumn("ctx_terms", X.tokens(F.col("ctx"))))
    rows = corpus.block_rows(spark, folder, context_too=True).withColumn("terms", X.tokens(F.col("body")))
    blocks = staged(rows.withColumn("dl", F.size("terms") + F.size("ctx_terms")))
    each = blocks.select("block_ix", "terms", "ctx_terms", "names")
    parts = each.mapInArrow(_turned(), "term string, df long, body_df long")
    index = Index(blocks, docs, blocks, staged(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("body_df").alias("body_df"))))
    weighed = staged(index.tfidf_idf)
    index.chunks = staged(each.mapInArrow(_turned(_folder(weighed)), CHUNKS))
    drop(weighed)
    return index


def _folder(table: DataFrame) -> str:
    return next(iter(table.inputFiles())).rsplit("/", 1)[0]


#: ix, dl, own, norm: of each block its block_ix (rising), tokens of context and body, of the body, length of its TF-IDF vector.
#: terms, start: the postings of the k-th term lie from the k-th start to the next; row, tf, ctf: a posting's block (its place in
#: ix), occurrences in context and body, in the context. names, name_start, name_row: the blocks of authors' names, likewise.
CHUNKS = "ix binary, dl binary, own binary, norm binary, terms array<string>, start binary, row binary, tf binary, ctf binary, names array<string>, name_start binary, name_row binary"


def _turned(weights: str | None = None):
    """Blocks (block_ix, terms, ctx_terms, names) as chunks. weights: the folder of a table (term, idf); without it only what a chunk adds to the statistics.

    The weights are read a batch at a time and only those of the chunk's terms are kept.
    """
    size = CHUNK if weights else 2 * CHUNK  # of the statistics alone less is held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import contextlib
        import ctypes

        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        def small(x: np.ndarray) -> bytes:
            return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32).tobytes()

        def words(column: pa.Array, place: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            """All words of a column of lists, and of each the place of its row."""
            return column.flatten(), np.repeat(place, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))

        def idf(terms: pa.Array) -> np.ndarray:
            out = np.zeros(len(terms))
            store, path = fs.FileSystem.from_uri(weights)
            for part in ds.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=1 << 17):
                at = pc.index_in(part.column("term"), value_set=terms)
                there = at.is_valid()
                out[at.filter(there).to_numpy()] = part.column("idf").filter(there).to_numpy()
            return out

        def turned(rows: pa.Table) -> pa.RecordBatch:
            col = lambda name: rows.column(name).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type)
            ix = col("block_ix").to_numpy()
            order = np.argsort(ix, kind="stable")
            place = np.empty(len(ix), np.int64)
            place[order] = np.arange(len(ix))
            body, at = words(col("terms"), place)
            context, ctx_at = words(col("ctx_terms"), place)
            coded = pa.concat_arrays([body, context]).dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            own, dl = (np.bincount(x, minlength=len(ix)).astype(np.int32) for x in (at, np.concatenate([at, ctx_at])))
            keys, tf = np.unique(code * size + np.concatenate([at, ctx_at]), return_counts=True)
            ctx_keys, ctx_tf = np.unique(code[len(body) :] * size + ctx_at, return_counts=True)
            del body, coded, context, code, at
            ctf = np.zeros(len(keys), np.int64)
            ctf[np.searchsorted(keys, ctx_keys)] = ctx_tf
            term, row = keys // size, keys % size
            if weights is None:
                df, body_df = np.bincount(term, minlength=len(terms)), np.bincount(term[tf > ctf], minlength=len(terms))
                return pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(body_df, pa.int64())], names=["term", "df", "body_df"])
            starts = lambda k, n: np.searchsorted(k, np.arange(n + 1)).astype(np.int32).tobytes()
            norm = np.sqrt(np.bincount(row, ((1 + np.log(tf)) * idf(terms)[term]) ** 2, minlength=len(ix)))
            author, author_at = words(col("names"), place)
            names = author.dictionary_encode()
            k = np.unique(names.indices.to_numpy().astype(np.int64) * size + author_at)
            short = lambda x: x.astype(np.uint16).tobytes()
            values = [
                ix[order].tobytes(), dl.tobytes(), own.tobytes(), norm.tobytes(), terms.to_pylist(), starts(term, len(terms)), short(row), small(tf), small(ctf),
                names.dictionary.to_pylist(), starts(k // size, len(names.dictionary)), short(k % size),
            ]
            fields = ["ix", "dl", "own", "norm", "terms", "start", "row", "tf", "ctf", "names", "name_start", "name_row"]
            kinds = [pa.list_(pa.string()) if n in ("terms", "names") else pa.binary() for n in fields]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=fields)

        held, count = [], 0
        for batch in batches:
            while count + batch.num_rows >= size:
                whole, rest = pa.Table.from_batches([*held, batch.slice(0, size - count)]), batch.slice(size - count)
                held, count = [], 0
                yield turned(whole)
                batch = rest
            held.append(batch)
            count += batch.num_rows
        if count:
            yield turned(pa.Table.from_batches(held))
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks, and would keep what is free
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def _counted(blocks: DataFrame) -> DataFrame:
    """blocks (block_ix, dl, terms, ctx_terms): a row for each block and term. A block's tokens are sorted and its runs counted in its row: nothing is shuffled."""
    once = lambda df, c, name: df.select("block_ix", "dl", "ctx_terms", *(x for x in df.columns if x in ("s",)), F.explode(F.array(c)).alias(name))  # noqa: E731  (made once, then looked up)
    rows = once(blocks.filter("dl > 0"), F.array_sort(F.concat("ctx_terms", "terms")), "s")
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = once(rows, first, "first")
    run = lambda a, k: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("s")) - a).alias("tf"), F.size(F.filter("ctx_terms", lambda t: t == F.get("s", a))).alias("ctf"))
    return rows.select("block_ix", "dl", F.explode(F.transform("first", run)).alias("r")).select("block_ix", "dl", "r.*")


def postings(blocks: DataFrame, column: str) -> DataFrame:
    """block_ix, term, tf."""
    return blocks.select("block_ix", F.explode(X.tokens(F.col(column))).alias("term")).groupBy("block_ix", "term").agg(F.count("*").alias("tf"))


def _raw_idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def bm25_idf(df: Column, n: int, mean: float) -> Column:
    """A negative idf becomes EPSILON times the mean over the vocabulary."""
    raw = _raw_idf(df, n)
    return F.when(raw < 0, EPSILON * mean).otherwise(raw)


def bm25_terms(full: DataFrame, n_blocks: DataFrame) -> DataFrame:
    """term, df, idf of postings. n_blocks: one row (n), with blocks that have no token counted."""
    df = full.groupBy("term").agg(F.count("*").alias("df"))
    n = n_blocks.first()["n"]
    mean = df.agg(F.avg(_raw_idf(F.col("df"), n))).first()[0] or 0.0
    return df.select("term", "df", bm25_idf(F.col("df"), n, mean).alias("idf"))


def cover_idf(body: DataFrame, n_blocks: DataFrame) -> DataFrame:
    """term, df, idf = ln((N+1)/(df+1)) + 1, over bodies."""
    df = body.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_blocks))  # one row
    return df.select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def block_count(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("n"))


def neighbours(blocks: DataFrame) -> DataFrame:
    """block_ix, doc_id, previous, next, position, total within the document, in line order."""
    by = Window.partitionBy("doc_id").orderBy("n")
    return blocks.select(
        "block_ix", "doc_id", F.lag("block_ix").over(by).alias("previous"), F.lead("block_ix").over(by).alias("next"),
        F.row_number().over(by).alias("position"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"),
    )


def structure_map(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of each week, unit, kind, author, authority or document: key, blocks, first."""
    return blocks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("blocks"), F.min("block_ix").alias("first"))
