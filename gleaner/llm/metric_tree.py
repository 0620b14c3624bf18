"""Exact top-k search by inner product with paged M-trees and best-first search.

Integer vectors x get one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, and queries get 0 there: then
the Euclidean distance of a query falls as its inner product rises, and the order of the one is the order of the other.
Distances prune, with a slack for rounding; what is returned and compared are the integer products themselves.

Vectors fall to the nearest of at most PIVOTS pivots; each region is split, by hash, into trees of about TREE vectors. A
tree's pages hold routing objects with a covering radius and the distance to their parent, or up to PAGE vectors with the
distance to theirs. Each tree is a file in the shared folder whose pages are read singly, when a search comes to them.

Queries are searched in blocks, those of one region together: the pages of up to FOREST trees are taken in the order of
their least possible distance to any of the block's queries, each only for the queries that it can still hold something
for; entries that the stored distances rule out for all of these are passed over, and one product gives the distances to
the others. A query first searches the region of its nearest pivot; the k-th distance found there decides which other
regions it visits.

Of equal vectors the k + 1 smallest ids stand for all: no other can be among the k best of any query.

Defined results: vectors that are null or hold null or non-finite components (after scaling, too) take no part, nor do
rows without an id; shorter vectors are padded with zeros, so an empty one has product 0 with all; a query is never its
own result, nor are other rows with its id; a row that is repeated is as many candidates; ties go to the smaller id;
products beyond 64 bits count as the largest (or smallest) number of 64 bits but one. Squared norms must be finite doubles.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import arrow_schema, column, materialise, partitions, scratch, ship, working_for

SCALE, K, EVERY = 64, 20, 20
PIVOTS, TREE, PAGE, FAN, QUERIES, FOREST = 1024, 16384, 256, 16, 512, 8
SLACK = 1e-6
#: What fills a query's list while it has fewer than k results.
_NO_SCORE, _NO_ID = -(1 << 63), (1 << 63) - 1


def scaled(vector: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as exact doubles, or null for a vector that takes no part."""
    times = lambda x: F.lit(float(scale)) * x.cast("double")
    # a double of 2^53 and more is an integer
    whole = F.transform(vector, lambda x: F.when(F.abs(times(x)) < F.lit(2.0**53), F.floor(times(x)).cast("double")).otherwise(times(x)))
    odd = F.exists(vector, lambda x: x.isNull() | ~(F.abs(times(x)) < F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True)), whole)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width, shorter ones padded with zeros."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    at = at - at[0]
    if len(at) > 1 and (np.diff(at) == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(at) - 1, width))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs of rows, as integers of 64 bits; doubles, integers or Python's own as the norms need."""
    if not len(q):
        return np.zeros(0, np.int64)
    bound = np.sqrt((q * q).sum(1).max() * (x * x).sum(1).max())
    if bound < 2.0**52:
        return (q * x).sum(1).astype(np.int64)
    if bound < 2.0**62:
        return (q.astype(np.int64) * x.astype(np.int64)).sum(1)
    most = (1 << 63) - 1
    return np.array([max(-most, min(most, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


class Space:
    """The augmented Euclidean metric over integer rows."""

    def __init__(self, top: float) -> None:
        self.top = float(top)

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - (x * x).sum(-1)))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """From one row y to rows x."""
        gap = x - y
        return np.sqrt((gap * gap).sum(-1) + (self.extra(x) - self.extra(y)) ** 2)

    def of_products(self, p: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Distances from queries with squared norms `square`."""
        return np.sqrt(np.maximum(0.0, square + self.top - 2.0 * p))

    def middle(self, x: np.ndarray) -> int:
        """The row that is nearest to the mean of all."""
        e = self.extra(x)
        return int((((x - x.mean(0)) ** 2).sum(1) + (e - e.mean()) ** 2).argmin())


def build(x: np.ndarray, space: Space, seed: int = 0) -> list[dict]:
    """Pages of an M-tree over the rows of x, the root first: rows (of x: entries or routing objects), to_parent, radius, child (-1 in leaves).

    A page's rows go to the nearest of some seeds; each seed then gives way to the row in the middle of its part, which
    keeps covering radii small. Where nearly all rows fall to one seed, they are cut into rings around it instead.
    """
    x = np.asarray(x, np.float64)
    pages: list[dict] = []
    draw = np.random.default_rng(seed)

    def parted(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        n = min(FAN, -(-len(rows) // (PAGE // 2)))
        seeds = draw.choice(rows, n, replace=False)
        for turn in (0, 1):
            near = np.stack([space.between(x[rows], x[s]) for s in seeds])
            mine = near.argmin(0)
            if turn == 0:
                seeds = np.array([rows[mine == i][space.middle(x[rows[mine == i]])] for i in range(len(seeds)) if (mine == i).any()])
        parts = [(int(s), rows[mine == i]) for i, s in enumerate(seeds) if (mine == i).any()]
        if max(len(p) for _, p in parts) > 0.9 * len(rows):
            own = rows[np.argsort(near[np.argmax(np.bincount(mine))], kind="stable")]
            parts = [(int(own[0]), ring) for ring in np.array_split(own, n)]
        return parts

    def grow(rows: np.ndarray, parent: np.ndarray | None) -> int:
        at = len(pages)
        pages.append({})
        if len(rows) <= PAGE:
            to = space.between(x[rows], parent) if parent is not None else np.zeros(len(rows))
            pages[at] = {"rows": rows, "to_parent": to, "radius": np.zeros(len(rows)), "child": np.full(len(rows), -1)}
            return at
        parts = parted(rows)
        own = np.array([s for s, _ in parts])
        radius = np.array([space.between(x[p], x[s]).max() for s, p in parts])
        child = np.array([grow(p, x[s]) for s, p in parts])
        to = space.between(x[own], parent) if parent is not None else np.zeros(len(own))
        pages[at] = {"rows": own, "to_parent": to, "radius": radius, "child": child}
        return at

    grow(np.arange(len(x)), None)
    return pages


class Tree:
    """A tree whose pages are read from its file when they are asked for. A page is a record batch, an entry a row of it."""

    def __init__(self, source, width: int) -> None:
        self.file, self.width, self.read = pa.ipc.open_file(source), width, {}
        self.kind = self.file.schema.metadata[b"kind"].decode()

    def page(self, n: int) -> tuple[np.ndarray, ...]:
        """Vectors, distances to the parent, radii, children, ids, and of each entry where its ids begin and how many they are."""
        if n not in self.read:
            b = self.file.get_batch(n)
            ids = column(b, "ids")
            at = ids.offsets.to_numpy()
            self.read[n] = (np.frombuffer(column(b, "vector").buffers()[1], self.kind, b.num_rows * self.width).reshape(-1, self.width), *(column(b, c).to_numpy() for c in ("to_parent", "radius", "child")), ids.values.to_numpy(), at[:-1], np.diff(at))
        vectors, *rest = self.read[n]
        return vectors.astype(np.float64), *rest


def stored(x: np.ndarray, ids: list[np.ndarray], pages: list[dict], sink) -> None:
    """Write the pages of build(x) with the entries' ids (none in routing pages)."""
    kind = "<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<f8"
    width = np.dtype(kind).itemsize * x.shape[1]
    schema = pa.schema([("vector", pa.binary(width)), ("to_parent", pa.float64()), ("radius", pa.float64()), ("child", pa.int32()), ("ids", pa.list_(pa.int64()))], metadata={"kind": kind})
    with pa.ipc.new_file(sink, schema) as out:
        for p in pages:
            n = len(p["rows"])
            own = [ids[r] for r in p["rows"]] if p["child"][0] < 0 else [np.zeros(0, np.int64)] * n
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own).astype(np.int64)))
            vector = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(x[p["rows"]].astype(kind).tobytes())])
            out.write_batch(pa.RecordBatch.from_arrays([vector, pa.array(p["to_parent"], pa.float64()), pa.array(p["radius"], pa.float64()), pa.array(p["child"], pa.int32()), lists], schema=schema))


class Search:
    """The best-first search of a block of queries through some trees. computed: distances so far, to routing objects and to vectors."""

    def __init__(self, space: Space, q: np.ndarray, own: np.ndarray, k: int, limit: np.ndarray) -> None:
        self.space, self.q, self.own, self.k, self.limit = space, q, own, k, limit.copy()
        self.square = (q * q).sum(1)
        self.slack = SLACK * (1 + np.sqrt(self.square + space.top))
        self.score = np.full((len(q), k), _NO_SCORE, np.int64)
        self.id = np.full((len(q), k), _NO_ID, np.int64)
        self.computed = 0

    def run(self, trees: list[Tree], low: list[np.ndarray]) -> None:
        """low: of each tree, a bound below each query's distance to all it holds; infinite for queries that don't visit it."""
        heap: list[tuple] = []
        number = count()

        def push(tree: Tree, page: int, rows: np.ndarray, least: np.ndarray, far: np.ndarray | None) -> None:
            if len(rows):
                heapq.heappush(heap, (float(least.min()), next(number), tree, page, rows, least, far))

        for tree, bound in zip(trees, low, strict=True):
            rows = np.flatnonzero(np.isfinite(bound))
            push(tree, 0, rows, bound[rows], None)
        while heap:
            least, _, tree, n, rows, low_, far = heapq.heappop(heap)
            within = self.limit + self.slack
            if least > within.max():
                break
            still = low_ <= within[rows]
            if not still.any():
                continue
            rows, low_ = rows[still], low_[still]
            vectors, to_parent, radius, child, ids, first, copies = tree.page(n)
            cols = np.arange(len(child))
            if far is not None:  # what the triangle inequality rules out needs no distance
                far = far[still]
                may = np.abs(far[:, None] - to_parent) - radius <= within[rows][:, None]
                used, cols = may.any(1), np.flatnonzero(may.any(0))
                rows, low_ = rows[used], low_[used]
                if not len(rows):
                    continue
            self.computed += len(rows) * len(cols)
            d = self.space.of_products(self.q[rows] @ vectors[cols].T, self.square[rows][:, None])
            if child[0] >= 0:
                bound = np.maximum(d - radius[cols], low_[:, None])
                near = bound <= within[rows][:, None]
                for j in np.flatnonzero(near.any(0)):
                    to = near[:, j]
                    push(tree, int(child[cols[j]]), rows[to], bound[to, j], d[to, j])
            else:
                a, b = np.nonzero(d <= within[rows][:, None])
                self._found(rows[a], products(self.q[rows[a]], vectors[cols[b]]), ids, first[cols[b]], copies[cols[b]])

    def _found(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, first: np.ndarray, copies: np.ndarray) -> None:
        ready = score >= self.score[row, -1]
        row, score, first, copies = row[ready], score[ready], first[ready], copies[ready]
        i = ids[np.repeat(first, copies) + np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)]
        row, score = np.repeat(row, copies), np.repeat(score, copies)
        other = i != self.own[row]
        touched, at = np.unique(row[other], return_inverse=True)
        if not len(touched):
            return
        at = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at.reshape(-1)])
        s = np.concatenate([self.score[touched].reshape(-1), score[other]])
        i = np.concatenate([self.id[touched].reshape(-1), i[other]])
        order = np.lexsort((i, ~s, at))
        size = np.bincount(at)
        take = order[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) < self.k]
        self.score[touched], self.id[touched] = s[take].reshape(-1, self.k), i[take].reshape(-1, self.k)
        self.limit[touched] = np.minimum(self.limit[touched], self.reach(touched))

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """The distance of the k-th result, infinite without one."""
        last = self.score[rows, -1]
        return np.where(last > _NO_SCORE, self.space.of_products(last.astype(np.float64), self.square[rows]), np.inf)


# --- tables


def _opened(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _written(folder: str, ending: str, write) -> str:
    """A new file, written under another name and moved into place."""
    fs, root = _opened(folder)
    path = f"{root}/{uuid.uuid4().hex}{ending}"
    with fs.open_output_stream(f"{path}.part") as sink:
        write(sink)
    fs.move(f"{path}.part", path)
    return path


def _placed(pivots: np.ndarray, space: Space, width: int, form: str, query: bool):
    """Rows (of the form without pivot and far) with their nearest pivot and its distance."""
    schema = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("metric_tree")
        pe, pn = space.extra(pivots), (pivots * pivots).sum(1)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = matrix(column(part, "v"), width)
                xe = 0.0 if query else space.extra(x)[:, None]
                d = (x * x).sum(1)[:, None] + pn - 2 * x @ pivots.T + (xe - pe) ** 2
                near = d.argmin(1)
                # the radius is made from differences, which round less
                far = np.sqrt(((x - pivots[near]) ** 2).sum(1) + ((0.0 if query else space.extra(x)) - pe[near]) ** 2)
                own = {"pivot": pa.array(near, pa.int32()), "far": pa.array(far)}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else column(part, f.name) for f in schema], schema=schema)

    return run


_TREES = "pivot int, tree string"


def _trees(space: Space, width: int, folder: str):
    schema = arrow_schema(_TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("metric_tree")
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                entries = column(one, "entries").flatten()
                x = matrix(entries.field("v"), width)
                ids = entries.field("ids")
                at, flat = ids.offsets.to_numpy() - ids.offsets.to_numpy()[0], ids.flatten().to_numpy(zero_copy_only=False)
                own = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                path = _written(folder, ".tree", lambda sink, x=x, own=own: stored(x, own, build(x, space), sink))
                yield pa.RecordBatch.from_arrays([column(one, "pivot"), pa.array([path])], schema=schema)

    return run


_BLOCKS = "pivot int, block string"


def _blocks(width: int, folder: str):
    schema = arrow_schema(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                entries = column(one, "entries").flatten()
                q = matrix(entries.field("v"), width)
                rows = pa.RecordBatch.from_arrays([entries.field("query_row"), entries.field("query_id"), pa.array([v.tobytes() for v in q], pa.binary())], ["query_row", "query_id", "vector"])

                def write(sink, rows=rows) -> None:
                    with pa.ipc.new_file(sink, rows.schema) as out:
                        out.write_batch(rows)

                yield pa.RecordBatch.from_arrays([column(one, "pivot"), pa.array([_written(folder, ".block", write)])], schema=schema)

    return run


def _block(folder: str, path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, query ids and vectors of a block."""
    fs, _ = _opened(folder)
    with fs.open_input_file(path) as f:
        b = pa.ipc.open_file(f).get_batch(0)
        q = np.frombuffer(b"".join(column(b, "vector").to_pylist()), np.float64).reshape(-1, width)
        return column(b, "query_row").to_numpy(), column(b, "query_id").to_numpy(), q


_VISITS = "block string, pivot int, low binary, reach binary"


def _visits(pivots: np.ndarray, radii: np.ndarray, space: Space, width: int, folder: str, home: bool):
    """Of each block, the regions to visit: its own, or all others that may hold something within the reach of some query."""
    schema = arrow_schema(_VISITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, _, q = _block(folder, row["block"], width)
                square = (q * q).sum(1)
                reach = np.full(len(rows), np.inf)
                if not home and row["found"]:
                    at = {r: i for i, r in enumerate(rows.tolist())}
                    for x in row["found"]:
                        reach[at[x["query_row"]]] = x["reach"]
                slack = SLACK * (1 + np.sqrt(square + space.top))
                low = np.maximum(0.0, space.of_products(q @ pivots.T, square[:, None]) - radii - slack[:, None])
                out = []
                for p in [row["pivot"]] if home else [int(i) for i in np.flatnonzero(radii >= 0) if i != row["pivot"]]:
                    own = np.where(low[:, p] <= reach + slack, low[:, p], np.inf)
                    if np.isfinite(own).any():
                        out.append({"block": row["block"], "pivot": p, "low": own.tobytes(), "reach": reach.tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_FOUND = "block string, query_row long, query_id long, vec_id long, score long, reach double"


def _searched(space: Space, width: int, k: int, folder: str):
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("metric_tree")
        fs, _ = _opened(folder)
        for batch in batches:
            for unit in batch.to_pylist():
                rows, own, q = _block(folder, unit["block"], width)
                search = Search(space, q, own, k, np.frombuffer(unit["reach"], np.float64))
                search.run([Tree(fs.open_input_file(t["tree"]), width) for t in unit["trees"]], [np.frombuffer(t["low"], np.float64) for t in unit["trees"]])
                at, place = np.nonzero(search.score > _NO_SCORE)
                if len(at):
                    reach = search.reach(np.arange(len(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array([unit["block"]] * len(at)), pa.array(rows[at]), pa.array(own[at]), pa.array(search.id[at, place]), pa.array(search.score[at, place]), pa.array(reach[at])], schema=schema)

    return run


def _dealt(rows: DataFrame, size: int, entry: list[str]) -> DataFrame:
    """rows (pivot, v, ...) in groups of about `size` of one pivot: pivot, entries."""
    counts = rows.groupBy("pivot").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(counts), "pivot")  # a row for each of at most PIVOTS regions
    return dealt.groupBy("pivot", F.pmod(F.xxhash64(*entry), F.col("parts")).alias("part")).agg(F.collect_list(F.struct(*entry)).alias("entries"))


def index(vectors: DataFrame, folder: str, k: int = K) -> tuple[DataFrame, np.ndarray, np.ndarray, Space, int]:
    """vectors (vec_id, v) as trees: (pivot, tree: its file), the pivots, their regions' radii, the metric, the width."""
    copies = vectors.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ranked = copies.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    distinct = materialise(ranked.groupBy("v").agg(ids.alias("ids")), folder)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top, width = distinct.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    space, width = Space(top or 0.0), width or 1
    chosen = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, -(-n // TREE) or 1)).toArrow().column("v").combine_chunks()
    pivots = matrix(chosen, width) if len(chosen) else np.zeros((1, width))
    form = "pivot int, far double, v array<double>, ids array<long>"
    placed = materialise(distinct.mapInArrow(_placed(pivots, space, width, form, False), form), folder)
    radii = np.full(len(pivots), -1.0)
    for r in placed.groupBy("pivot").agg(F.max("far").alias("far")).collect():  # a row for each of at most PIVOTS regions
        radii[r["pivot"]] = r["far"]
    trees = materialise(_dealt(placed, TREE, ["v", "ids"]).mapInArrow(_trees(space, width, folder), _TREES), folder)
    return trees, pivots, radii, space, width


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, folder: str | None = None) -> DataFrame:
    """vectors (vec_id, v), queries (query_id, v), v of integers as doubles: query_row, query_id, rank, vec_id, score of each query's k best."""
    ship(vectors.sparkSession)
    folder = folder or scratch(vectors.sparkSession)
    trees, pivots, radii, space, width = index(vectors, folder, k)
    form = "pivot int, query_row long, query_id long, v array<double>"
    asked = queries.select("query_id", "v").withColumn("query_row", F.monotonically_increasing_id())
    asked = materialise(asked.mapInArrow(_placed(pivots, space, width, form, True), form), folder)
    blocks = materialise(_dealt(asked, QUERIES, ["query_row", "query_id", "v"]).mapInArrow(_blocks(width, folder), _BLOCKS), folder)
    # trees that a block visits are searched together, about FOREST at a time
    chunks = trees.agg(F.ceil(F.count("*") / FOREST).cast("int").alias("chunks"))

    def visit(rows: DataFrame, home: bool) -> DataFrame:
        visits = rows.mapInArrow(_visits(pivots, radii, space, width, folder, home), _VISITS)
        each = visits.join(trees, "pivot").crossJoin(F.broadcast(chunks))  # one row
        each = each.withColumn("chunk", F.pmod(F.xxhash64("tree"), F.greatest(F.col("chunks"), F.lit(1))))
        units = each.groupBy("block", "chunk").agg(F.first("reach").alias("reach"), F.collect_list(F.struct("tree", "low")).alias("trees"))
        # small rows that stand for much work: dealt one by one, not by their size
        units = units.drop("chunk").repartition(partitions(rows.sparkSession))
        return materialise(units.mapInArrow(_searched(space, width, k, folder), _FOUND), folder)

    first = visit(blocks, True)
    reach = first.groupBy("block", "query_row").agg(F.min("reach").alias("reach"))
    reach = reach.groupBy("block").agg(F.collect_list(F.struct("query_row", "reach")).alias("found"))
    second = visit(blocks.join(reach, "block", "left"), False)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    every = first.unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return every.select("query_row", "query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Of each row whose vec_id is divisible by `every`, the k best of all others."""
    folder = scratch(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled().alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    vectors = materialise(rows, folder)
    queries = vectors.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return top_k(vectors, queries, k, folder).select("query_id", "rank", "vec_id", "score")
