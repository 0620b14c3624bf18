"""Near duplicates by DartMinHash: sparse weighted signatures, banded joining, and exact checks of whole texts.

A document is a weighted set of shingles of five words. Hashed darts fall into the plane of weight and rank, one for each
unit of area; each shingle keeps the darts below its weight, for ranks below a bound that yields about as many darts as
the signature needs, and every coordinate of the signature is the earliest dart dealt to it. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity. Work grows with shingles plus darts, not with
their product: regions of the plane are drawn as wholes, by a Poisson count from a hash.

Documents with equal words are one. Others meet in buckets, by hashes of ROWS coordinates in each of BANDS bands. A
bucket's pairs are not formed: each member is held against the bucket's hub, the member that shares most buckets with
others, and links join members into classes. Then whatever is outside the largest class of a bucket is held against all
members of such buckets that are of another class, found by their rarest shingles: an exact filter, so no link between
classes is lost, and one that keeps sets apart whose likeness is in common passages. A sketch of one byte for each
coordinate drops hopeless pairs; the others' whole shingle sets decide.

Defined results: null and wordless texts are alike to nothing, each is its own class; a text of fewer than five words is
one shingle; a class is named by its least doc_id, null if all are null; that row stays, the first of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.components import components
from gleaner.llm.exact_dedup import candidates
from gleaner.llm.shared import arrow_schema, column, materialise, mixed, pack, pieces, row_key, scratch, ship, unpack, utf8, word_hashes, words, working_for

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^24 = 0.0007.
BANDS, ROWS = 24, 6
#: Pairs whose sketches agree in a smaller share are dropped: 0.8 lies 5 standard deviations above.
SKETCHED = 0.63
#: Pairs with one second member that share a copy of its shingles.
SALTED = 64

_RANK_BITS = 44
_LOW = (0.0, 2.0**-12, 2.0**-8, 2.0**-4, 1.0)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: hashes of their shingles (not distinct) and the rows of these, and two hashes of each row's words."""
    starts, ends, row = words(data, at)
    h = word_hashes(data, starts, ends)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[row] if len(h) else np.zeros(0, np.int64)
    out = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k if k else None] = mixed(h[k:], 100 + k)
        out += np.where(place + k < n[row], part, np.uint64(0))
    keep = (place + WORDS <= n[row]) | ((place == 0) & (n[row] < WORDS))
    whole = [np.zeros(len(at) - 1, np.uint64) for _ in range(2)]
    full = n > 0
    if full.any():
        for k, w in enumerate(whole):
            w[full] = np.add.reduceat(mixed(h + mixed(place.astype(np.uint64), 200 + k), 300 + k), first[full])
    return mixed(out[keep], 5), row[keep], whole[0], whole[1]


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, elements (_RANK_BITS of the hash) and multiplicities of the distinct elements of each row."""
    key = (row.astype(np.uint64) << np.uint64(_RANK_BITS)) | (h >> np.uint64(64 - _RANK_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first] >> np.uint64(_RANK_BITS)).astype(np.int64), key[first] & np.uint64((1 << _RANK_BITS) - 1), np.diff(np.append(first, len(key)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts."""
    p = np.exp(-area)
    out = [p]
    for k in range(1, 24):
        p *= area / k
        out.append(out[-1] + p)
    return np.array(out)


def darts(element: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts with a weight below the element's and a rank below its bound: element's index, rank, coordinate."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top_rank, top_weight = float(bound.max(initial=0)), float(weight.max(initial=0))
    ranks = [*_LOW]
    while ranks[-1] < top_rank:
        ranks.append(ranks[-1] * 2)
    steps = [0.0, 1.0]
    while steps[-1] < top_weight:
        steps.append(steps[-1] * 2)
    for i, (low, high) in enumerate(zip(ranks[:-1], ranks[1:], strict=True)):
        for j, (light, heavy) in enumerate(zip(steps[:-1], steps[1:], strict=True)):
            here = np.flatnonzero((bound > low) & (weight > light))
            if not len(here):
                continue
            area = (high - low) * (heavy - light)
            cells = max(1, int(np.ceil(area)))
            wide = (high - low) / cells
            cdf = _poisson(area / cells)
            used = np.minimum(cells, np.ceil((bound[here] - low) / wide)).astype(np.int64)
            own = np.repeat(here, used)
            cell = np.arange(len(own)) - np.repeat(np.cumsum(used) - used, used)
            seed = mixed(element[own] + mixed(cell.astype(np.uint64), 1000 + 64 * i + j), 7)
            n = np.searchsorted(cdf, _uniform(mixed(seed, 8)))
            own, cell, seed = np.repeat(own, n), np.repeat(cell, n), np.repeat(seed, n)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            seed = mixed(seed + nth.astype(np.uint64), 9)
            rank = low + (cell + _uniform(mixed(seed, 10))) * wide
            keep = (rank < bound[own]) & (light + _uniform(mixed(seed, 11)) * (heavy - light) < weight[own])
            found.append((own[keep], rank[keep], (mixed(seed, 12)[keep] % np.uint64(k)).astype(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n by k: of each row with elements the earliest dart of each coordinate, named by its rank; 0 in rows without any."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(row, weight, minlength=n)
    scale = np.full(n, k * np.log(k) + 3.0 * k)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[row])
        bound = (scale / np.maximum(total, 1e-300))[row[own]]
        of, rank, coordinate = darts(element[own], weight[own], bound, k)
        key = ((row[own][of] * k + coordinate).astype(np.uint64) << np.uint64(_RANK_BITS)) | (rank.view(np.uint64) >> np.uint64(64 - _RANK_BITS))
        key.sort()
        slot = (key >> np.uint64(_RANK_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        got = np.bincount(slot[first] // k, minlength=n)
        done = todo & (got == k)
        take = first[done[slot[first] // k]]
        out.reshape(-1)[slot[take]] = key[take] & np.uint64((1 << _RANK_BITS) - 1)
        todo &= ~done
        scale[todo] *= 2
    return out


_SIGNED = "doc_id long, key long, n long, c1 long, c2 long, bands array<long>, sketch binary"


def _signed(counted: bool):
    schema = arrow_schema(_SIGNED)
    k = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("near_dedup")
        for batch in pieces(batches, "text"):
            rows = batch.num_rows
            h, row, c1, c2 = shingles(*utf8(column(batch, "text")))
            row, element, times = distinct(row, h)
            weight = times.astype(float) if counted else np.ones(len(times))
            sig = signatures(row, element, weight, rows, k)
            band = np.zeros((rows, BANDS), np.uint64)
            for i in range(ROWS):
                band = mixed(band + sig[:, i::ROWS], 400 + i)
            band = mixed(band + np.arange(BANDS, dtype=np.uint64), 500)
            n = np.bincount(row, weight, minlength=rows).astype(np.int64)
            at = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]), pa.int32()), pa.array(band[n > 0].reshape(-1).view(np.int64)), type=schema.field("bands").type)
            sketch = mixed(sig, 600).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "key"), pa.array(n), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists, pa.array([sketch[i * k : (i + 1) * k] for i in range(rows)], pa.binary())], schema=schema)

    return run


def _sets(counted: bool):
    """Whole shingle sets: sorted hashes of 64 bits, and multiplicities."""
    schema = arrow_schema("uid long, items binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, row, _, _ = shingles(*utf8(column(batch, "text")))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            items, times = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own, n = np.unique(h[a:b], return_counts=True)
                items.append(pack(own, True))
                times.append(pack(n if counted else np.ones(0)))
            yield pa.RecordBatch.from_arrays([column(batch, "uid"), pa.array(items, pa.binary()), pa.array(times, pa.binary())], schema=schema)

    return run


def jaccard(a: np.ndarray, b: np.ndarray, times_a: np.ndarray | None = None, times_b: np.ndarray | None = None) -> float:
    """Of two sorted sets, weighted if multiplicities are given."""
    if times_a is None:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared / max(1, len(a) + len(b) - shared)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = int(np.minimum(times_a[i], times_b[j]).sum())
    return least / max(1, int(times_a.sum()) + int(times_b.sum()) - least)


def _alike(similarity: float, counted: bool):
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for batch in batches:
            out = []
            for a, b, x, nx, y, ny in zip(*(column(batch, c).to_pylist() for c in ("a", "b", "items", "times", "hub_items", "hub_times")), strict=True):
                if held[0] != b:
                    held = (b, unpack(y), unpack(ny) if counted else None)
                if jaccard(unpack(x), held[1], unpack(nx) if counted else None, held[2]) >= similarity - 1e-12:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], pa.int64()) for i in range(2)], schema=schema)

    return run


def _sketch_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = BANDS * ROWS
    schema = arrow_schema("a long, b long")
    for batch in batches:
        x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(-1, k) for c in ("x", "y"))
        keep = pa.array((x == y).mean(1) >= SKETCHED)
        yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], schema=schema)


def _classes_of(links: DataFrame, folder: str) -> DataFrame:
    """Labels (uid, label) of rows with a link."""
    return components(links, folder).select(F.col("node").alias("uid"), "label")


def _elements(counted: bool):
    """Each element of a set as a row; the copies of a counted shingle are elements of their own."""
    schema = arrow_schema("uid long, item long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, items, times in zip(*(column(batch, c).to_pylist() for c in ("uid", "items", "times")), strict=True):
                own = unpack(items)
                if counted:
                    n = unpack(times).astype(np.int64)
                    own = mixed(np.repeat(own, n) + mixed((np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64), 700), 701)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), uid)), pa.array(own.view(np.int64))], schema=schema)

    return run


def _by_prefix(rows: DataFrame, sets: DataFrame, similarity: float, counted: bool, folder: str) -> DataFrame:
    """rows (uid, label, n, outside): all pairs (a, b) of different labels, one of them outside, that can be alike.

    Two sets of similarity s, of sizes n and m, share an element among the first n - ceil(s n) + 1 and the first
    m - ceil(s m) + 1 of them in any order that is the same for all; rare elements come first, so few sets meet.
    """
    elements = materialise(sets.join(rows.select("uid"), "uid", "left_semi").mapInArrow(_elements(counted), "uid long, item long"), folder)
    often = elements.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = elements.join(often, "item", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    order = Window.partitionBy("uid").orderBy("df", "item")
    prefix = ranked.withColumn("place", F.row_number().over(order)).join(rows, "uid").filter(F.col("place") <= F.col("n") - F.ceil(F.lit(similarity - 1e-9) * F.col("n")) + 1)
    # an element that no other set has can't be met
    prefix = materialise(prefix.filter("df > 1").select("uid", "label", "n", "outside", "item", "place"), folder)
    theirs = prefix.select("item", F.col("uid").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"), F.col("outside").alias("hub_outside"), F.col("place").alias("hub_place"))
    close = F.least("n", "hub_n") >= F.lit(similarity) * F.greatest("n", "hub_n") - F.lit(1e-9)
    once = ~F.col("hub_outside") | (F.col("uid") < F.col("hub"))
    # behind the first element that both have, the shorter rest bounds what they can share
    need = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("hub_n")) - F.lit(1e-6)
    enough = 1 + F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place")) >= need
    met = prefix.filter("outside").join(theirs, "item").filter((F.col("label") != F.col("hub_label")) & once & close & enough)
    return materialise(met.select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct(), folder)


def _linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float, counted: bool, folder: str) -> DataFrame:
    """Of pairs (a, b), those whose whole sets are alike. The set of b goes to one task for each SALTED of its pairs."""
    sketched = pairs.join(sketches.select(F.col("uid").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("uid").alias("b"), F.col("sketch").alias("y")), "b")
    kept = materialise(sketched.mapInArrow(_sketch_alike, "a long, b long"), folder)
    salts = kept.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    hubs = salts.join(sets.select(F.col("uid").alias("b"), F.col("items").alias("hub_items"), F.col("times").alias("hub_times")), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    own = kept.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts").join(sets.withColumnRenamed("uid", "a"), "a")
    return materialise(own.join(hubs, ["b", "salt"]).mapInArrow(_alike(similarity, counted), "a long, b long"), folder)


def classes(docs: DataFrame, similarity: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """A row per row of docs: uid, doc_id, key, class_id (the least doc_id of its class), class_size, kept.

    counted: shingles weigh as often as they occur; else 1, and the similarity is that of sets.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    signed = materialise(rows.mapInArrow(_signed(counted), _SIGNED).withColumn("uid", F.monotonically_increasing_id()), folder)
    # small tables are written before they are joined, so that one text or bucket with very many rows can be split there
    alike = materialise(signed.filter("n > 0").groupBy("c1", "c2").agg(F.min("uid").alias("rep")), folder)
    reps = materialise(signed.join(alike, signed.uid == alike.rep, "left_semi"), folder)
    exploded = reps.select("uid", "n", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialise(exploded.join(materialise(shared, folder), "bucket"), folder)
    central = members.groupBy("uid").agg(F.sum("size").alias("central"))
    members = materialise(members.join(central, "uid").drop("size"), folder)
    known = reps.join(central, "uid", "left_semi").select("uid", "doc_id", "key")
    texts = candidates(docs, known).withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key").dropDuplicates(["_id", "_key"])
    found = known.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    sets = materialise(found.select("uid", "text").mapInArrow(_sets(counted), "uid long, items binary, times binary"), folder)
    sketches = reps.select("uid", "sketch")

    close = F.least("n", "hub_n") >= F.lit(similarity) * F.greatest("n", "hub_n") - F.lit(1e-9)
    # each member against its bucket's hub
    hubs = members.groupBy("bucket").agg(F.max_by(F.struct(F.col("uid").alias("hub"), F.col("n").alias("hub_n")), F.struct("central", F.xxhash64("uid"))).alias("h"), F.count("*").alias("size")).select("bucket", "size", "h.*")
    met = materialise(members.join(materialise(hubs, folder), "bucket"), folder)
    pairs = met.filter((F.col("uid") != F.col("hub")) & close).select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
    linked = _linked(pairs, sketches, sets, similarity, counted, folder)
    labels = _classes_of(linked, folder)
    # what is outside the largest class of a bucket of three and more, against all of such buckets
    now = met.filter("size > 2").select("bucket", "uid", "n").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    counts = now.groupBy("bucket", "label").agg(F.count("*").alias("own")).groupBy("bucket").agg(F.max(F.struct("own", "label")).alias("main"), F.sum("own").alias("all"))
    open_ = now.join(materialise(counts.filter("main.own < all").select("bucket", F.col("main.label").alias("main")), folder), "bucket")
    left = materialise(open_.groupBy("uid", "label", "n").agg(F.bool_or(F.col("label") != F.col("main")).alias("outside")), folder)
    pairs = _by_prefix(left, sets, similarity, counted, folder)
    linked = linked.unionByName(_linked(pairs, sketches, sets, similarity, counted, folder))
    labels = _classes_of(linked, folder)
    named = signed.join(alike, ["c1", "c2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("uid")))
    out = named.select("uid", "doc_id", "key", "rep").join(labels.withColumnRenamed("uid", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    out = materialise(out.select("uid", "doc_id", "key", "label"), folder)
    per_class = out.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")).alias("first"))
    # written first, so that a class with many rows can be split in the join
    return out.join(materialise(per_class, folder), "label").select("uid", "doc_id", "key", "class_id", "class_size", (F.col("uid") == F.col("first.uid")).alias("kept"))


def decisions(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "class_size", "kept")
