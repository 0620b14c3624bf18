"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Each document draws the exponential key -ln(u) / weight, u from a digest of its id, so reruns agree. A source's target is
met by complete epochs of all its documents and a fraction of one more: the documents with the smallest keys whose
running total comes nearest to what is left. Running totals need no sort of a whole source: totals of narrow key ranges
find the one range in which the budget ends, and only its documents are sorted.

Defined results: a null text has size 0 and is never taken more than its epochs of 0 words; sources in code point order,
null last; documents without a quality weight weigh 1, and so do non-positive or non-finite ones; equal keys go by
smaller doc_id, null last; an empty table gives no rows; a source whose documents are all empty has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import materialise, packed, row_form, row_key, scratch

#: Weights of the sources in their order, repeated; epochs at most; documents of one key range, about.
WEIGHTS, EPOCHS, RANGE = (5, 2, 1), 3, 512
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of a digest of the seed and the id, or of the key of a text without an id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("key").cast("string")))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = EPOCHS, total: Column | None = None) -> DataFrame:
    """sources (source, source_size), a row for each source, with target: shares of the total by weight, none above most * source_size.

    The excess of capped sources is shared anew by weight: in order of most * size / weight, the first k are capped for
    the least k at which the level (what is left over the weights left) is at most the next ratio.
    """
    # a row for each source: windows over all of them are small
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    ranked = sources.withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % len(weights) + 1).cast("int")))
    by = Window.orderBy("ratio", "i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("all", (F.sum("source_size").over(everything) if total is None else total).cast("double"))
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / rest)
    # the first source in this order that is not above its cap sets the level for all behind it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(everything)
    return ranked.withColumn("level", level["level"]).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """A row per row of docs (doc_id, text, source): doc_id, key (its text's), source, size, source_size, target, epochs, chosen, taken.

    quality: doc_id, weight; of several weights of one id the mean counts.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    rows = docs.select("doc_id", "source", word_count().alias("size"), row_key().alias("key"))
    sized = materialise(rows, folder)
    if quality is not None:
        each = quality.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        sized = sized.join(each, "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    weight = F.when((F.col("weight") > 0) & (F.col("weight") < F.lit(float("inf"))), F.col("weight")).otherwise(F.lit(1.0))
    keyed = sized.withColumn("draw", -F.log(uniform(seed)) / weight).drop("weight")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = materialise(targets(sources.drop("n"), weights, most).join(sources.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), folder)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE)).cast("long"))
    named = plan.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "left", "ranges")
    keyed = keyed.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # exp(-draw) falls as the draw rises and is spread over (0, 1)
    keyed = keyed.withColumn("range", F.least(F.col("ranges") - 1, F.floor((F.lit(1.0) - F.exp(-F.col("draw"))) * F.col("ranges"))).cast("long"))
    keyed = materialise(keyed, folder)
    ends = keyed.groupBy("source", "range").agg(F.sum("size").alias("in"), F.first("left").alias("left"))
    # running totals of the ranges, first of blocks of ranges, so that no task holds a whole source's ranges
    ends = ends.withColumn("block", F.floor(F.sqrt(F.lit(1.0) * F.col("range"))))
    blocks = ends.groupBy("source", "block").agg(F.sum("in").alias("in_block"))
    blocks = blocks.withColumn("before_block", F.sum("in_block").over(Window.partitionBy("source").orderBy("block")) - F.col("in_block")).drop("in_block")
    b = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "before_block")
    ends = ends.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    ends = ends.withColumn("before", F.col("before_block") + F.sum("in").over(Window.partitionBy("source", "block").orderBy("range")) - F.col("in"))
    edge = ends.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("in") > F.col("left"))).select(F.col("source").alias("_s"), F.col("range").alias("edge"), "before")
    rows = keyed.join(materialise(edge, folder), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    outside = rows.filter("edge IS NULL OR range <> edge").withColumn("chosen", F.when(F.col("edge").isNull(), (F.col("left") > 0) & (F.col("source_size") > 0)).otherwise(F.col("range") < F.col("edge")))
    order = Window.partitionBy("source").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", "key")
    inside = rows.filter("range = edge").withColumn("total", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a document is chosen while its middle lies within the budget: the total ends at most half a document away
    inside = inside.withColumn("chosen", F.col("total") - F.col("size") / 2 <= F.col("left")).drop("total")
    out = outside.unionByName(inside)
    return out.select("doc_id", "key", "source", "size", "source_size", "target", "epochs", "chosen", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).alias("taken"))


def mixture(docs: DataFrame, quality: DataFrame | None = None, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Other columns may have any names.

    Rows are found by doc_id, source and text. Of several that are the same in these, each comes in every complete epoch
    and those whose columns come first as JSON in the fraction of one more.
    """
    decided = mix(docs, quality, **how).groupBy("doc_id", "source", "key").agg(F.count("*").alias("n"), F.first("epochs").alias("epochs"), F.count_if("chosen").alias("chosen"))
    decided = decided.filter("epochs > 0 OR chosen > 0").select(F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), F.col("key").alias("own_key"), "n", "epochs", "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("source").eqNullSafe(F.col("own_source")) & (F.col("key") == F.col("own_key"))
    found = packed(docs, "doc_id", "source").join(decided, same)
    by = Window.partitionBy("own_id", "own_source", "own_key").orderBy("form")
    more = found.filter("n > 1").withColumn("form", row_form()).withColumn("r", F.row_number().over(by)).withColumn("times", F.col("epochs") + (F.col("r") <= F.col("chosen")).cast("long"))
    every = found.filter("n = 1").select("row", (F.col("epochs") + F.col("chosen")).alias("times")).unionByName(more.select("row", "times"))
    return every.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("row.*")


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 1.5 for good documents, 0.5 for others; unlabelled ones weigh 1."""
    return labels.select("doc_id", (F.lit(0.5) + F.coalesce(F.col("quality").cast("double"), F.lit(0.5))).alias("weight"))
