"""Evaluation: corpus checks, latencies, confusion matrices, thresholds, ablation, gold recall, costs, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X

PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def corpus_totals(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    d = docs.agg(F.count("*").alias("documents"), F.sum("tokens").alias("doc_tokens"))
    b = blocks.agg(F.count("*").alias("blocks"), F.sum("tokens").alias("block_tokens"))
    return d.crossJoin(b)  # one row each


def totals_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def week_coverage(weeks: DataFrame, docs: DataFrame) -> DataFrame:
    """Every week with its documents and tokens; `exam` weeks are passed over, `ok` above 3000 tokens, `VAC` without any, else `BAJ`."""
    sums = docs.groupBy("week").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    rows = weeks.join(sums, "week", "left").select("week", "topic", F.coalesce("n", F.lit(0)).cast("long").alias("documents"), F.coalesce("t", F.lit(0)).cast("long").alias("tokens"))
    exam = X.normalise(F.col("topic")).contains("examen")
    return rows.select("week", "documents", "tokens", F.when(exam, "exam").when(F.col("tokens") > 3000, "ok").when(F.col("tokens") == 0, "VAC").otherwise("BAJ").alias("status"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def verdict(checks: DataFrame) -> DataFrame:
    """checks (name, severity, n): errors and warnings with n above 0, and whether the corpus is valid, usable or blocked."""
    sums = checks.filter("n > 0").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return sums.withColumn("verdict", F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "usable").otherwise("valid"))


def latency(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Count, interpolated percentiles, mean and largest value."""
    p = F.percentile(value, F.array(*map(F.lit, PERCENTILES)))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), p.alias("p"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return out.select(*keys, "n", *(F.round(F.col("p")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(PERCENTILES)), F.round("mean", 6).alias("mean"), "largest")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; 0 for empty denominators."""
    a, p = F.col(actual), F.col(predicted)
    out = rows.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    out = out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    return out.select(*keys, "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """rows (inside, similarity): for each threshold the inside ones lost and the outside ones let in."""
    return (
        rows.select("inside", "similarity", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("threshold")
        .agg(F.count_if(F.col("inside") & (F.col("similarity") < F.col("threshold"))).alias("lost"), F.count_if(~F.col("inside") & (F.col("similarity") >= F.col("threshold"))).alias("leaked"))
    )


def suggested_cuts(rows: DataFrame) -> DataFrame:
    """low: the least inside similarity less .02, 0 at least; high: the larger of the inside median and the outside element at three quarters."""
    s, inside = F.col("similarity"), F.col("inside")
    # counts of equal similarities, from map-side sums; the element is the first at which the running count passes its place
    counts = rows.filter(~inside & s.isNotNull()).groupBy("similarity").agg(F.count("*").alias("n"))
    # running sums within ranges of similarities, then over the ranges: no task sorts all
    ranged = counts.withColumn("range", F.floor(s * 256))
    before = ranged.groupBy("range").agg(F.sum("n").alias("all"))
    before = before.withColumn("before", F.sum("all").over(Window.orderBy("range")) - F.col("all")).withColumn("total", F.sum("all").over(Window.partitionBy()))  # some hundred rows
    place = F.floor(F.col("total") * 0.75)
    here = before.filter((F.col("before") <= place) & (F.col("before") + F.col("all") > place)).select("range", "before", place.alias("place"))
    running = ranged.join(here, "range").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("similarity")))
    at = running.filter(F.col("upto") > F.col("place")).agg(F.min("similarity").alias("at"))
    agg = rows.agg(F.min(F.when(inside, s)).alias("least"), F.median(F.when(inside, s)).alias("median")).crossJoin(at)  # one row each
    return agg.select(F.round(F.greatest(F.lit(0.0), F.col("least") - 0.02), 6).alias("low"), F.round(F.greatest("at", "median"), 6).alias("high"))


def class_spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.round(f(value), 6).alias(n) for n, f in (("median", F.median), ("least", F.min), ("largest", F.max))))


def overlap(base: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, blocks) twice: mean Jaccard overlap (questions with two empty sets passed over), equal sets, blocks of the other."""
    both = base.join(other.select("qid", F.col("blocks").alias("theirs")), "qid")
    a, b = F.col("blocks"), F.col("theirs")
    union = F.size(F.array_union(a, b))
    same = F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    return both.agg(F.round(F.coalesce(F.avg(F.when(union > 0, F.size(F.array_intersect(a, b)) / union)), F.lit(1.0)), 6).alias("overlap"), F.count_if(same).alias("identical"), F.sum(F.size(b)).alias("fragments"))


def contained(bank: DataFrame, docs: DataFrame, ident: str, item: str, words: int = 4) -> DataFrame:
    """Which texts of bank (ident, text) occur as they are in texts of docs (item, text): ident, item, each pair once.

    The words between a text's first and last blank occur between blanks wherever the text does. So each text is looked
    for by the one of its runs of `words` inner words that is rarest in the documents, and then held against the texts
    found. Only texts of fewer inner words are held against all documents.
    """
    rows = docs.filter("text IS NOT NULL").select(item, "text")
    asked = bank.filter("text IS NOT NULL").select(F.col(ident), F.col("text").alias("sought")).distinct()
    inner = F.slice(F.split("sought", " "), 2, F.greatest(F.lit(0), F.size(F.split("sought", " ")) - 2))
    runs = lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words)))))
    asked = asked.withColumn("runs", runs(inner))
    sought = asked.filter("runs IS NOT NULL").select(ident, "sought", F.explode(F.array_distinct("runs")).alias("run"))
    every = rows.select(item, F.split("text", " ").alias("w")).select(item, F.explode(F.array_distinct(runs(F.col("w")))).alias("run"))
    met = every.join(sought.select("run").distinct(), "run")
    often = met.groupBy("run").agg(F.count("*").alias("df"))
    rarest = sought.join(often, "run", "left").groupBy(ident, "sought").agg(F.min_by("run", F.struct(F.coalesce("df", F.lit(0)), "run")).alias("run"))
    held = met.join(rarest, "run").join(rows, item).filter(F.contains("text", F.col("sought"))).select(ident, item)
    short = rows.join(asked.filter("runs IS NULL").select(ident, "sought"), F.contains("text", F.col("sought"))).select(ident, item)
    return held.unionByName(short).distinct()


def gold_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold and found (qid, item): of each question with gold its recall, precision and whether all gold was found."""
    g = gold.select("qid", "item").distinct().withColumn("g", F.lit(1))
    f = found.select("qid", "item").distinct().withColumn("f", F.lit(1))
    per = g.join(f, ["qid", "item"], "full_outer").groupBy("qid").agg(F.sum("g").alias("gold"), F.sum("f").alias("found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("hits"))
    per = per.filter("gold > 0")
    return per.select("qid", "gold", F.round(F.col("hits") / F.col("gold"), 6).alias("recall"), F.round(ratio(F.col("hits"), F.coalesce("found", F.lit(0))), 6).alias("precision"), (F.col("hits") == F.col("gold")).alias("complete"))


def macro(per_question: DataFrame) -> DataFrame:
    return per_question.agg(F.count("*").alias("questions"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision")), F.round(F.avg(F.col("complete").cast("int")), 6).alias("complete"))


def performance_verdict(p95: Column, failures: Column, inside: Column, outside: Column) -> Column:
    return F.struct((p95 < 1000).alias("fast"), (failures == 0).alias("stable"), (inside >= 0.95).alias("covers"), (outside >= 0.90).alias("abstains"))


def latest(rows: DataFrame, n: int, by: str, at: str, tie: str) -> DataFrame:
    """The n newest rows of each, numbered."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)


def assessment(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (ix, topic, correct): the score of 100 and the first topic right and wrong."""
    order = lambda flag: F.min_by(F.when(flag, F.col("topic")), F.when(flag, F.col("ix")))
    c = F.col("correct")
    return rows.groupBy(*keys).agg(F.round(100 * F.avg(c.cast("int"))).cast("long").alias("score"), order(c).alias("strong"), order(~c).alias("weak"))


def flag_topic(flags: Column, topic: Column) -> Column:
    return F.array_union(flags, F.array(topic))


def clear_topic(flags: Column, topic: Column) -> Column:
    return F.array_remove(flags, topic)


def merge_progress(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of old with the patch's values where it has any; new keys are added."""
    names = [c for c in old.columns if c != key]
    joined = old.alias("o").join(patch.alias("p"), key, "full_outer")
    return joined.select(key, *(F.coalesce(F.col(f"p.{c}"), F.col(f"o.{c}")).alias(c) for c in names))


def profile(calls: DataFrame) -> DataFrame:
    """calls (at, ix, ms, failed): the first call's time, interpolated percentiles, the largest, calls, failures, calls a second."""
    p = F.percentile("ms", F.array(*map(F.lit, PERCENTILES)))
    span = F.timestamp_diff("MICROSECOND", F.min("at"), F.max("at")) / F.lit(1e6)
    out = calls.agg(F.min_by("ms", F.struct("at", "ix")).alias("cold"), p.alias("p"), F.max("ms").alias("largest"), F.count("*").alias("calls"), F.count_if("failed").alias("failures"), span.alias("span"))
    each = [F.round(F.col("p")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(PERCENTILES)]
    return out.select("cold", *each, "largest", "calls", "failures", F.round(F.col("calls") / F.greatest("span", F.lit(1e-9)), 9).alias("per_second"))


def service_health(calls: DataFrame) -> DataFrame:
    """calls (failed): calls, failures, failure rate."""
    return calls.agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures")).withColumn("rate", F.round(ratio(F.col("failures"), F.col("calls")), 6))
