"""Questions to requirements and plans, and the gate that keeps questions out that the corpus doesn't cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.wordlists import (
    ADMIN, ADMIN_STRONG, ADVICE, BROAD, BUDGET, CAUSAL, CAUSAL_MARKERS, COMPARING, GREY_GATE, LEXICAL_GATE, NARROW, QUESTION_WORDS, QUOTA, SIM_HIGH, SIM_LOW, WANTS_ANSWERS,
)
from gleaner.operators import rank
from gleaner.operators.index import Index


def query_type(question: Column) -> Column:
    return (
        F.when(X.has_phrase(question, BROAD), "amplia").when(X.has_phrase(question, CAUSAL), "conceptual")
        .when(X.has_phrase(question, COMPARING), "conceptual").when(X.has_phrase(question, NARROW), "puntual").otherwise("conceptual")
    )


def budget(kind: Column, mode: Column | None = None) -> Column:
    base = F.when(kind == "puntual", BUDGET["puntual"]).when(kind == "amplia", BUDGET["amplia"]).otherwise(BUDGET["conceptual"])
    if mode is None:
        return base
    return (
        F.when(mode == "repasar", F.least(base, F.lit(BUDGET["puntual"])))
        .when(mode.isin("practicar", "evaluar"), F.least(base, F.lit(BUDGET["conceptual"])))
        .when(mode.isin("debate", "explicacion"), F.greatest(base, F.lit(BUDGET["conceptual"])))
        .when(mode == "resumen", F.lit(BUDGET["amplia"]))
        .otherwise(base)
    )


def quota(kind: Column, filtered: Column) -> Column:
    return F.when((kind == "amplia") | filtered, QUOTA + 2).otherwise(QUOTA)


def plans(questions: DataFrame, index: Index) -> DataFrame:
    """questions (qid, question): kind, budget, week and unit (if the index has blocks of them), admin, filtered, quota."""
    q = F.col("question")
    rows = questions.select("qid", "question", query_type(q).alias("kind"), X.has_phrase(q, ADMIN).alias("admin"), X.week_number(q).alias("w"), X.unit_number(q).alias("u"))
    have_week, have_unit = (index.blocks.filter(F.col(c).isNotNull()).select(F.col(c).alias(c[0])).distinct().withColumn(c, F.col(c[0])) for c in ("week", "unit"))
    out = rows.join(have_week, "w", "left").join(have_unit, "u", "left")
    filtered = F.col("week").isNotNull() | F.col("unit").isNotNull()
    return out.select("qid", "question", "kind", budget(F.col("kind")).alias("budget"), "week", "unit", "admin", filtered.alias("filtered"), quota(F.col("kind"), filtered).alias("quota"))


def requirements(plan: DataFrame, index: Index) -> DataFrame:
    """qid, rid, kind (nucleo, causal, contraste), mandatory, terms, markers, entities, question."""
    spark = plan.sparkSession
    from gleaner.sources.corpus import units, weeks

    topics = lambda c: F.slice(F.filter(X.tokens(F.col(c)), lambda t: ~t.isin(QUESTION_WORDS)), 1, 6)
    w = weeks(spark).select("week", topics("topic").alias("of_week"))
    u = units(spark).select("unit", topics("unit_name").alias("of_unit"))
    q = F.col("question")
    none = F.array().cast("array<string>")
    rows = plan.select("qid", "question", "week", "unit", plan["kind"].alias("type"), X.entities(q).alias("e"), X.tokens(q).alias("t"), X.capitalised(q).alias("entities")).join(F.broadcast(w), "week", "left").join(F.broadcast(u), "unit", "left")  # 14 and 2 rows
    more = F.coalesce(F.when(F.size(F.coalesce("of_week", none)) > 0, F.col("of_week")), F.col("of_unit"), none)
    own = F.filter(F.when(F.size("e") > 0, F.slice("e", 1, 8)).otherwise(F.slice("t", 1, 8)), lambda x: ~x.isin("semana", "unidad"))
    all_terms = F.slice(F.concat(own, F.array_except(more, own)), 1, 8)
    rows = rows.withColumn("core", F.when(F.size(all_terms) > 0, all_terms).otherwise(F.slice("t", 1, 8))).withColumn("six", F.slice("e", 1, 6))
    one = lambda rid, kind, must, terms, markers: F.struct(F.lit(rid).alias("rid"), F.lit(kind).alias("kind"), F.lit(must).alias("mandatory"), F.col(terms).alias("terms"), markers.alias("markers"))
    marks = F.array(*map(F.lit, CAUSAL_MARKERS))
    reqs = F.filter(
        F.array(
            one("r1", "nucleo", True, "core", none),
            F.when(X.has_phrase(q, CAUSAL), one("r2", "causal", True, "six", marks)),
            F.when(X.has_phrase(q, COMPARING) | (F.col("type") == "conceptual"), one("r3", "contraste", False, "six", none)),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.select("qid", "question", "entities", F.explode(reqs).alias("r")).select("qid", "question", "r.*", "entities")


def density(reqs: DataFrame, index: Index) -> DataFrame:
    """qid, density: the largest share per thousand of a block's tokens that are terms, over blocks with two different terms."""
    return rank.densest(reqs.filter("rid = 'r1'"), index).select("qid", F.col("score").alias("density"))


def top_ten_mean(reqs: DataFrame, index: Index) -> DataFrame:
    """qid, mean: of the ten best BM25 scores of r1, blocks without a score counted as 0 when fewer than ten have one.

    A negative score can't be among them unless fewer than ten blocks score 0 or more; none is negative here.
    """
    best = rank.bm25(reqs.filter("rid = 'r1'"), index, 10)
    return best.groupBy("qid").agg((F.sum("score") / min(10, max(1, index.size[0]))).alias("mean"))


def gate(plan: DataFrame, reqs: DataFrame, index: Index, similarity: DataFrame | None = None) -> DataFrame:
    """qid, out_of_scope, reason, score. similarity (qid, similarity): the largest to any block, null or absent without vectors."""
    q = F.col("question")
    r1 = reqs.filter("rid = 'r1'").select("qid", "terms", "entities")
    idf = index.stats.filter("body_df > 0").select("term", F.col("body_df").alias("df"))
    unknown = r1.select("qid", F.explode("terms").alias("term")).join(idf, "term", "left").groupBy("qid").agg(F.count_if(F.col("df").isNull()).alias("unknown"))
    authors = index.authors.select("term").distinct()
    named = r1.select("qid", F.explode("entities").alias("term")).join(authors, "term", "left_semi").select("qid").distinct().withColumn("author", F.lit(True))
    rows = plan.join(r1, "qid").join(unknown, "qid", "left").join(named, "qid", "left").join(density(reqs, index), "qid", "left").join(top_ten_mean(reqs, index), "qid", "left")
    rows = rows.join(similarity, "qid", "left") if similarity is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    score = F.round(0.7 * F.coalesce("density", F.lit(0.0)) / 100 + F.coalesce("mean", F.lit(0.0)) / 10, 9)
    rows = rows.withColumn("score", score)
    known_admin = F.col("admin") & X.has_phrase(q, ADMIN_STRONG) & ~X.has_phrase(q, ADVICE)
    reason = (
        F.when(F.col("filtered"), None)
        .when(X.has_phrase(q, WANTS_ANSWERS), "wants_answers")
        .when(F.size("terms") == 0, "no_terms")
        .when(F.coalesce("author", F.lit(False)), None)
        .when(known_admin, None)
        .when(F.coalesce("unknown", F.lit(0)) >= F.greatest(F.lit(2), F.size("terms") - 1), "unknown_terms")
        .when(F.col("similarity").isNull(), F.when(F.col("score") < LEXICAL_GATE, "not_covered"))
        .when(F.col("similarity") >= SIM_HIGH, None)
        .when(F.col("similarity") < SIM_LOW, "other_topic")
        .when(F.col("score") < GREY_GATE, "only_mentioned")
    )
    return rows.select("qid", reason.alias("reason"), "score").select("qid", F.col("reason").isNotNull().alias("out_of_scope"), "reason", "score")
