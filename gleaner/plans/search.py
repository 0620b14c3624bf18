"""Retrieval end to end: gate, frontier, beam search over sets of evidence, filling, packing, decision.

The search is a loop of at most ROUNDS steps over tables; a step is one plan for all states of all questions, written to
a stage table. A question leaves the loop with the first round in which one of its states supports all requirements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.wordlists import ROUNDS
from gleaner.operators import evidence as E
from gleaner.operators import rank
from gleaner.operators.index import Index, of
from gleaner.plans import compile as C
from gleaner.sources.stage import staged


@dataclass
class Found:
    """proof (qid, blocks), union (qid, block_ix, score), frontier (qid, rid, block_ix, score, first), near: the index of all blocks that were met."""

    proof: DataFrame
    union: DataFrame
    frontier: DataFrame
    near: Index


def search(plan: DataFrame, reqs: DataFrame, index: Index, rounds: int = ROUNDS, vectors: rank.Vectors | None = None) -> Found:
    front = staged(rank.frontier(reqs, plan, index, vectors=vectors))
    union = staged(front.groupBy("qid", "block_ix").agg(F.round(F.sum("score"), 12).alias("score")))
    nothing = union.select("qid").distinct().select("qid", F.lit(0).cast("long").alias("sid"), F.expr("cast(array() as array<bigint>)").alias("blocks"))
    first = E.bridges(union, nothing)
    beam = staged(first.select("qid", F.col("place").cast("long").alias("sid"), F.array("bridge").alias("blocks")))
    met, finalists = union.select("block_ix"), None
    near = index.narrowed(met)
    for turn in range(rounds):
        covered = staged(E.coverage(beam, reqs, near))
        missing = covered.filter("mandatory AND NOT supported").select("qid", "sid", "rid")
        complete = beam.join(missing.select("qid", "sid").distinct(), ["qid", "sid"], "left_anti")
        seen = E.members(beam).join(near.blocks.select("block_ix", "terms"), "block_ix").groupBy("qid", "sid").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("terms")))).alias("covered"))
        open_ = missing.join(reqs, ["qid", "rid"]).join(seen, ["qid", "sid"], "left").withColumn("covered", F.coalesce("covered", F.expr("cast(array() as array<string>)")))
        open_ = open_.withColumn("left", E.residual(F.col("terms"), F.col("markers"), F.col("kind"), F.col("covered"))).withColumn("fid", F.concat_ws(":", "qid", "rid", F.xxhash64("left").cast("string")))
        open_ = staged(open_.select("qid", "sid", "rid", "fid", "kind", "question", "entities", "left"))
        asked = open_.dropDuplicates(["fid"]).select("qid", F.col("fid").alias("rid"), "kind", "question", "entities", F.col("left").alias("terms"))
        fronts = rank.frontier(asked, plan, index, vectors=vectors).select(F.col("rid").alias("fid"), "block_ix", "score", "first")
        fronts = staged(fronts)
        met = met.unionByName(fronts.select("block_ix"))
        near = index.narrowed(met)
        over = staged(E.bridges(union, beam))
        pairs = open_.select("qid", "sid", "rid", "fid").join(over, ["qid", "sid"])
        useful = E.condition(fronts, pairs.select("fid", "qid", "rid", "bridge").distinct(), reqs, near).select("fid", "bridge", "block_ix", F.col("place").alias("at"))
        grown = pairs.join(useful, ["fid", "bridge"]).join(beam, ["qid", "sid"]).filter(~F.array_contains("blocks", F.col("block_ix")))
        grown = grown.select("qid", F.array_append("blocks", F.col("block_ix")).alias("blocks"), F.struct("sid", "rid", F.col("place").alias("b"), "at").alias("order"))
        once = Window.partitionBy("qid", F.array_sort("blocks")).orderBy("order")
        states = grown.withColumn("r", F.row_number().over(once)).filter("r = 1").drop("r")
        states = staged(states.withColumn("sid", F.row_number().over(Window.partitionBy("qid").orderBy("order")).cast("long")))
        scored = E.set_score(states, reqs, near, union)
        docs = E.members(states).join(near.blocks.select("block_ix", "doc_id"), "block_ix").groupBy("qid", "sid").agg(F.array_sort(F.collect_set("doc_id")).alias("signature"))
        order = Window.partitionBy("qid").orderBy(F.desc("feasible"), F.desc("worst"), F.desc("mean"), F.desc("precision"), "order")
        ranked = states.join(scored, ["qid", "sid"]).join(docs, ["qid", "sid"]).withColumn("place", F.row_number().over(order))
        kept = E.prune(ranked.select("qid", "blocks", "signature", "place")).select("qid", F.col("slot").cast("long").alias("sid"), "blocks")
        # a question whose states all are complete, or can't grow, keeps its beam and is done
        stuck = beam.join(kept.select("qid").distinct(), "qid", "left_anti")
        after = staged(kept.withColumn("stuck", F.lit(False)).unionByName(stuck.withColumn("stuck", F.lit(True))))
        done = staged(complete.select("qid").unionByName(after.filter("stuck").select("qid")).distinct())
        final = complete.select("qid", F.lit(0).alias("group"), "sid", "blocks").unionByName(after.join(done, "qid", "left_semi").select("qid", F.lit(1).alias("group"), "sid", "blocks"))
        final = staged(final if turn + 1 < rounds else complete.select("qid", F.lit(0).alias("group"), "sid", "blocks").unionByName(after.select("qid", F.lit(1).alias("group"), "sid", "blocks")))
        finalists = final if finalists is None else finalists.unionByName(final)
        beam = staged(after.join(done, "qid", "left_anti").select("qid", "sid", "blocks"))
        if beam.isEmpty():
            break
    numbered = staged(finalists.dropDuplicates(["qid", "group", "sid", "blocks"]).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("group", "sid")).cast("long")).select("qid", F.col("n").alias("sid"), "blocks"))
    scored = E.set_score(numbered, reqs, near, union, plan)
    best = Window.partitionBy("qid").orderBy(F.desc("feasible"), F.desc("worst"), F.desc("mean"), F.desc("precision"), "sid")
    proof = numbered.join(scored, ["qid", "sid"]).withColumn("r", F.row_number().over(best)).filter("r = 1").select("qid", "blocks")
    return Found(staged(proof), union, front, near)


@dataclass
class Retrieved:
    """rows: retrieve()'s; plan, reqs: of all questions; verified: coverage of the proofs of those that were searched."""

    rows: DataFrame
    plan: DataFrame
    reqs: DataFrame
    verified: DataFrame


def retrieve(questions: DataFrame, index: Index, vectors: rank.Vectors | None = None) -> DataFrame:
    """questions (qid, question): decision, coverage, blocks (packed, best first), tokens, dropped, missing requirements, reason.

    vectors: rank and gate questions that have one by it; TF-IDF and the lexical gate serve the others.
    """
    return retrieved(questions, index, vectors).rows


def retrieved(questions: DataFrame, index: Index, vectors: rank.Vectors | None = None) -> Retrieved:
    plan = staged(C.plans(questions, index))
    reqs = staged(C.requirements(plan, index))
    gated = staged(C.gate(plan, reqs, index, rank.similarity(vectors, index) if vectors else None))
    inside = gated.filter("NOT out_of_scope").select("qid")
    plan_in, reqs_in = plan.join(inside, "qid", "left_semi"), reqs.join(inside, "qid", "left_semi")
    found = search(plan_in, reqs_in, index, vectors=vectors)
    about = found.near.blocks.select("block_ix", "doc_id", "tokens")
    pool = found.union.join(about, "block_ix")
    proof = found.proof.withColumn("sid", F.lit(1).cast("long"))
    held = E.members(proof).join(about, "block_ix").groupBy("qid").agg(F.collect_list("doc_id").alias("docs"), F.sum("tokens").alias("tokens"))
    filled = staged(E.fill(found.proof.join(held, "qid"), pool, plan_in))
    chosen = filled.select("qid", F.explode("blocks").alias("block_ix")).join(about, "block_ix").join(found.union, ["qid", "block_ix"])
    packed = E.pack(chosen, plan_in)
    verified = staged(E.coverage(proof, reqs_in, found.near))
    said = E.decision(verified, packed.select("qid", F.size("blocks").alias("n")))
    missing = verified.filter("NOT supported").groupBy("qid").agg(F.array_sort(F.collect_list("rid")).alias("missing"))
    none = F.expr("cast(array() as array<string>)")
    rows = plan.select("qid", "question", "kind").join(gated.select("qid", "reason"), "qid").join(packed, "qid", "left").join(said, "qid", "left").join(missing, "qid", "left")
    rows = rows.select(
        "qid", "question", "kind", "reason", F.coalesce("decision", F.lit("INSUFFICIENT")).alias("decision"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("blocks", F.expr("cast(array() as array<bigint>)")).alias("blocks"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("missing", none).alias("missing"),
    )
    return Retrieved(rows, plan, reqs, verified)


def retrieve_from(spark, folder: str, questions: DataFrame, vectors: rank.Vectors | None = None) -> DataFrame:
    return retrieve(questions, of(spark, folder), vectors)
