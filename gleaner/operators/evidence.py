"""Sets of evidence: coverage, redundancy, scores, bridges, the beam, filling, packing, sentences, decision and contract.

A state is a row (qid, sid, blocks: the ordered block_ix of its set). All states of all questions go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.wordlists import AUTHORITY, BEAM, BRIDGES, COVER_CORE, COVER_OTHER, FILL, FRAGMENTS, POOL
from gleaner.operators.index import Index


def authority_weight(authority: Column) -> Column:
    out = F.lit(1.0)
    for name, w in AUTHORITY.items():
        out = F.when(authority == name, w).otherwise(out)
    return out


def members(states: DataFrame) -> DataFrame:
    """qid, sid, block_ix."""
    return states.select("qid", "sid", F.explode("blocks").alias("block_ix"))


def coverage(states: DataFrame, reqs: DataFrame, index: Index) -> DataFrame:
    """qid, sid, rid, kind, mandatory, coverage, supported of each state and requirement.

    The share of the terms' idf that the state's bodies hold; for `causal` at most a third of the markers found; for
    `contraste` 0 unless two documents take part. Terms that no block has weigh as their idf with df 0.
    """
    terms = reqs.select("qid", "rid", "kind", "mandatory", F.explode_outer(F.array_distinct("terms")).alias("term"), F.lit(False).alias("marker"))
    marks = reqs.select("qid", "rid", "kind", "mandatory", F.explode("markers").alias("term"), F.lit(True).alias("marker")).distinct()
    wanted = terms.unionByName(marks).join(index.cover_idf, "term", "left")
    wanted = wanted.withColumn("idf", F.when(F.col("term").isNotNull(), F.coalesce("idf", F.log(F.lit(index.size[0] + 1.0)) + 1)))
    mine = members(states)
    held = mine.join(index.blocks.select("block_ix", "doc_id", "terms"), "block_ix")
    present = held.select("qid", "sid", F.explode(F.array_distinct("terms")).alias("term")).distinct().withColumn("here", F.lit(True))
    docs = held.groupBy("qid", "sid").agg(F.countDistinct("doc_id").alias("docs"))
    pairs = states.select("qid", "sid").join(wanted, "qid").join(present, ["qid", "sid", "term"], "left")
    hit, own = F.coalesce("here", F.lit(False)), ~F.col("marker")
    sums = pairs.groupBy("qid", "sid", "rid", "kind", "mandatory").agg(
        F.sum(F.when(own, F.col("idf"))).alias("all"), F.sum(F.when(own & hit, F.col("idf")).otherwise(0.0)).alias("found"),
        F.count_if(F.col("marker") & hit).alias("marks"),
    )
    base = F.coalesce(F.col("found") / F.col("all"), F.lit(0.0))
    joined = sums.join(docs, ["qid", "sid"], "left")
    value = F.when(F.col("kind") == "causal", F.least(base, F.least(F.lit(1.0), F.col("marks") / 3.0))).when((F.col("kind") == "contraste") & (F.coalesce("docs", F.lit(0)) < 2), 0.0).otherwise(base)
    out = joined.select("qid", "sid", "rid", "kind", "mandatory", F.round(value, 9).alias("coverage"))
    return out.withColumn("supported", F.col("coverage") >= F.when(F.col("kind") == "nucleo", COVER_CORE).otherwise(COVER_OTHER))


def bags(blocks: DataFrame, index: Index) -> DataFrame:
    """block_ix, bag: the distinct tokens of the bodies of the given blocks."""
    return blocks.select("block_ix").distinct().join(index.blocks.select("block_ix", "terms"), "block_ix").select("block_ix", F.array_distinct("terms").alias("bag"))


def redundancy(states: DataFrame, index: Index) -> DataFrame:
    """qid, sid, redundancy: the mean Jaccard similarity of the state's pairs; states hold a few blocks."""
    mine = members(states)
    with_bags = mine.join(bags(mine, index), "block_ix").groupBy("qid", "sid").agg(F.collect_list("bag").alias("bags"))
    n = F.size("bags")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i), lambda j: X.set_jaccard(F.get("bags", i), F.get("bags", j)))))
    mean = F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (n * (n - 1) / 2)).otherwise(0.0)
    return states.select("qid", "sid").join(with_bags, ["qid", "sid"], "left").select("qid", "sid", F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("redundancy"))


def _four(value: Column) -> Column:
    """Four places, by way of nine: sums of equal parts in another order must not fall to two sides of a half."""
    return F.round(F.round(value, 9), 4)


def set_score(states: DataFrame, reqs: DataFrame, index: Index, scores: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """qid, sid, feasible, worst, mean, precision. scores: qid, block_ix, score. plan: also neighbours and budget count (final ranking)."""
    covered = coverage(states, reqs, index).groupBy("qid", "sid").agg(
        F.coalesce(F.min(F.when(F.col("mandatory"), F.col("coverage"))), F.lit(0.0)).alias("worst"), F.avg("coverage").alias("mean"),
    )
    mine = members(states).join(index.blocks.select("block_ix", "doc_id", "authority", "tokens"), "block_ix").join(scores.select("qid", "block_ix", "score"), ["qid", "block_ix"], "left")
    shape = mine.groupBy("qid", "sid").agg(
        (F.countDistinct("doc_id") / F.count("*")).alias("diversity"), F.avg(authority_weight(F.col("authority"))).alias("authority"),
        F.avg(F.coalesce("score", F.lit(0.0))).alias("base"), F.sum("tokens").alias("tokens"), F.count("*").alias("size"),
    )
    rows = covered.join(shape, ["qid", "sid"]).join(redundancy(states, index), ["qid", "sid"])
    precision = _four(0.45 * F.col("diversity") + 0.30 * F.col("authority") + 0.25 * F.least(F.col("base") * 60, F.lit(1.0)) - 0.40 * F.col("redundancy"))
    rows = rows.withColumn("precision", precision)
    if plan is not None:
        near = index.blocks.select("block_ix", "previous", "next")
        joined = members(states).join(near, "block_ix").join(states.select("qid", "sid", "blocks"), ["qid", "sid"])
        touching = joined.groupBy("qid", "sid").agg(F.count_if(F.coalesce(F.array_contains("blocks", F.col("previous")), F.lit(False)) | F.coalesce(F.array_contains("blocks", F.col("next")), F.lit(False))).alias("touching"))
        over = F.greatest(F.lit(0.0), (F.col("tokens") - F.col("budget")) / F.greatest(F.col("budget"), F.lit(1)))
        rows = rows.join(touching, ["qid", "sid"]).join(plan.select("qid", "budget"), "qid")
        rows = rows.withColumn("precision", _four(F.col("precision") + 0.12 * F.col("touching") / F.col("size") - 0.35 * F.least(over, F.lit(1.0))))
    return rows.select("qid", "sid", (F.col("worst") > 0).cast("int").alias("feasible"), _four(F.col("worst")).alias("worst"), _four(F.col("mean")).alias("mean"), "precision")


def bridges(scores: DataFrame, states: DataFrame, n: int = BRIDGES) -> DataFrame:
    """qid, sid, bridge, place: the n best blocks outside each state, by score and block_ix from above."""
    free = states.join(scores.select("qid", "block_ix", "score"), "qid").filter(~F.array_contains("blocks", F.col("block_ix")))
    order = Window.partitionBy("qid", "sid").orderBy(F.desc("score"), F.desc("block_ix"))
    return free.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("qid", "sid", F.col("block_ix").alias("bridge"), "place")


def condition(front: DataFrame, pairs: DataFrame, reqs: DataFrame, index: Index, n: int = POOL) -> DataFrame:
    """Usefulness of candidates given a bridge: front (fid, block_ix, score, first), pairs (fid, qid, rid, bridge).

    Returns fid, bridge, block_ix, place, useful: half a point for a neighbour of the bridge, .2 for its document, .3 of
    the Jaccard similarity (-.3 from .6 on), .15 for each term of the requirement that the bridge lacks.
    """
    near = index.blocks.select(F.col("block_ix").alias("bridge"), F.col("doc_id").alias("bridge_doc"), "previous", "next")
    seen = front.select("block_ix").unionByName(pairs.select(F.col("bridge").alias("block_ix")))
    own = bags(seen, index)
    rows = pairs.join(front, "fid").filter("block_ix <> bridge").join(near, "bridge")
    rows = rows.join(own, "block_ix").join(own.select(F.col("block_ix").alias("bridge"), F.col("bag").alias("bridge_bag")), "bridge")
    rows = rows.join(index.blocks.select("block_ix", "doc_id"), "block_ix").join(reqs.select("qid", "rid", "terms"), ["qid", "rid"])
    j = X.set_jaccard(F.col("bag"), F.col("bridge_bag"))
    once = F.transform(F.array(j), lambda x: F.when(x < 0.6, 0.3 * x).otherwise(-0.3))[0]  # the similarity is computed once
    both = (F.size("bag") > 0) & (F.size("bridge_bag") > 0)
    bonus = (
        F.when((F.col("block_ix") == F.col("previous")) | (F.col("block_ix") == F.col("next")), 0.5).otherwise(0.0)
        + F.when(F.col("doc_id") == F.col("bridge_doc"), 0.2).otherwise(0.0)
        + F.when(both, once).otherwise(0.0)
        + 0.15 * F.size(F.array_except(F.array_intersect("terms", "bag"), "bridge_bag"))
    )
    scored = rows.withColumn("useful", F.round(F.col("score") + bonus, 9))
    order = Window.partitionBy("fid", "bridge").orderBy(F.desc("useful"), "first", "block_ix")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("fid", "qid", "rid", "bridge", "block_ix", "place", "useful")


def prune(ranked: DataFrame, width: int = BEAM) -> DataFrame:
    """ranked (qid, place, signature): the first half of the beam freely, then one state for each signature, `width` in all."""
    once = F.row_number().over(Window.partitionBy("qid", "signature").orderBy("place"))
    kept = ranked.withColumn("once", once).filter((F.col("place") <= width // 2) | (F.col("once") == 1))
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).filter(F.col("slot") <= width).drop("once")


def residual(terms: Column, markers: Column, kind: Column, covered: Column) -> Column:
    """Terms still to be found: of a causal requirement its first three and six markers not yet seen; else terms not seen, or all."""
    left = F.array_except(terms, covered)
    return F.when(kind == "causal", F.concat(F.slice(terms, 1, 3), F.slice(F.array_except(markers, covered), 1, 6))).otherwise(F.when(F.size(left) > 0, left).otherwise(terms))


def pack(candidates: DataFrame, plan: DataFrame) -> DataFrame:
    """candidates (qid, block_ix, doc_id, tokens, score): those that fit, best first; each document's quota, the budget, the first always.

    A block that doesn't fit is passed over and later ones may fit, so this is a fold over a question's few candidates.
    """
    one = F.struct((-F.col("score")).alias("o"), F.col("block_ix").alias("block_ix"), F.col("doc_id").alias("doc_id"), F.col("tokens").alias("tokens"))
    rows = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("c")).join(plan.select("qid", "budget", "quota"), "qid")
    start = F.expr("named_struct('ix', cast(array() as array<bigint>), 'docs', cast(array() as array<bigint>), 'tokens', cast(0 as bigint), 'dropped', 0)")

    def step(s, x):
        full = F.size(F.filter(s["docs"], lambda d: d == x["doc_id"])) >= F.col("quota")
        over = (s["tokens"] + x["tokens"] > F.col("budget")) & (F.size(s["ix"]) > 0)
        take = ~full & ~over
        named = lambda ix, docs, tokens, dropped: F.struct(ix.alias("ix"), docs.alias("docs"), tokens.alias("tokens"), dropped.alias("dropped"))
        return (
            F.when(take, named(F.array_append(s["ix"], x["block_ix"]), F.array_append(s["docs"], x["doc_id"]), s["tokens"] + x["tokens"], s["dropped"]))
            .when(full, named(s["ix"], s["docs"], s["tokens"], s["dropped"] + 1))
            .otherwise(s)
        )

    folded = rows.select("qid", F.aggregate("c", start, step).alias("s"))
    return folded.select("qid", F.col("s.ix").alias("blocks"), F.col("s.tokens").alias("tokens"), F.col("s.dropped").alias("dropped"))


def fill(states: DataFrame, candidates: DataFrame, plan: DataFrame) -> DataFrame:
    """states (qid, blocks, docs, tokens: of the proof), candidates as in pack(): first blocks of new documents, then any that fit.

    Fragments, quota and 92 % of the budget bound it; narrow questions keep the proof alone.
    """
    one = F.struct((-F.col("score")).alias("o"), F.col("block_ix").alias("block_ix"), F.col("doc_id").alias("doc_id"), F.col("tokens").alias("tokens"))
    more = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("c"))
    rows = states.join(more, "qid", "left").join(plan.select("qid", "budget", "quota", "kind"), "qid")
    most = F.when(F.col("kind") == "puntual", FRAGMENTS["puntual"]).when(F.col("kind") == "amplia", FRAGMENTS["amplia"]).otherwise(FRAGMENTS["conceptual"])
    rows = rows.withColumn("most", most).withColumn("ceiling", F.floor(F.col("budget") * FILL))
    start = F.struct(F.col("blocks").alias("ix"), F.col("docs").alias("docs"), F.col("tokens").cast("long").alias("tokens"))

    def step(fresh: bool):
        def run(s, x):
            mine = F.size(F.filter(s["docs"], lambda d: d == x["doc_id"]))
            ok = (F.size(s["ix"]) < F.col("most")) & ~F.array_contains(s["ix"], x["block_ix"]) & (mine < F.col("quota")) & (s["tokens"] + x["tokens"] <= F.col("ceiling"))
            ok = ok & (mine == 0) if fresh else ok
            return F.when(ok, F.struct(F.array_append(s["ix"], x["block_ix"]).alias("ix"), F.array_append(s["docs"], x["doc_id"]).alias("docs"), (s["tokens"] + x["tokens"]).alias("tokens"))).otherwise(s)

        return run

    none = F.expr("cast(array() as array<struct<o:double,block_ix:bigint,doc_id:bigint,tokens:bigint>>)")
    rows = rows.withColumn("c", F.coalesce("c", none))
    both = F.aggregate("c", F.aggregate("c", start, step(True)), step(False))
    out = rows.withColumn("s", F.when(F.col("kind") == "puntual", start).otherwise(both))
    return out.select("qid", F.col("s.ix").alias("blocks"), F.col("s.tokens").alias("tokens"))


def top_sentences(blocks: DataFrame, reqs: DataFrame, n: int = 3) -> DataFrame:
    """blocks (qid, block_ix, body): sentences with the share of all the question's terms they hold; n best of each block."""
    wanted = reqs.select("qid", F.explode("terms").alias("term")).distinct().groupBy("qid").agg(F.collect_set("term").alias("wanted"))
    each = blocks.select("qid", "block_ix", "body", F.posexplode(X.sentences(F.col("body"))).alias("position", "sentence")).join(wanted, "qid")
    hits = F.size(F.array_intersect(F.array_distinct(X.tokens(F.col("sentence"))), "wanted"))
    scored = each.withColumn("score", F.round(hits / F.size("wanted"), 3)).filter(hits > 0)
    order = Window.partitionBy("qid", "block_ix").orderBy(F.desc("score"), "position")
    best = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    return best.select("qid", "block_ix", "position", "sentence", "score", (F.instr("body", F.col("sentence")) - 1).alias("offset"))


def decision(verified: DataFrame, packages: DataFrame) -> DataFrame:
    """verified (qid, rid, mandatory, supported), packages (qid, n): ANSWER, PARTIAL or INSUFFICIENT, and the share of supported requirements."""
    sums = verified.groupBy("qid").agg(F.bool_and("supported").alias("all"), F.bool_and(~F.col("mandatory") | F.col("supported")).alias("must"), F.round(F.avg(F.col("supported").cast("int")), 3).alias("coverage"))
    said = F.when(F.col("all"), "ANSWER").when(F.col("must") | (F.coalesce("n", F.lit(0)) > 0), "PARTIAL").otherwise("INSUFFICIENT")
    return sums.join(packages, "qid", "left").select("qid", said.alias("decision"), "coverage")


def notices(missing: Column, decided: Column, dropped: Column, scanned: Column, week: Column, found_week: Column) -> Column:
    """What the reader should be told, as an array; missing: ids of requirements without support."""
    each = F.transform(missing, lambda r: F.concat(F.lit("missing:"), r))
    rest = F.array(
        F.when((decided == "PARTIAL") & (F.size(missing) == 0), "no_second_source"), F.when(dropped > 0, F.concat(F.lit("quota:"), dropped.cast("string"))),
        F.when(scanned, "scanned"), F.when(week.isNotNull() & ~found_week, F.concat(F.lit("no_week:"), week.cast("string"))),
    )
    return F.concat(each, F.array_compact(rest))


def contract(question: Column, decided: Column, requirements: Column, evidence: Column) -> Column:
    """The output contract as one struct. requirements: array of struct(rid, terms, mandatory, coverage, supported); evidence: array with `id`."""
    ids = F.transform(evidence, lambda e: e["id"])
    stated = F.transform(
        requirements,
        lambda r: F.struct(
            r["rid"].alias("id"), F.array_join(r["terms"], " ").alias("proposition"), F.when(r["supported"], "SUPPORTED").otherwise("MISSING").alias("status"), r["mandatory"].alias("mandatory"),
            r["coverage"].alias("coverage"), ids.alias("support_ids"),
        ),
    )
    unmet = F.transform(F.filter(requirements, lambda r: ~r["supported"]), lambda r: r["rid"])
    share = F.when(F.size(requirements) > 0, F.round(F.size(F.filter(requirements, lambda r: r["supported"])) / F.size(requirements), 3)).otherwise(0.0)
    return F.struct(decided.alias("decision"), question.alias("question"), stated.alias("requirements"), evidence.alias("evidence"), unmet.alias("unmet_requirements"), F.array().cast("array<string>").alias("contradictions"), share.alias("coverage"))


def invariants(plan: DataFrame, reqs: DataFrame, chosen: DataFrame, index: Index) -> DataFrame:
    """chosen (qid, n, block_ix), best first: of each question whether it has one to four blocks, a named author among the
    first three documents, a structural filter, two documents, two named authors."""
    authors = index.authors.groupBy("doc_id").agg(F.collect_set("term").alias("names"))
    named = reqs.filter("rid = 'r1'").select("qid", "entities")
    rows = chosen.join(index.blocks.select("block_ix", "doc_id"), "block_ix").join(authors, "doc_id", "left").join(named, "qid")
    met = F.array_intersect("entities", F.coalesce("names", F.expr("cast(array() as array<string>)")))
    sums = rows.groupBy("qid").agg(
        F.count("*").alias("blocks"), F.bool_or((F.col("n") <= 3) & (F.size(met) > 0)).alias("author"), F.countDistinct("doc_id").alias("documents"),
        F.size(F.array_distinct(F.flatten(F.collect_list(met)))).alias("authors"),
    )
    no = F.lit(False)
    return plan.select("qid", "filtered").join(sums, "qid", "left").select(
        "qid", F.coalesce(F.col("blocks").between(1, 4), no).alias("few_blocks"), F.coalesce("author", no).alias("author_on_top"), "filtered",
        F.coalesce(F.col("documents") >= 2, no).alias("two_documents"), F.coalesce(F.col("authors") >= 2, no).alias("two_authors"),
    )
