"""Queries of retrieval: rankings, fusion, plans, the gate, sets of evidence, the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.wordlists import ADMIN, ADMIN_STRONG, ADVICE, BROAD, CAUSAL, CAUSAL_MARKERS, COMPARING, DENSE, DENSE_CUT, NARROW, QUESTION_WORDS, WANTS_ANSWERS
from gleaner.operators import answers as A
from gleaner.operators import dense as D
from gleaner.operators import evaluate as V
from gleaner.operators import evidence as E
from gleaner.operators import index as I
from gleaner.operators import rank as R
from gleaner.plans import compile as C
from gleaner.plans import search as S
from gleaner.plans import service as SV
from gleaner.plans.oracle import has_phrase, quoted, tokens, unique, values, with_tables
from gleaner.plans.registry import ORACLES, query, rows
from gleaner.sources import corpus
from gleaner.sources.stage import staged

#: Questions besides the benchmark's texts: each takes another way through the compiler and the gate.
QUESTIONS = [
    (1001, "¿Por qué cayó la población andina en el siglo XVI?"), (1002, "¿Qué se ve en la semana 3?"), (1003, "Compara las ciudades y los territorios de la unidad 2"),
    (1004, "¿Cuándo es el examen parcial?"), (1005, "Dame las respuestas del examen parcial"), (1006, "¿Qué dice Src7 sobre the tionthe?"),
    (1007, "¿Cuál es la mejor manera de estudiar para el examen?"), (1008, "???"), (1009, "Resume la semana 12: haciendas azucareras y causas"), (1010, "quantum chromodynamics lagrangian"),
]
_Q = f"questions AS (SELECT item_id AS qid, text AS question FROM benchmark UNION ALL SELECT CASE WHEN qid IN (SELECT item_id FROM benchmark) THEN -qid ELSE qid END, question FROM {values(QUESTIONS, 'qid, question')})"


def bank_questions(spark, d):
    return corpus.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("qid"), F.col("text").alias("question"))


def questions(spark, d):
    """The benchmark's texts and QUESTIONS; one of these whose id a benchmark item has takes the negative of it."""
    bank = bank_questions(spark, d)
    taken = bank.filter(F.col("qid").isin([n for n, _ in QUESTIONS])).select("qid").distinct().withColumn("taken", F.lit(True))
    own = rows(spark, QUESTIONS, "qid long, question string").join(F.broadcast(taken), "qid", "left")  # at most one row for each of QUESTIONS
    return bank.unionByName(own.select(F.when(F.col("taken"), -F.col("qid")).otherwise(F.col("qid")).alias("qid"), "question"))


_TYPE = f"CASE WHEN {has_phrase('question', BROAD)} THEN 'amplia' WHEN {has_phrase('question', CAUSAL)} THEN 'conceptual' WHEN {has_phrase('question', COMPARING)} THEN 'conceptual' WHEN {has_phrase('question', NARROW)} THEN 'puntual' ELSE 'conceptual' END"
_NUM = lambda p: f"TRY_CAST(nullif(regexp_extract(strip_accents(lower(question)), '{p}', 1), '') AS INTEGER)"
_PLANS = f"""plans AS MATERIALIZED (SELECT qid, question, kind, CASE kind WHEN 'puntual' THEN 3500 WHEN 'amplia' THEN 14000 ELSE 9000 END AS budget, week, unit, admin, week IS NOT NULL OR unit IS NOT NULL AS filtered,
 CASE WHEN kind = 'amplia' OR week IS NOT NULL OR unit IS NOT NULL THEN 5 ELSE 3 END AS quota FROM (SELECT qid, question, {_TYPE} AS kind, {has_phrase('question', ADMIN)} AS admin,
 CASE WHEN {_NUM('(?:^|[^a-z0-9_])semanas?\\s+(\\d{1,2})(?:$|[^a-z0-9_])')} IN (SELECT week FROM blocks) THEN {_NUM('(?:^|[^a-z0-9_])semanas?\\s+(\\d{1,2})(?:$|[^a-z0-9_])')} END AS week,
 CASE WHEN {_NUM('(?:^|[^a-z0-9_])unidad\\s+(\\d{1,2})(?:$|[^a-z0-9_])')} IN (SELECT unit FROM blocks WHERE unit IS NOT NULL) THEN {_NUM('(?:^|[^a-z0-9_])unidad\\s+(\\d{1,2})(?:$|[^a-z0-9_])')} END AS unit FROM questions))"""
_TOPIC = lambda c: f"list_slice(list_filter({tokens(c)}, lambda w: NOT list_contains({quoted(QUESTION_WORDS)}, w)), 1, 6)"
_CAPS = f"list_filter(list_transform(regexp_extract_all(replace(question, ' ', '  '), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{{2,}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), lambda w: strip_accents(lower(w))), lambda w: NOT list_contains({quoted(QUESTION_WORDS)}, w) AND len({tokens('w')}) + CASE WHEN length(w) <= 2 THEN 1 ELSE 0 END > 0)"
_REQS = f"""raw_reqs AS MATERIALIZED (SELECT p.qid, p.question, p.kind AS type, {unique('e0')} AS e, t, {unique('c0')} AS entities, coalesce(CASE WHEN len(w.topics) > 0 THEN w.topics END, u.topics, []) AS more FROM
 (SELECT *, list_filter({tokens('question')}, lambda x: NOT list_contains({quoted(QUESTION_WORDS)}, x)) AS e0, {tokens('question')} AS t, {_CAPS} AS c0 FROM plans) p
 LEFT JOIN (SELECT week, {_TOPIC('topic')} AS topics FROM weeks) w ON w.week = p.week LEFT JOIN (SELECT unit, {_TOPIC('unit_name')} AS topics FROM units) u ON u.unit = p.unit),
core_reqs AS MATERIALIZED (SELECT *, list_filter(CASE WHEN len(e) > 0 THEN list_slice(e, 1, 8) ELSE list_slice(t, 1, 8) END, lambda x: x NOT IN ('semana', 'unidad')) AS own FROM raw_reqs),
all_reqs AS MATERIALIZED (SELECT *, list_slice(list_concat(own, {unique('list_filter(more, lambda x: NOT list_contains(own, x))')}), 1, 8) AS c8 FROM core_reqs),
reqs AS MATERIALIZED (SELECT qid, question, 'r1' AS rid, 'nucleo' AS kind, TRUE AS mandatory, CASE WHEN len(c8) > 0 THEN c8 ELSE list_slice(t, 1, 8) END AS terms, CAST([] AS VARCHAR[]) AS markers, entities FROM all_reqs
 UNION ALL SELECT qid, question, 'r2', 'causal', TRUE, list_slice(e, 1, 6), {quoted(CAUSAL_MARKERS)}, entities FROM all_reqs WHERE {has_phrase('question', CAUSAL)}
 UNION ALL SELECT qid, question, 'r3', 'contraste', FALSE, list_slice(e, 1, 6), [], entities FROM all_reqs WHERE {has_phrase('question', COMPARING)} OR type = 'conceptual')"""
_R1 = "r1_terms AS MATERIALIZED (SELECT qid, rid, unnest(terms) AS term FROM reqs WHERE rid = 'r1')"
_TERMS = "req_terms AS MATERIALIZED (SELECT qid, rid, term, count(*) AS times FROM (SELECT qid, rid, unnest(terms) AS term FROM reqs) GROUP BY ALL)"
_TOP = lambda n, table: f"SELECT *, row_number() OVER (PARTITION BY qid, rid ORDER BY score DESC, block_ix) AS rank FROM {table} QUALIFY rank <= {n}"
_BM = f"bm_all AS MATERIALIZED (SELECT qid, rid, block_ix, round(sum(times * weight), 9) AS score FROM req_terms JOIN bm_weights USING (term) GROUP BY ALL HAVING round(sum(times * weight), 9) > 0), bm AS MATERIALIZED ({_TOP(40, 'bm_all')})"
_TF = f"""said AS (SELECT qid, rid, term, count(*) AS tf FROM (SELECT qid, rid, unnest(CASE WHEN kind = 'nucleo' THEN {tokens('question')} ELSE {tokens("array_to_string(terms, ' ')")} END) AS term FROM reqs) GROUP BY ALL),
said_w AS (SELECT qid, rid, term, r / sqrt(sum(r * r) OVER (PARTITION BY qid, rid)) AS q FROM (SELECT qid, rid, term, (1 + ln(tf)) * idf AS r FROM said JOIN tf_idf USING (term))),
tf_all AS (SELECT qid, rid, block_ix, round(sum(q * weight), 9) AS score FROM said_w JOIN tf_weights USING (term) GROUP BY ALL HAVING round(sum(q * weight), 9) > 0), tf AS MATERIALIZED ({_TOP(40, 'tf_all')})"""
_TITLE = f"ti_all AS (SELECT qid, rid, block_ix, count(*) AS score FROM req_terms JOIN ctx_post USING (term) GROUP BY ALL), ti AS MATERIALIZED ({_TOP(20, 'ti_all')})"
_ENTITY = f"""named AS (SELECT DISTINCT qid, rid, unnest(entities) AS term FROM reqs), author_terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(strip_accents(lower(author)), '[a-z0-9]+')) AS term FROM docs),
en_all AS (SELECT qid, rid, block_ix, sum(score) AS score FROM (SELECT qid, rid, block_ix, 1 AS score FROM named JOIN body_post USING (term) UNION ALL SELECT qid, rid, block_ix, 10 FROM named JOIN author_terms USING (term) JOIN blocks USING (doc_id)) GROUP BY ALL), en AS MATERIALIZED ({_TOP(20, 'en_all')})"""
_STRUCT = """st_parts AS (SELECT qid, block_ix, 0 AS part FROM plans p JOIN blocks b ON b.week = p.week UNION ALL SELECT qid, block_ix, 1 FROM plans p JOIN blocks b ON b.unit = p.unit UNION ALL SELECT qid, block_ix, CASE b.kind WHEN 'rector' THEN 2 ELSE 3 END FROM plans p JOIN blocks b ON b.kind IN ('rector', 'evaluacion') WHERE p.admin),
st AS MATERIALIZED (SELECT qid, block_ix, part, row_number() OVER (PARTITION BY qid ORDER BY part, block_ix) AS rank FROM (SELECT qid, block_ix, min(part) AS part FROM st_parts GROUP BY ALL) QUALIFY rank <= 20),
allowed AS MATERIALIZED (SELECT DISTINCT qid, block_ix FROM st_parts WHERE part < 2)"""
_FUSED = """fused AS MATERIALIZED (SELECT qid, rid, block_ix, round(sum(1.0 / (60 + rank)), 12) AS score, min(pl) AS first FROM (SELECT qid, rid, block_ix, rank, rank AS pl FROM bm UNION ALL SELECT qid, rid, block_ix, rank, 1000000 + rank FROM tf UNION ALL SELECT qid, rid, block_ix, rank, 2000000 + rank FROM ti UNION ALL SELECT qid, rid, block_ix, rank, 3000000 + rank FROM en UNION ALL SELECT s.qid, r.rid, s.block_ix, s.rank, 4000000 + s.rank FROM st s JOIN reqs r USING (qid)) GROUP BY ALL)"""
_FRONT = """front AS MATERIALIZED (SELECT f.* FROM fused f LEFT JOIN allowed a USING (qid, block_ix) QUALIFY max(CASE WHEN a.block_ix IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY f.qid, f.rid) = 0 OR a.block_ix IS NOT NULL)"""
_UNION = "scores AS MATERIALIZED (SELECT qid, block_ix, round(sum(score), 12) AS score FROM front GROUP BY ALL)"
_CHAIN = (_Q, _PLANS, _REQS, _TERMS, _BM, _TF, _TITLE, _ENTITY, _STRUCT, _FUSED, _FRONT, _UNION)
_BASE = "blocks docs weeks units"
_ALL = "blocks docs weeks units bm_weights tf_weights ctx_post body_post cover_idf near"


def _compiled(spark, d, asked=questions):
    index = I.of(spark, d)
    plan = staged(C.plans(asked(spark, d), index))
    return index, plan, staged(C.requirements(plan, index))


@query(with_tables(_BASE, _Q, _PLANS, query="SELECT qid, kind, budget, week, unit, admin, filtered, quota FROM plans"))
def query_plan(spark, d):
    return _compiled(spark, d)[1].drop("question")


@query(with_tables(_BASE, _Q, _PLANS, query="SELECT qid, mode, CASE mode WHEN 'repasar' THEN least(budget, 3500) WHEN 'practicar' THEN least(budget, 9000) WHEN 'debate' THEN greatest(budget, 9000) WHEN 'resumen' THEN 14000 ELSE budget END AS budget FROM plans, (SELECT unnest(['repasar', 'practicar', 'debate', 'resumen', 'preguntar']) AS mode)"))
def mode_budgets(spark, d):
    q = questions(spark, d).withColumn("mode", F.explode(F.array(*map(F.lit, ("repasar", "practicar", "debate", "resumen", "preguntar")))))
    return q.select("qid", "mode", C.budget(C.query_type(F.col("question")), F.col("mode")).alias("budget"))


@query(with_tables(_BASE, _Q, _PLANS, _REQS, query="SELECT qid, rid, kind, mandatory, array_to_string(terms, ' ') AS terms, array_to_string(entities, ' ') AS entities, len(markers) AS markers FROM reqs"))
def requirement_terms(spark, d):
    _, _, reqs = _compiled(spark, d)
    return reqs.select("qid", "rid", "kind", "mandatory", F.array_join("terms", " ").alias("terms"), F.array_join("entities", " ").alias("entities"), F.size("markers").cast("long").alias("markers"))


def _ranked(name: str, table: str, needs: str, *parts: str):
    sql = with_tables(needs, _Q, _PLANS, _REQS, _TERMS, *parts, query=f"SELECT qid, rid, block_ix, round(CAST(score AS DOUBLE), 6) AS score, rank FROM {table}")

    def run(spark, d):
        index, plan, reqs = _compiled(spark, d)
        return R.signals(reqs, plan, index, only=name)[name].select("qid", "rid", "block_ix", F.round(F.col("score").cast("double"), 6).alias("score"), "rank")

    return sql, run


for _query, _args in {
    "bm25_topk": ("bm25", "bm", _BASE + " bm_weights", _BM), "tfidf_topk": ("dense", "tf", _BASE + " tf_weights", _TF),
    "title_match": ("title", "ti", _BASE + " ctx_post", _TITLE), "entity_match": ("entity", "en", _BASE + " body_post", _ENTITY),
}.items():
    _sql, _run = _ranked(*_args)
    query(_sql, _query)(_run)


@query(with_tables(_BASE, _Q, _PLANS, _STRUCT, query="SELECT qid, block_ix, rank FROM st"))
def structure_match(spark, d):
    index, plan, _ = _compiled(spark, d)
    return R.structure(plan, index).select("qid", "block_ix", "rank")


_EVERY_TWENTIETH = "(SELECT * FROM embeddings WHERE vec_id % 20 = 0) q"


def _embeddings(spark, d):
    """The stated queries, each row whose id is divisible by 20, and all vectors."""
    e = corpus.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), e


@query(f"SELECT qid, vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS rank FROM embeddings e, {_EVERY_TWENTIETH}, LATERAL (SELECT round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS s) WHERE s > 0.2 QUALIFY rank <= 40)")
def dense_topk(spark, d):
    return D.nearest(*_embeddings(spark, d), DENSE, DENSE_CUT).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT q.vec_id AS qid, round(max(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings e, {_EVERY_TWENTIETH} WHERE e.vec_id <> q.vec_id GROUP BY 1")
def dense_max(spark, d):
    return D.largest(*_embeddings(spark, d), others=True).select("qid", F.round("similarity", 6).alias("similarity"))


@query(with_tables(_ALL, *_CHAIN, query="SELECT qid, rid, block_ix, round(score, 9) AS score, first FROM fused"))
def rrf_fusion(spark, d):
    index, plan, reqs = _compiled(spark, d)
    return R.fuse(R.signals(reqs, plan, index)).select("qid", "rid", "block_ix", F.round("score", 9).alias("score"), F.col("first").cast("long").alias("first"))


@query(with_tables(_ALL, *_CHAIN, query="SELECT qid, rid, block_ix, round(score, 9) AS score FROM front"))
def frontier_filtered(spark, d):
    index, plan, reqs = _compiled(spark, d)
    return R.frontier(reqs, plan, index).select("qid", "rid", "block_ix", F.round("score", 9).alias("score"))


# vectors: of a question with an even id the row of embeddings with that id, of a document's blocks that with the document's;
# the others have none, so both ways of the dense ranking and of the gate are taken
_SIGHT = """qv AS MATERIALIZED (SELECT q.qid, CAST(e.embedding AS DOUBLE[]) AS v FROM questions q JOIN embeddings e ON e.vec_id = q.qid WHERE q.qid % 2 = 0),
bv AS MATERIALIZED (SELECT b.block_ix, CAST(e.embedding AS DOUBLE[]) AS v FROM blocks b JOIN embeddings e ON e.vec_id = b.doc_id),
cos AS MATERIALIZED (SELECT qid, block_ix, round(list_dot_product(qv.v, bv.v), 9) AS score FROM qv, bv),
dv AS MATERIALIZED (SELECT qid, block_ix, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS rank FROM cos WHERE score > 0.2 QUALIFY rank <= 40)"""
_MEANT = "meant AS MATERIALIZED (SELECT qid, rid, block_ix, rank FROM tf WHERE qid NOT IN (SELECT qid FROM qv) UNION ALL SELECT d.qid, r.rid, d.block_ix, d.rank FROM dv d JOIN reqs r USING (qid))"
_SEEN = (_Q, _PLANS, _REQS, _TERMS, _BM, _TF, _SIGHT, _MEANT, _TITLE, _ENTITY, _STRUCT, _FUSED.replace("FROM tf ", "FROM meant "), _FRONT)


def _vectors(spark, d, index, plan) -> R.Vectors:
    e = corpus.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = plan.filter("qid % 2 = 0").select("qid").join(e.withColumnRenamed("vec_id", "qid"), "qid")
    return R.Vectors(index.blocks.select("block_ix", F.col("doc_id").alias("vec_id")).join(e, "vec_id").select("block_ix", "vector"), asked)


@query(with_tables(_ALL, *_SEEN, query="SELECT qid, rid, block_ix, round(score, 9) AS score, first FROM fused"))
def rrf_fusion_vectors(spark, d):
    """rrf_fusion where half of the questions have a vector, and some blocks."""
    index, plan, reqs = _compiled(spark, d)
    return R.fuse(R.signals(reqs, plan, index, vectors=_vectors(spark, d, index, plan))).select("qid", "rid", "block_ix", F.round("score", 9).alias("score"), F.col("first").cast("long").alias("first"))


@query(with_tables(_ALL, *_SEEN, query="SELECT qid, rid, block_ix, round(score, 9) AS score FROM front"))
def frontier_vectors(spark, d):
    index, plan, reqs = _compiled(spark, d)
    return R.frontier(reqs, plan, index, vectors=_vectors(spark, d, index, plan)).select("qid", "rid", "block_ix", F.round("score", 9).alias("score"))


@query(with_tables(_BASE, _Q, _SIGHT, query="SELECT qid, round(CASE WHEN (SELECT count(*) FROM bv) < (SELECT count(*) FROM blocks) THEN greatest(max(score), 0) ELSE max(score) END, 6) AS similarity FROM cos GROUP BY qid"))
def question_similarity(spark, d):
    """The largest similarity of each question that has a vector to any block."""
    index, plan, _ = _compiled(spark, d)
    return R.similarity(_vectors(spark, d, index, plan), index).select("qid", F.round("similarity", 6).alias("similarity"))


_DENS = "dens AS MATERIALIZED (SELECT qid, max(d) AS density FROM (SELECT t.qid, p.block_ix, sum(p.tf * t.times) / any_value(l.n) * 1000 AS d FROM (SELECT qid, term, count(*) AS times FROM r1_terms GROUP BY ALL) t JOIN body_post p USING (term) JOIN (SELECT block_ix, sum(tf) AS n FROM body_post GROUP BY 1) l ON l.block_ix = p.block_ix GROUP BY t.qid, p.block_ix HAVING sum(t.times) >= 2) GROUP BY qid)"
_TEN = "ten AS MATERIALIZED (SELECT qid, sum(score) / least(10, (SELECT n FROM n_blocks)) AS mean FROM (SELECT * FROM bm_all WHERE rid = 'r1' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC) <= 10) GROUP BY qid)"


@query(with_tables(_BASE + " body_post", _Q, _PLANS, _REQS, _R1, _DENS, query="SELECT qid, round(density, 6) AS density FROM dens"))
def density(spark, d):
    index, _, reqs = _compiled(spark, d)
    return C.density(reqs, index).select("qid", F.round("density", 6).alias("density"))


@query(with_tables(_BASE + " bm_weights n_blocks", _Q, _PLANS, _REQS, _TERMS, _BM, _TEN, query="SELECT qid, round(mean, 6) AS mean FROM ten"))
def bm25_top10_mean(spark, d):
    index, _, reqs = _compiled(spark, d)
    return C.top_ten_mean(reqs, index).select("qid", F.round("mean", 6).alias("mean"))


def _gate_sql(sim: str) -> str:
    known = f"p.admin AND {has_phrase('p.question', ADMIN_STRONG)} AND NOT {has_phrase('p.question', ADVICE)}"
    reason = f"""CASE WHEN p.filtered THEN NULL WHEN {has_phrase('p.question', WANTS_ANSWERS)} THEN 'wants_answers' WHEN len(r.terms) = 0 THEN 'no_terms' WHEN au.qid IS NOT NULL THEN NULL WHEN {known} THEN NULL
 WHEN coalesce(u.unknown, 0) >= greatest(2, len(r.terms) - 1) THEN 'unknown_terms' WHEN sim IS NULL THEN CASE WHEN score < 1.0 THEN 'not_covered' END WHEN sim >= 0.51 THEN NULL WHEN sim < 0.30 THEN 'other_topic' WHEN score < 1.4 THEN 'only_mentioned' END"""
    return f"""gated AS MATERIALIZED (SELECT p.qid, {reason} AS reason, score FROM plans p JOIN (SELECT * FROM reqs WHERE rid = 'r1') r USING (qid)
 LEFT JOIN (SELECT DISTINCT qid FROM named JOIN (SELECT DISTINCT term FROM author_terms) USING (term) WHERE rid = 'r1') au USING (qid)
 LEFT JOIN (SELECT qid, count(*) FILTER (WHERE df IS NULL) AS unknown FROM r1_terms LEFT JOIN cover_idf USING (term) GROUP BY qid) u USING (qid)
 LEFT JOIN (SELECT qid, {sim} AS sim, round(0.7 * coalesce(density, 0) / 100 + coalesce(mean, 0) / 10, 9) AS score FROM plans LEFT JOIN dens USING (qid) LEFT JOIN ten USING (qid)) s USING (qid))"""


def _gate_parts(sim: str):
    return (_Q, _PLANS, _REQS, _TERMS, _R1, _BM, _ENTITY, _DENS, _TEN, _gate_sql(sim))


@query(with_tables(_ALL + " n_blocks", *_gate_parts("CAST(NULL AS DOUBLE)"), query="SELECT qid, reason IS NOT NULL AS out_of_scope, reason, round(score, 6) AS score FROM gated"))
def gate_decision(spark, d):
    index, plan, reqs = _compiled(spark, d)
    return C.gate(plan, reqs, index).withColumn("score", F.round("score", 6))


# a similarity for each question, so that all ways through the gate are taken
_SIM = "((qid * 37) % 100) / 100.0"


@query(with_tables(_ALL + " n_blocks", *_gate_parts(_SIM), query="SELECT qid, reason IS NOT NULL AS out_of_scope, reason FROM gated"))
def gate_with_similarity(spark, d):
    index, plan, reqs = _compiled(spark, d)
    sims = plan.select("qid", (F.col("qid") * 37 % 100 / 100.0).alias("similarity"))
    return C.gate(plan, reqs, index, sims).drop("score")


_SIGHTED = "sighted AS MATERIALIZED (SELECT qid, CASE WHEN (SELECT count(*) FROM bv) < (SELECT count(*) FROM blocks) THEN greatest(max(score), 0) ELSE max(score) END AS s FROM cos GROUP BY qid)"


@query(with_tables(_ALL + " n_blocks", *_gate_parts("(SELECT s FROM sighted x WHERE x.qid = plans.qid)")[:-1], _SIGHT, _SIGHTED, _gate_sql("(SELECT s FROM sighted x WHERE x.qid = plans.qid)"), query="SELECT qid, reason IS NOT NULL AS out_of_scope, reason FROM gated"))
def gate_with_vectors(spark, d):
    """The gate by the vectors' own similarities, lexical for questions without one."""
    index, plan, reqs = _compiled(spark, d)
    return C.gate(plan, reqs, index, R.similarity(_vectors(spark, d, index, plan), index)).drop("score")


_GOLD = "gold AS MATERIALIZED (SELECT DISTINCT b.item_id AS qid, d.doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, d):
    docs = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    bank = corpus.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("qid"), "text")
    return V.contained(bank, docs, "qid", "item").select("qid", "item")


_BANK = ("questions AS (SELECT item_id AS qid, text AS question FROM benchmark)", *_gate_parts("CAST(NULL AS DOUBLE)")[1:])


@query(with_tables(_ALL + " n_blocks", *_BANK, _GOLD, query="SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM (SELECT reason IS NULL AS p, qid IN (SELECT qid FROM gold) AS a FROM gated))"))
def gate_confusion(spark, d):
    index, plan, reqs = _compiled(spark, d, bank_questions)
    inside = _gold(spark, d).select("qid").distinct().withColumn("actual", F.lit(True))
    said = C.gate(plan, reqs, index).join(inside, "qid", "left")
    return V.confusion(said.select(F.coalesce("actual", F.lit(False)).alias("actual"), (~F.col("out_of_scope")).alias("predicted")))


@query(with_tables(_ALL, *_CHAIN, _GOLD, query="SELECT g.qid, count(*) AS gold, round(count(*) FILTER (WHERE f.item IS NOT NULL) / count(*), 6) AS recall, round(CASE WHEN coalesce(any_value(n.n), 0) > 0 THEN count(*) FILTER (WHERE f.item IS NOT NULL) / any_value(n.n) ELSE 0 END, 6) AS precision, count(*) = count(*) FILTER (WHERE f.item IS NOT NULL) AS complete FROM gold g LEFT JOIN (SELECT DISTINCT qid, block_ix // 1048576 AS item FROM bm WHERE rid = 'r1' AND rank <= 10) f USING (qid, item) LEFT JOIN (SELECT qid, count(DISTINCT block_ix // 1048576) AS n FROM bm WHERE rid = 'r1' AND rank <= 10 GROUP BY qid) n ON n.qid = g.qid GROUP BY g.qid"))
def gold_recall(spark, d):
    index, _, reqs = _compiled(spark, d)
    found = R.bm25(reqs.filter("rid = 'r1'"), index, 10).select("qid", F.floor(F.col("block_ix") / corpus.LINES).alias("item"))
    return V.gold_recall(_gold(spark, d), found)


@query(with_tables(_ALL, *_CHAIN, _GOLD, query="SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(CASE WHEN complete THEN 1 ELSE 0 END), 6) AS complete FROM (SELECT g.qid, round(count(*) FILTER (WHERE f.item IS NOT NULL) / count(*), 6) AS recall, round(CASE WHEN coalesce(any_value(n.n), 0) > 0 THEN count(*) FILTER (WHERE f.item IS NOT NULL) / any_value(n.n) ELSE 0 END, 6) AS precision, count(*) = count(*) FILTER (WHERE f.item IS NOT NULL) AS complete FROM gold g LEFT JOIN (SELECT DISTINCT qid, block_ix // 1048576 AS item FROM bm WHERE rid = 'r1' AND rank <= 10) f USING (qid, item) LEFT JOIN (SELECT qid, count(DISTINCT block_ix // 1048576) AS n FROM bm WHERE rid = 'r1' AND rank <= 10 GROUP BY qid) n ON n.qid = g.qid GROUP BY g.qid)"))
def gold_macro(spark, d):
    return V.macro(gold_recall(spark, d))


def _ablated(name: str) -> str:
    return f"SELECT '{name}' AS signal, * FROM (SELECT round(coalesce(avg(o), 1), 6) AS overlap, count(*) FILTER (WHERE same) AS identical, CAST(sum(n) AS BIGINT) AS fragments FROM (SELECT qid, len(list_filter(a, lambda x: list_contains(b, x))) / len(list_distinct(list_concat(a, b))) AS o, list_sort(a) = list_sort(b) AS same, len(b) AS n FROM (SELECT a.qid, a.l AS a, coalesce(b.l, []) AS b FROM best a LEFT JOIN (SELECT qid, list(block_ix) AS l FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY s DESC, block_ix) AS r FROM (SELECT qid, block_ix, round(sum(1.0 / (60 + rank)), 12) AS s FROM every WHERE sig <> '{name}' GROUP BY ALL) QUALIFY r <= 10) GROUP BY qid) b USING (qid))))"


_EVERY = "every AS MATERIALIZED (SELECT 'bm25' AS sig, qid, block_ix, rank FROM bm WHERE rid = 'r1' UNION ALL SELECT 'dense', qid, block_ix, rank FROM tf WHERE rid = 'r1' UNION ALL SELECT 'title', qid, block_ix, rank FROM ti WHERE rid = 'r1' UNION ALL SELECT 'entity', qid, block_ix, rank FROM en WHERE rid = 'r1' UNION ALL SELECT 'structure', qid, block_ix, rank FROM st), best AS MATERIALIZED (SELECT qid, list(block_ix) AS l FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY s DESC, block_ix) AS r FROM (SELECT qid, block_ix, round(sum(1.0 / (60 + rank)), 12) AS s FROM every GROUP BY ALL) QUALIFY r <= 10) GROUP BY qid)"
_NAMES = ("bm25", "dense", "title", "entity", "structure")


@query(with_tables(_ALL, *_CHAIN, _EVERY, query=" UNION ALL ".join(map(_ablated, _NAMES))))
def ablation_jaccard(spark, d):
    index, plan, reqs = _compiled(spark, d)
    each = {k: staged(v) for k, v in R.signals(reqs.filter("rid = 'r1'"), plan, index).items()}
    none = F.expr("cast(array() as array<bigint>)")

    def best(without=None):
        kept = {k: v for k, v in each.items() if k != without}
        top = R.top(R.fuse(kept), 10, "qid", "rid")
        return top.groupBy("qid").agg(F.collect_list("block_ix").alias("blocks"))

    base, out = best(), None
    for name in _NAMES:
        other = base.select("qid").join(best(name), "qid", "left").select("qid", F.coalesce("blocks", none).alias("blocks"))
        part = V.overlap(base, other).select(F.lit(name).alias("signal"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_FOLD = """WITH RECURSIVE c AS MATERIALIZED (SELECT s.qid, s.block_ix, b.doc_id, b.tokens, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.block_ix) AS r FROM scores s JOIN blocks b USING (block_ix)),
 f(qid, r, ix, docs, tokens, dropped) AS (SELECT DISTINCT qid, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), 0 FROM c
 UNION ALL SELECT f.qid, c.r, CASE WHEN ok THEN list_append(f.ix, c.block_ix) ELSE f.ix END, CASE WHEN ok THEN list_append(f.docs, c.doc_id) ELSE f.docs END, CASE WHEN ok THEN f.tokens + c.tokens ELSE f.tokens END, f.dropped + CASE WHEN full_ THEN 1 ELSE 0 END
 FROM f JOIN c ON c.qid = f.qid AND c.r = f.r + 1 JOIN plans p ON p.qid = f.qid, LATERAL (SELECT len(list_filter(f.docs, lambda d: d = c.doc_id)) >= p.quota AS full_) x, LATERAL (SELECT NOT full_ AND (f.tokens + c.tokens <= p.budget OR len(f.ix) = 0) AS ok) y)
 SELECT qid, array_to_string(ix, ',') AS blocks, tokens, dropped FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r DESC) = 1"""


# states: of each question the best three blocks of its union, and the best alone
_STATES = "states AS MATERIALIZED (SELECT qid, sid, list(block_ix ORDER BY r) AS blocks FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS r FROM scores), (SELECT unnest([1, 3]) AS sid) WHERE r <= sid GROUP BY ALL), mine AS MATERIALIZED (SELECT qid, sid, unnest(blocks) AS block_ix FROM states)"


def _states(scores):
    top = R.top(scores.withColumn("sid", F.lit(0)), 3, "qid")
    each = top.drop("sid").withColumn("sid", F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))).filter("rank <= sid")
    return each.groupBy("qid", "sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block_ix"))), lambda x: x["block_ix"]).alias("blocks"))


def _searched(spark, d):
    """Blocks are looked up among the questions' candidates alone."""
    index, plan, reqs = _compiled(spark, d)
    front = staged(R.frontier(reqs, plan, index))
    scores = staged(front.groupBy("qid", "block_ix").agg(F.round(F.sum("score"), 12).alias("score")))
    return index.narrowed(scores), plan, reqs, front, scores


_COVER = f"""wanted AS MATERIALIZED (SELECT qid, rid, kind, mandatory, term, FALSE AS marker FROM (SELECT qid, rid, kind, mandatory, unnest(CASE WHEN len(terms) = 0 THEN [NULL] ELSE {unique('terms')} END) AS term FROM reqs) UNION ALL SELECT qid, rid, kind, mandatory, unnest(markers), TRUE FROM reqs),
present AS MATERIALIZED (SELECT DISTINCT qid, sid, term FROM mine JOIN body_post USING (block_ix)),
cov AS MATERIALIZED (SELECT qid, sid, rid, kind, mandatory, round(CASE WHEN kind = 'causal' THEN least(base, least(1.0, marks / 3.0)) WHEN kind = 'contraste' AND docs < 2 THEN 0 ELSE base END, 9) AS coverage FROM (SELECT s.qid, s.sid, w.rid, w.kind, w.mandatory, coalesce(coalesce(sum(CASE WHEN NOT w.marker AND w.term IS NOT NULL AND p.term IS NOT NULL THEN coalesce(i.idf, ln((SELECT n FROM n_blocks) + 1) + 1) END), 0) / sum(CASE WHEN NOT w.marker AND w.term IS NOT NULL THEN coalesce(i.idf, ln((SELECT n FROM n_blocks) + 1) + 1) END), 0) AS base, count(*) FILTER (WHERE w.marker AND p.term IS NOT NULL) AS marks, any_value(d.docs) AS docs FROM states s JOIN wanted w USING (qid) LEFT JOIN cover_idf i ON i.term = w.term LEFT JOIN present p ON p.qid = s.qid AND p.sid = s.sid AND p.term = w.term JOIN (SELECT qid, sid, count(DISTINCT block_ix // 1048576) AS docs FROM mine GROUP BY ALL) d ON d.qid = s.qid AND d.sid = s.sid GROUP BY s.qid, s.sid, w.rid, w.kind, w.mandatory))"""


@query(with_tables(_ALL + " n_blocks", *_CHAIN, _STATES, _COVER, query="SELECT qid, sid, rid, kind, mandatory, round(coverage, 6) AS coverage, coverage >= CASE kind WHEN 'nucleo' THEN 0.55 ELSE 0.40 END AS supported FROM cov"))
def coverage(spark, d):
    index, _, reqs, _, scores = _searched(spark, d)
    return E.coverage(_states(scores), reqs, index).withColumn("coverage", F.round("coverage", 6))


_BAGS = f"bags AS MATERIALIZED (SELECT block_ix, list_distinct({tokens('body')}) AS bag FROM blocks WHERE block_ix IN (SELECT block_ix FROM scores))"
_RED = "red AS MATERIALIZED (SELECT s.qid, s.sid, round(coalesce(avg(j), 0), 9) AS redundancy FROM states s LEFT JOIN (SELECT a.qid, a.sid, CASE WHEN len(x.bag) + len(y.bag) > 0 THEN len(list_intersect(x.bag, y.bag)) / len(list_distinct(list_concat(x.bag, y.bag))) ELSE 0 END AS j FROM mine a JOIN mine b ON a.qid = b.qid AND a.sid = b.sid AND a.block_ix < b.block_ix JOIN bags x ON x.block_ix = a.block_ix JOIN bags y ON y.block_ix = b.block_ix) p ON p.qid = s.qid AND p.sid = s.sid GROUP BY s.qid, s.sid)"


@query(with_tables(_ALL, *_CHAIN, _STATES, _BAGS, _RED, query="SELECT qid, sid, round(redundancy, 6) AS redundancy FROM red"))
def redundancy(spark, d):
    index, _, _, _, scores = _searched(spark, d)
    return E.redundancy(_states(scores), index).withColumn("redundancy", F.round("redundancy", 6))


_SET = """sets AS MATERIALIZED (SELECT c.qid, c.sid, CAST(worst > 0 AS INTEGER) AS feasible, round(worst, 4) AS worst, round(mean, 4) AS mean, round(0.45 * diversity + 0.30 * authority + 0.25 * least(base * 60, 1.0) - 0.40 * redundancy, 4) AS precision, tokens, size FROM
 (SELECT qid, sid, coalesce(min(coverage) FILTER (WHERE mandatory), 0) AS worst, avg(coverage) AS mean FROM cov GROUP BY ALL) c JOIN (SELECT m.qid, m.sid, count(DISTINCT b.doc_id) / count(*) AS diversity, avg(CASE b.authority WHEN 'oficial' THEN 1.15 WHEN 'docente' THEN 0.92 ELSE 1.0 END) AS authority, avg(s.score) AS base, sum(b.tokens) AS tokens, count(*) AS size FROM mine m JOIN blocks b USING (block_ix) JOIN scores s ON s.qid = m.qid AND s.block_ix = m.block_ix GROUP BY m.qid, m.sid) x USING (qid, sid) JOIN red USING (qid, sid))"""


@query(with_tables(_ALL + " n_blocks", *_CHAIN, _STATES, _COVER, _BAGS, _RED, _SET, query="SELECT qid, sid, feasible, round(worst, 3) AS worst, round(mean, 3) AS mean, round(precision, 3) AS precision FROM sets"))
def set_score(spark, d):
    index, _, reqs, _, scores = _searched(spark, d)
    return E.set_score(_states(scores), reqs, index, scores).select("qid", "sid", "feasible", *(F.round(c, 3).alias(c) for c in ("worst", "mean", "precision")))


@query(with_tables(_ALL + " n_blocks", *_CHAIN, _STATES, _COVER, _BAGS, _RED, _SET, query="SELECT s.qid, s.sid, round(precision + 0.12 * touching / size - 0.35 * least(greatest(0, (s.tokens - p.budget) / greatest(p.budget, 1)), 1), 3) AS precision FROM sets s JOIN plans p USING (qid) JOIN (SELECT m.qid, m.sid, count(*) FILTER (WHERE list_contains(t.blocks, n.previous) OR list_contains(t.blocks, n.next)) AS touching FROM mine m JOIN near n USING (block_ix) JOIN states t ON t.qid = m.qid AND t.sid = m.sid GROUP BY m.qid, m.sid) t ON t.qid = s.qid AND t.sid = s.sid"))
def set_rerank(spark, d):
    index, plan, reqs, _, scores = _searched(spark, d)
    return E.set_score(_states(scores), reqs, index, scores, plan).select("qid", "sid", F.round("precision", 3).alias("precision"))


@query(with_tables(_ALL, *_CHAIN, _STATES, query=f"SELECT qid, sid, rid, array_to_string(CASE WHEN kind = 'causal' THEN list_concat(list_slice(terms, 1, 3), list_slice(list_filter(markers, lambda m: NOT list_contains(covered, m)), 1, 6)) WHEN len(list_filter(terms, lambda t: NOT list_contains(covered, t))) > 0 THEN {unique('list_filter(terms, lambda t: NOT list_contains(covered, t))')} ELSE terms END, ' ') AS residual FROM reqs JOIN (SELECT qid, sid, list(DISTINCT term) AS covered FROM mine JOIN body_post USING (block_ix) GROUP BY ALL) c USING (qid)"))
def residual_terms(spark, d):
    index, _, reqs, _, scores = _searched(spark, d)
    seen = E.members(_states(scores)).join(index.blocks.select("block_ix", F.explode("terms").alias("term")), "block_ix").groupBy("qid", "sid").agg(F.collect_set("term").alias("covered"))
    left = E.residual(F.col("terms"), F.col("markers"), F.col("kind"), F.col("covered"))
    return reqs.join(seen, "qid").select("qid", "sid", "rid", F.array_join(left, " ").alias("residual"))


_BRIDGES = "bridges AS MATERIALIZED (SELECT s.qid, s.sid, c.block_ix AS bridge, row_number() OVER (PARTITION BY s.qid, s.sid ORDER BY c.score DESC, c.block_ix DESC) AS place FROM states s JOIN scores c ON c.qid = s.qid WHERE NOT list_contains(s.blocks, c.block_ix) QUALIFY place <= 5)"


@query(with_tables(_ALL, *_CHAIN, _STATES, _BRIDGES, query="SELECT * FROM bridges"))
def bridges(spark, d):
    _, _, _, _, scores = _searched(spark, d)
    return E.bridges(scores, _states(scores))


@query(with_tables(_ALL, *_CHAIN, _STATES, _BRIDGES, _BAGS, query="""SELECT qid, rid, bridge, block_ix, place, round(useful, 6) AS useful FROM (SELECT *, row_number() OVER (PARTITION BY qid, rid, bridge ORDER BY useful DESC, first, block_ix) AS place FROM (SELECT f.qid, f.rid, b.bridge, f.block_ix, f.first, round(f.score + CASE WHEN f.block_ix = n.previous OR f.block_ix = n.next THEN 0.5 ELSE 0 END + CASE WHEN f.block_ix // 1048576 = b.bridge // 1048576 THEN 0.2 ELSE 0 END + CASE WHEN len(x.bag) > 0 AND len(y.bag) > 0 THEN CASE WHEN len(list_intersect(x.bag, y.bag)) / len(list_distinct(list_concat(x.bag, y.bag))) < 0.6 THEN 0.3 * len(list_intersect(x.bag, y.bag)) / len(list_distinct(list_concat(x.bag, y.bag))) ELSE -0.3 END ELSE 0 END + 0.15 * len(list_filter(list_distinct(r.terms), lambda t: list_contains(x.bag, t) AND NOT list_contains(y.bag, t))), 9) AS useful
 FROM front f JOIN bridges b ON b.qid = f.qid AND b.sid = 1 AND b.bridge <> f.block_ix JOIN near n ON n.block_ix = b.bridge JOIN bags x ON x.block_ix = f.block_ix JOIN bags y ON y.block_ix = b.bridge JOIN reqs r ON r.qid = f.qid AND r.rid = f.rid)) WHERE place <= 20"""))
def bridge_scores(spark, d):
    index, _, reqs, front, scores = _searched(spark, d)
    over = E.bridges(scores, _states(scores).filter("sid = 1"))
    named = front.withColumn("fid", F.concat_ws(":", "qid", "rid"))
    pairs = over.join(reqs.select("qid", "rid"), "qid").select(F.concat_ws(":", "qid", "rid").alias("fid"), "qid", "rid", "bridge")
    out = E.condition(named.select("fid", "block_ix", "score", "first"), pairs, reqs, index)
    return out.select("qid", "rid", "bridge", "block_ix", "place", F.round("useful", 6).alias("useful"))


@query(with_tables(_ALL, *_CHAIN, query="SELECT qid, block_ix, slot FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS slot FROM (SELECT qid, block_ix, place, row_number() OVER (PARTITION BY qid, block_ix // 1048576 ORDER BY place) AS once FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS place FROM scores)) WHERE place <= 6 OR once = 1) WHERE slot <= 12"))
def beam_prune(spark, d):
    _, _, _, _, scores = _searched(spark, d)
    ranked = R.top(scores, 1 << 30, "qid").select("qid", "block_ix", F.col("rank").alias("place"), F.floor(F.col("block_ix") / corpus.LINES).alias("signature"))
    return E.prune(ranked).select("qid", "block_ix", "slot")


@query(with_tables(_ALL, *_CHAIN, query="SELECT * FROM (" + _FOLD + ")"))
def pack_quota_budget(spark, d):
    index, plan, _, _, scores = _searched(spark, d)
    packed = E.pack(scores.join(index.blocks.select("block_ix", "doc_id", "tokens"), "block_ix"), plan)
    return packed.select("qid", F.array_join("blocks", ",").alias("blocks"), "tokens", "dropped")


_BEST = f"""picked AS MATERIALIZED (SELECT qid, block_ix, body FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS r FROM scores) JOIN blocks USING (block_ix) WHERE r <= 3),
 asked AS (SELECT qid, list_distinct(flatten(list(terms))) AS wanted FROM reqs GROUP BY qid),
 parts AS (SELECT qid, block_ix, body, unnest(p) AS s, unnest(range(0, len(p))) AS position FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+([A-ZÁÉÍÓÚÑ¿¡])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 40) AS p FROM picked))"""


@query(with_tables(_ALL, *_CHAIN, _BEST, query=f"SELECT qid, block_ix, position, s AS sentence, score, strpos(body, s) - 1 AS offset FROM (SELECT *, round(hits / len(wanted), 3) AS score, row_number() OVER (PARTITION BY qid, block_ix ORDER BY round(hits / len(wanted), 3) DESC, position) AS r FROM (SELECT p.*, a.wanted, len(list_filter(list_distinct({tokens('s')}), lambda t: list_contains(a.wanted, t))) AS hits FROM parts p JOIN asked a USING (qid)) WHERE hits > 0) WHERE r <= 3"))
def top_sentences(spark, d):
    index, _, reqs, _, scores = _searched(spark, d)
    picked = R.top(scores, 3, "qid").select("qid", "block_ix").join(index.blocks.select("block_ix", "body"), "block_ix")
    return E.top_sentences(picked, reqs).withColumns({c: F.col(c).cast("long") for c in ("position", "offset")})


_SUP = "ver AS MATERIALIZED (SELECT *, coverage >= CASE kind WHEN 'nucleo' THEN 0.55 ELSE 0.40 END AS supported FROM cov WHERE sid = 3)"


# the first block always is packed, so whatever has a score has packages
@query(with_tables(_ALL + " n_blocks", *_CHAIN, _STATES, _COVER, _SUP, query="SELECT qid, CASE WHEN bool_and(supported) THEN 'ANSWER' WHEN bool_and(NOT mandatory OR supported) OR qid IN (SELECT qid FROM scores) THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS decision, round(avg(CASE WHEN supported THEN 1 ELSE 0 END), 3) AS coverage FROM ver GROUP BY qid"))
def decision(spark, d):
    index, plan, reqs, _, scores = _searched(spark, d)
    packed = E.pack(scores.join(index.blocks.select("block_ix", "doc_id", "tokens"), "block_ix"), plan)
    return E.decision(E.coverage(_states(scores).filter("sid = 3"), reqs, index), packed.select("qid", F.size("blocks").alias("n")))


# what the quota dropped is what the fold of pack_quota_budget dropped; a week is found if one of the three best blocks is of it
@query(with_tables(_ALL + " n_blocks", *_CHAIN, _STATES, _COVER, _SUP, f"folded AS MATERIALIZED ({_FOLD})", query="SELECT v.qid, array_to_string(list_concat(list_transform(missing, lambda r: 'missing:' || r), list_filter([CASE WHEN NOT every AND len(missing) = 0 THEN 'no_second_source' END, CASE WHEN dropped > 0 THEN 'quota:' || dropped END, CASE WHEN degraded THEN 'scanned' END, CASE WHEN p.week IS NOT NULL AND NOT coalesce(here, FALSE) THEN 'no_week:' || p.week END], lambda x: x IS NOT NULL)), ';') AS notices FROM (SELECT qid, bool_and(supported) AS every, coalesce(list(rid ORDER BY rid) FILTER (WHERE mandatory AND NOT supported), []) AS missing FROM ver GROUP BY qid) v JOIN plans p ON p.qid = v.qid JOIN folded f ON f.qid = v.qid JOIN (SELECT m.qid, bool_or(b.week = p.week) AS here, bool_or(coalesce(list_sum(list_transform(regexp_extract_all(b.body, '[a-zA-ZáéíóúñÁÉÍÓÚÑ]{3,}'), lambda w: length(w))), 0) / length(b.body) < 0.55) AS degraded FROM mine m JOIN blocks b USING (block_ix) JOIN plans p USING (qid) WHERE m.sid = 3 GROUP BY m.qid) h ON h.qid = v.qid"))
def notices(spark, d):
    """Of the three best blocks; a block of few letters counts as scanned."""
    index, plan, reqs, _, scores = _searched(spark, d)
    states = _states(scores).filter("sid = 3")
    v = E.coverage(states, reqs, index)
    per = v.groupBy("qid").agg(F.bool_and("supported").alias("every"), F.array_sort(F.collect_list(F.when(F.col("mandatory") & ~F.col("supported"), F.col("rid")))).alias("missing"))
    packed = E.pack(scores.join(index.blocks.select("block_ix", "doc_id", "tokens"), "block_ix"), plan).select("qid", "dropped")
    weeks = plan.select("qid", F.col("week").alias("asked"))
    shown = E.members(states).join(index.blocks.select("block_ix", "week", "body"), "block_ix").join(weeks, "qid")
    shown = shown.groupBy("qid").agg(F.coalesce(F.bool_or(F.col("week") == F.col("asked")), F.lit(False)).alias("here"), F.bool_or(X.letters_share(F.col("body")) < 0.55).alias("scanned"))
    out = E.notices(F.col("missing"), F.when(F.col("every"), "ANSWER").otherwise("PARTIAL"), F.col("dropped"), F.col("scanned"), F.col("asked"), F.col("here"))
    return per.join(packed, "qid").join(weeks, "qid").join(shown, "qid").select("qid", F.array_join(out, ";").alias("notices"))


@query(with_tables(_ALL, *_CHAIN, query="SELECT qid, count(*) AS supporting, CASE WHEN count(*) FILTER (WHERE r <= 3 AND share > 0.6) > 0 THEN 'strong' ELSE 'partial' END AS level FROM (SELECT t.qid, t.r, len(list_filter(list_distinct(q.terms), lambda x: list_contains(t.terms, x))) / nullif(len(list_distinct(q.terms)), 0) AS share FROM (SELECT s.qid, s.block_ix, s.r, list(p.term) AS terms FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS r FROM scores QUALIFY r <= 3) s JOIN body_post p USING (block_ix) GROUP BY ALL) t JOIN reqs q ON q.qid = t.qid AND q.rid = 'r1') GROUP BY qid"))
def confidence_level(spark, d):
    index, _, reqs, _, scores = _searched(spark, d)
    top = R.top(scores, 3, "qid")
    held = top.join(index.blocks.select("block_ix", F.explode("terms").alias("term")), "block_ix").groupBy("qid", "block_ix", "rank").agg(F.collect_set("term").alias("have"))
    r1 = reqs.filter("rid = 'r1'").select("qid", F.array_distinct("terms").alias("terms"))
    share = F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", "have")) / F.size("terms"))
    return A.confidence(held.join(r1, "qid").select("qid", F.col("rank").alias("n"), share.alias("coverage")))


@query(with_tables(_ALL, *_CHAIN, query="SELECT qid, CAST(retrieval AS BIGINT) AS retrieval, CAST(coalesce(CASE WHEN w IS NOT NULL THEN (SELECT sum(tokens) FROM blocks b WHERE b.week = w) END, 0) AS BIGINT) AS section, CAST((SELECT sum(tokens) FROM blocks) AS BIGINT) AS everything FROM (SELECT s.qid, sum(b.tokens) AS retrieval, coalesce(any_value(p.week), arg_min(b.week, s.r)) AS w FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS r FROM scores QUALIFY r <= 10) s JOIN blocks b USING (block_ix) JOIN plans p ON p.qid = s.qid GROUP BY s.qid)"))
def cost_compare(spark, d):
    _, plan, _, _, scores = _searched(spark, d)
    index = I.of(spark, d)
    top = R.top(scores, 10, "qid").join(index.blocks.select("block_ix", "tokens", F.col("week").alias("own")), "block_ix")
    per = top.groupBy("qid").agg(F.sum("tokens").alias("retrieval"), F.min_by("own", "rank").alias("first")).join(plan.select("qid", "week"), "qid").withColumn("w", F.coalesce("week", "first"))
    weeks = index.blocks.groupBy("week").agg(F.sum("tokens").alias("section")).withColumnRenamed("week", "w")
    every = index.blocks.agg(F.sum("tokens").alias("everything"))
    return per.join(weeks, "w", "left").crossJoin(F.broadcast(every)).select("qid", "retrieval", F.coalesce("section", F.lit(0).cast("long")).alias("section"), "everything")  # one row


@query(with_tables(_ALL, *_CHAIN, _STATES, query="SELECT qid, sid, count(DISTINCT block_ix // 1048576) AS documents, count(*) AS blocks FROM mine GROUP BY ALL"))
def documents_per_state(spark, d):
    index, _, _, _, scores = _searched(spark, d)
    mine = E.members(_states(scores)).join(index.blocks.select("block_ix", "doc_id"), "block_ix")
    return mine.groupBy("qid", "sid").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("blocks"))


@query(with_tables(_ALL, *_CHAIN, query="SELECT p.qid, md5('PREGUNTAR:' || chr(10) || p.question || chr(10) || chr(10) || 'EVIDENCE (' || e.n || '):' || chr(10) || e.ev) AS prompt FROM plans p JOIN (SELECT qid, count(*) AS n, string_agg('[' || r || '] ' || author || chr(10) || '    p. ' || n || ' | ' || kind || ' | ' || authority || chr(10) || body, chr(10) || chr(10) || repeat('-', 70) || chr(10) || chr(10) ORDER BY r) AS ev FROM (SELECT s.qid, s.r, b.n, b.source AS author, b.kind, b.authority, b.body FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS r FROM scores QUALIFY r <= 3) s JOIN blocks b USING (block_ix)) GROUP BY qid) e USING (qid)"))
def prompts(spark, d):
    index, plan, _, _, scores = _searched(spark, d)
    b = index.blocks.select("block_ix", F.col("source").alias("label"), A.location(F.col("n"), F.lit(None)).alias("place"), "kind", "authority", F.lit(False).alias("ocr"), "body")
    items = R.top(scores, 3, "qid").join(b, "block_ix").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "place", "kind", "authority", "ocr", "body"))).alias("items"))
    text = A.prompt(F.lit("preguntar"), F.col("question"), A.evidence_block(F.col("items")), F.size("items"), F.expr("cast(array() as array<string>)"))
    return items.join(plan.select("qid", "question"), "qid").select("qid", F.md5(text).alias("prompt"))


_CHOSEN = "chosen AS MATERIALIZED (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS n FROM scores QUALIFY n <= 4)"


@query(with_tables(_ALL, *_CHAIN, _CHOSEN, query="SELECT c.qid, c.n, b.block_id, replace(coalesce(nullif(d.title, ''), CAST(d.doc_id AS VARCHAR)), '_', ' ') AS document, d.author AS cited, 'p. ' || b.n AS place, string_split(b.source, '/')[-1] AS file, b.kind, b.authority, b.unit, b.week, b.tokens, md5(left(b.body, 600)) AS extract FROM chosen c JOIN blocks b USING (block_ix) JOIN docs d USING (doc_id)"))
def response_packages(spark, d):
    index, _, _, _, scores = _searched(spark, d)
    chosen = R.top(scores, 4, "qid").select("qid", F.col("rank").alias("n"), "block_ix")
    shown = SV.packages(chosen, index).withColumn("extract", F.md5("extract"))
    return shown.select("qid", "n", "block_id", "document", "cited", "place", "file", "kind", "authority", "unit", "week", "tokens", "extract")


@query(with_tables(_ALL + " n_blocks", *_CHAIN, _STATES, _COVER, _SUP, _BEST, query=f"""SELECT v.qid, 'PARTIAL' AS decision, v.coverage, v.unmet, v.stated, e.evidence, e.raw, coalesce(t.atoms, 0) AS atoms FROM
 (SELECT s.qid, round(avg(CASE WHEN supported THEN 1 ELSE 0 END), 3) AS coverage, coalesce(string_agg(rid, ',' ORDER BY rid) FILTER (WHERE NOT supported), '') AS unmet, string_agg(rid || ':' || array_to_string(r.terms, ' '), ';' ORDER BY rid) AS stated FROM ver s JOIN reqs r USING (qid, rid) GROUP BY s.qid) v
 JOIN (SELECT qid, string_agg('ev_' || r || ':' || doc_id || ':' || block_id, ',' ORDER BY r) AS evidence, md5(string_agg(left(body, 400), '' ORDER BY r)) AS raw FROM (SELECT qid, block_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_ix) AS r FROM scores QUALIFY r <= 3) JOIN blocks USING (block_ix) GROUP BY qid) e USING (qid)
 LEFT JOIN (SELECT qid, count(*) AS atoms FROM (SELECT p.qid, row_number() OVER (PARTITION BY p.qid, block_ix ORDER BY position) AS r FROM parts p JOIN asked a USING (qid) WHERE len(list_filter(list_distinct({tokens('s')}), lambda t: list_contains(a.wanted, t))) > 0) WHERE r <= 3 GROUP BY qid) t USING (qid)"""))
def output_contracts(spark, d):
    """The contract of each question's three best blocks, taken apart."""
    index, plan, reqs, _, scores = _searched(spark, d)
    chosen = R.top(scores, 3, "qid").select("qid", F.col("rank").alias("n"), "block_ix")
    verified = E.coverage(_states(scores).filter("sid = 3"), reqs, index)
    decided = plan.join(scores.select("qid").distinct(), "qid").select("qid", "question", F.lit("PARTIAL").alias("decision"))
    c = SV.contracts(decided, verified, reqs, chosen, index).select("qid", "contract.*")
    join = lambda column, f, by: F.array_join(F.transform(column, f), by)
    return c.select(
        "qid", "decision", "coverage", F.array_join("unmet_requirements", ",").alias("unmet"), join("requirements", lambda r: F.concat(r["id"], F.lit(":"), r["proposition"]), ";").alias("stated"),
        join("evidence", lambda e: F.concat(e["id"], F.lit(":"), e["document_id"].cast("string"), F.lit(":"), e["block_id"]), ",").alias("evidence"), F.md5(join("evidence", lambda e: e["raw_text"], "")).alias("raw"),
        F.aggregate("evidence", F.lit(0), lambda n, e: n + F.size(e["atoms"])).cast("long").alias("atoms"),
    )


@query(with_tables(_ALL, *_CHAIN, _CHOSEN, query="""SELECT p.qid, coalesce(n BETWEEN 1 AND 4, FALSE) AS few_blocks, coalesce(author, FALSE) AS author_on_top, p.filtered, coalesce(docs >= 2, FALSE) AS two_documents, coalesce(authors >= 2, FALSE) AS two_authors FROM plans p LEFT JOIN
 (SELECT c.qid, count(DISTINCT c.n) AS n, bool_or(c.n <= 3 AND m.term IS NOT NULL) AS author, count(DISTINCT b.doc_id) AS docs, count(DISTINCT m.term) AS authors FROM chosen c JOIN blocks b USING (block_ix) LEFT JOIN (SELECT DISTINCT e.qid, a.doc_id, a.term FROM named e JOIN author_terms a USING (term) WHERE e.rid = 'r1') m ON m.qid = c.qid AND m.doc_id = b.doc_id GROUP BY c.qid) s USING (qid)"""))
def structural_invariants(spark, d):
    index, plan, reqs, _, scores = _searched(spark, d)
    return E.invariants(plan, reqs, R.top(scores, 4, "qid").select("qid", F.col("rank").alias("n"), "block_ix"), index)


@query(with_tables(_ALL + " n_blocks", *_BANK, _GOLD, query="SELECT kind AS family, actual, count(*) AS questions, count(*) FILTER (WHERE actual = (reason IS NULL)) AS correct FROM (SELECT g.reason, p.kind, g.qid IN (SELECT qid FROM gold) AS actual FROM gated g JOIN plans p USING (qid)) GROUP BY ALL"))
def gate_by_family(spark, d):
    """How often the gate is right, by the questions' type, for those that the corpus holds and those it doesn't."""
    index, plan, reqs = _compiled(spark, d, bank_questions)
    inside = _gold(spark, d).select("qid").distinct().withColumn("actual", F.lit(True))
    said = C.gate(plan, reqs, index).join(plan.select("qid", "kind"), "qid").join(inside, "qid", "left").withColumn("actual", F.coalesce("actual", F.lit(False)))
    return said.groupBy(F.col("kind").alias("family"), "actual").agg(F.count("*").alias("questions"), F.count_if(F.col("actual") == ~F.col("out_of_scope")).alias("correct"))


@query()
def retrieve(spark, d):
    """End to end; tests hold it against a brute-force search."""
    out = S.retrieve_from(spark, d, questions(spark, d))
    return out.withColumns({c: F.array_join(c, ",") for c in ("blocks", "missing")})
