"""The facade: information about the corpus, and answers to requests with their evidence, contract, prompt and, with a model, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.prompts import COMPLEMENTS, system_prompt
from gleaner.operators import answers as A
from gleaner.operators import evaluate as V
from gleaner.operators import evidence as E
from gleaner.operators import rank
from gleaner.operators.index import Index
from gleaner.plans import search as S
from gleaner.sources.connectors import generate

#: Characters of a package's extract and of a contract's raw text.
EXTRACT, RAW = 600, 400


def info(index: Index) -> DataFrame:
    """Documents, blocks and tokens of the corpus."""
    return V.corpus_totals(index.docs, index.blocks)


def numbered(found: DataFrame) -> DataFrame:
    """found (qid, blocks): qid, n (from 1), block_ix."""
    return found.select("qid", F.posexplode("blocks").alias("p", "block_ix")).select("qid", (F.col("p") + 1).alias("n"), "block_ix")


def packages(chosen: DataFrame, index: Index) -> DataFrame:
    """chosen (qid, n, block_ix): what a response shows of each block; ids that the index lacks are left out."""
    b = index.blocks.withColumnRenamed("n", "line").join(index.docs.select("doc_id", "title", "author"), "doc_id")
    name = A.citation_label(F.lit(None).cast("string"), F.col("title"), F.col("doc_id").cast("string"))
    return chosen.join(b, "block_ix").select(
        "qid", "n", "block_ix", "block_id", "doc_id", F.translate(name, "_", " ").alias("document"), F.col("author").alias("cited"), A.location(F.col("line"), F.lit(None)).alias("place"),
        F.element_at(F.split("source", "/"), -1).alias("file"), "kind", "authority", "unit", "week", "tokens", F.left("body", F.lit(EXTRACT)).alias("extract"), "body",
    )


def contracts(decided: DataFrame, verified: DataFrame, reqs: DataFrame, chosen: DataFrame, index: Index) -> DataFrame:
    """decided (qid, question, decision), verified as evidence.coverage(): qid, contract."""
    shown = packages(chosen, index)
    atoms = E.top_sentences(shown.select("qid", "block_ix", "body"), reqs)
    atoms = atoms.groupBy("qid", "block_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), "position", "sentence"))), lambda x: x["sentence"]).alias("atoms"))
    one = F.struct(
        "n", F.concat(F.lit("ev_"), F.col("n").cast("string")).alias("id"), F.col("doc_id").alias("document_id"), "block_id", F.struct(F.col("place").alias("page"), "file").alias("locator"),
        F.coalesce("atoms", F.expr("cast(array() as array<string>)")).alias("atoms"), F.lit("lexical_fallback").alias("atom_selector"), F.left("body", F.lit(RAW)).alias("raw_text"),
    )
    evidence = shown.join(atoms, ["qid", "block_ix"], "left").groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("evidence"))
    stated = verified.join(reqs.select("qid", "rid", "terms"), ["qid", "rid"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rid", "terms", "mandatory", "coverage", "supported"))).alias("requirements"))
    rows = decided.join(evidence, "qid", "left").join(stated, "qid", "left")
    no_evidence, none = F.filter("evidence", lambda e: F.lit(False)), F.filter("requirements", lambda r: F.lit(False))
    rows = rows.withColumn("evidence", F.coalesce("evidence", no_evidence, F.from_json(F.lit("[]"), evidence.schema["evidence"].dataType)))
    rows = rows.withColumn("requirements", F.coalesce("requirements", none, F.from_json(F.lit("[]"), stated.schema["requirements"].dataType)))
    return rows.select("qid", E.contract(F.col("question"), F.col("decision"), F.col("requirements"), F.col("evidence")).alias("contract"))


def prompts(rows: DataFrame, chosen: DataFrame, index: Index) -> DataFrame:
    """rows (qid, question, mode): qid, mode, system, user (null without evidence), input_tokens."""
    shown = packages(chosen, index)
    items = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", F.col("cited").alias("label"), "place", "kind", "authority", F.lit(False).alias("ocr"), "body"))).alias("items"))
    user = A.prompt(F.col("mode"), F.col("question"), A.evidence_block(F.col("items")), F.size("items"), F.expr("cast(array() as array<string>)"))
    system = F.create_map(*(x for m in COMPLEMENTS for x in (F.lit(m), F.lit(system_prompt(m)))))
    out = rows.join(items, "qid", "left").select("qid", "mode", system[F.col("mode")].alias("system"), user.alias("user"))
    return out.withColumn("input_tokens", F.regexp_count("user", F.lit(r"\S+")))


def ask(requests: DataFrame, index: Index, model: Callable[[str, str], str] | None = None, reserve: Callable[[str, str], str] | None = None, vectors: rank.Vectors | None = None) -> DataFrame:
    """requests (qid, question, mode): a row for each with a question: mode, decision, contract, packages, prompt and, with a model, answer, parsed, error.

    Blank questions give the error `no question`.
    """
    q, m = A.valid_request(F.col("question"), F.col("mode"))
    asked = requests.select("qid", q.alias("question"), m.alias("mode"))
    found = S.retrieved(asked.filter("question IS NOT NULL").select("qid", "question"), index, vectors)
    rows = S.staged(found.rows)
    chosen = numbered(rows)
    shown = packages(chosen, index).drop("body")
    shown = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*(c for c in shown.columns if c != "qid")))).alias("packages"))
    said = S.staged(prompts(asked.join(rows.select("qid"), "qid"), chosen, index))
    out = rows.drop("question", "kind").join(asked, "qid", "right").join(contracts(rows, found.verified, found.reqs, chosen, index), "qid", "left").join(shown, "qid", "left").join(said.drop("mode"), "qid", "left")
    out = out.withColumn("error", F.when(F.col("question").isNull(), F.lit("no question")))
    if model is None:
        return out
    told = S.staged(generate(said, model, reserve)).withColumnRenamed("error", "failed")
    out = out.join(told, "qid", "left").withColumn("error", F.coalesce("error", "failed")).drop("failed")
    return out.withColumn("parsed", A.parse_answer(F.col("mode"), F.col("answer")))
