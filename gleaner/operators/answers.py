"""Answers and prompts: evidence as text, prompts, citation checks, parsers, answer analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X

#: How a question is labelled in each mode's prompt.
MODES = ("preguntar", "resumen", "explicacion", "debate", "resolver", "practicar", "evaluar", "repasar")


def valid_request(question: Column, mode: Column) -> tuple[Column, Column]:
    """The question without outer white space (null if blank) and the mode (`preguntar` if unknown)."""
    q = X.strip(question)
    return F.when(F.length(q) > 0, q), F.when(mode.isin(*MODES), mode).otherwise(F.lit("preguntar"))


def location(page: Column, slide: Column) -> Column:
    return F.coalesce(F.concat(F.lit("p. "), page.cast("string")), F.concat(F.lit("diap. "), slide.cast("string")), F.lit("s/ubicacion"))


def citation_label(citation: Column, title: Column, doc_id: Column) -> Column:
    return F.coalesce(F.nullif(citation, F.lit("")), F.nullif(title, F.lit("")), doc_id)


def evidence_block(items: Column) -> Column:
    """items: array of struct(label, place, kind, authority, ocr, body), numbered from 1 and set apart by lines."""
    one = F.transform(items, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["label"], F.lit("\n    "), p["place"], F.lit(" | "), p["kind"], F.lit(" | "), p["authority"], F.when(p["ocr"], " | OCR").otherwise(""), F.lit("\n"), p["body"]))
    return F.array_join(one, "\n\n" + "-" * 70 + "\n\n")


def prompt(mode: Column, question: Column, evidence: Column, n: Column, notices: Column) -> Column:
    """Null without evidence."""
    notes = F.when(F.size(notices) > 0, F.concat(F.lit("\n\nNOTES:\n- "), F.array_join(notices, "\n- "))).otherwise("")
    return F.when(n > 0, F.concat(F.upper(mode), F.lit(":\n"), question, F.lit("\n\nEVIDENCE ("), n.cast("string"), F.lit("):\n"), evidence, notes))


def full_context(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, n, body): each document's lines in order, as one text."""
    lines = blocks.filter(F.length(X.strip(F.col("body"))) > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("lines"))
    return lines.select("doc_id", F.array_join(F.transform("lines", lambda x: F.concat(F.lit("[p."), x["n"].cast("string"), F.lit("] "), x["body"])), "\n").alias("context"))


def check_citations(answers: DataFrame) -> DataFrame:
    """answers (aid, answer, n): cited, unused, unknown citations, and how many claims have none."""
    cited = X.citations(F.col("answer"))
    valid = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.expr("cast(array() as array<int>)"))
    bare = F.size(F.filter(F.split("answer", "\n"), X.claims))
    return answers.select("aid", cited.alias("cited"), F.array_except(valid, cited).alias("unused"), F.array_except(cited, valid).alias("unknown"), bare.alias("bare_claims"))


def grounding(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (aid, answer), evidence (aid, n, body): the mean share of a citing paragraph's tokens, its citations' numbers apart, that the cited block has."""
    paragraphs = answers.select("aid", F.explode(F.split("answer", "\n")).alias("p")).filter(F.length("p") >= 60)
    cited = paragraphs.select("aid", F.array_distinct(X.tokens(F.regexp_replace("p", r"\[\d+\]", " "))).alias("own"), F.explode(F.regexp_extract_all("p", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("c")).withColumn("n", F.col("c").cast("int"))
    known = evidence.select("aid", "n", F.array_distinct(X.tokens(F.col("body"))).alias("theirs"))
    both = cited.join(known, ["aid", "n"]).filter((F.size("own") > 0) & (F.size("theirs") > 0))
    return both.groupBy("aid").agg(F.round(F.avg(F.size(F.array_intersect("own", "theirs")) / F.size("own")), 6).alias("grounding"))


def analyse(answers: DataFrame) -> DataFrame:
    """answers (aid, answer, n): length, cited share, unknown citations and the traces' flags."""
    cited = X.citations(F.col("answer"))
    share = F.when(F.col("n") > 0, F.size(cited) / F.col("n")).otherwise(0.0)
    flags = [c.alias(k) for k, c in X.traces(F.col("answer")).items()]
    return answers.select("aid", F.length("answer").alias("length"), F.round(share, 6).alias("cited_share"), F.size(F.filter(cited, lambda c: c > F.col("n"))).alias("unknown"), *flags)


def quality(answers: DataFrame, key: str, flags: dict[str, Column] | None = None) -> DataFrame:
    """answers (key, answer, n: pieces of evidence), of each key: answers, share with a citation, with unknown ones, mean share of
    the evidence cited, mean and largest length, and how many answers have each flag."""
    c = X.citations(F.col("answer"))
    return answers.groupBy(key).agg(
        F.count("*").alias("answers"), F.round(F.avg((F.size(c) > 0).cast("int")), 6).alias("cited"), F.count_if(F.exists(c, lambda i: i > F.col("n"))).alias("bad"),
        F.round(F.coalesce(F.avg(F.when(F.col("n") > 0, F.size(c) / F.col("n"))), F.lit(0.0)), 6).alias("used"), F.round(F.avg(F.length("answer")), 6).alias("mean_length"),
        F.max(F.length("answer")).cast("long").alias("longest"), *(F.count_if(f).alias(k) for k, f in (flags or {}).items()),
    )


def parse_answer(mode: Column, answer: Column) -> Column:
    """Quiz items for `practicar` and `evaluar`, cards for `repasar`, as JSON."""
    return F.when(mode.isin("practicar", "evaluar"), F.to_json(X.parse_quiz(answer))).when(mode == "repasar", F.to_json(X.parse_card(answer)))


def confidence(evidence: DataFrame) -> DataFrame:
    """evidence (qid, coverage or null; one row with a null n for none): level and number of supporting blocks."""
    return evidence.groupBy("qid").agg(F.count("n").alias("supporting"), F.count_if(F.col("coverage") > 0.6).alias("direct")).select("qid", "supporting", F.when(F.col("supporting") == 0, "insufficient").when(F.col("direct") > 0, "strong").otherwise("partial").alias("level"))
