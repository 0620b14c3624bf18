"""Registered queries answer for all of their rows, not for a range of ids or the start of a text."""

import re
import shutil
import unicodedata

from conftest import SMALL
from pyspark.sql import functions as F

from gleaner.functions.wordlists import QUESTION_WORDS, STOP_WORDS
from gleaner.plans import queries_corpus  # noqa: F401
from gleaner.plans import queries_retrieval as Q
from gleaner.plans.registry import QUERIES


def many_items(spark, folder):
    """The smallest tables with a benchmark whose ids are 985, 1010, 1035 ..., among them one of a literal question's."""
    shutil.copytree(SMALL, folder)
    shutil.rmtree(folder / "benchmark.parquet") if (folder / "benchmark.parquet").is_dir() else (folder / "benchmark.parquet").unlink()
    bank = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bank.withColumn("item_id", F.col("item_id") * 25 + 985).write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_retrieve_answers_all_questions(spark):
    got = [r.qid for r in QUERIES["retrieve"](spark, SMALL).select("qid").collect()]
    bank = [r.item_id for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(got) == sorted(bank + [n for n, _ in Q.QUESTIONS])


def test_ids_of_many_benchmark_items(spark, tmp_path):
    folder = many_items(spark, tmp_path / "many")
    asked = [r.qid for r in Q.questions(spark, folder).collect()]
    assert len(asked) == len(set(asked)) == 50 and {1010, -1010, 1009} <= set(asked) and -1009 not in asked
    few, many = (QUERIES["gate_confusion"](spark, d).first() for d in (SMALL, folder))
    assert few.tp + few.fp + few.fn + few.tn == 40 and few == many


def test_dense_searches_take_every_twentieth_row(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id % 20 = 0").collect()]
    assert len(ids) == 25
    for name in ("dense_topk", "dense_max"):
        assert sorted(r.qid for r in QUERIES[name](spark, SMALL).select("qid").distinct().collect()) == sorted(ids), name


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def names(text):
    found = (bare(w.lower()) for w in re.findall(r"\b([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,})\b", text))
    return " ".join(dict.fromkeys(w for w in found if w not in STOP_WORDS and w not in QUESTION_WORDS))


def slug(text):
    return re.sub("[^A-Za-z0-9]+", "-", re.sub(r"[^\x00-\x7f]", "", bare(text))).strip("-").lower()[:60]


def test_names_and_slugs_of_whole_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, "a b c\nun viaje con Bolívar"), (10**6 + 1, "x" * 400 + " Cusco"), (10**6 + 2, "-" * 200 + " Título; de Ñandú")]
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    got = {r.doc_id: r.names for r in QUERIES["capitalised_names"](spark, str(tmp_path)).collect()}
    assert got == {d: names(t) for d, t in text.items()} and got[10**6] == "bolivar" and got[10**6 + 1] == "cusco"
    got = {r.doc_id: r.slug for r in QUERIES["slugs"](spark, str(tmp_path)).collect()}
    assert got == {d: slug(t) for d, t in text.items()} and got[10**6 + 2] == "titulo-de-nandu"
