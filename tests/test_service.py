"""The facade and what it stands on: tries and reserves, warm-up, reports, kept indexes, answers with a model, texts found in texts."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from gleaner.functions.prompts import COMPLEMENTS, CORE, system_prompt
from gleaner.operators import evaluate as V
from gleaner.operators import index as I
from gleaner.operators import rank as R
from gleaner.operators.answers import MODES
from gleaner.plans import compile as C
from gleaner.plans import search as S
from gleaner.plans import service as SV
from gleaner.sources import connectors as K
from gleaner.sources import corpus


class Flaky:
    """Fails with the given messages, then answers."""

    def __init__(self, *messages):
        self.left, self.calls = list(messages), 0

    def __call__(self, *args):
        self.calls += 1
        if self.left:
            raise RuntimeError(self.left.pop(0))
        return "done"


def test_tries():
    waits = []
    assert K.tried(Flaky("503", "rate limit"), sleep=waits.append) == "done"
    assert len(waits) == 2 and 1.5 <= waits[0] <= 2.0 and 3.0 <= waits[1] <= 3.5
    for failing, calls in ((Flaky("invalid key"), 1), (Flaky("503", "503", "503"), 3)):
        with pytest.raises(RuntimeError):
            K.tried(failing, sleep=waits.append)
        assert failing.calls == calls
    quiet = lambda _: None
    assert K.with_reserve(Flaky("503", "503", "503"), Flaky("429"), sleep=quiet) == ("done", "reserve")
    assert K.with_reserve(Flaky(), Flaky(), sleep=quiet) == ("done", "model")
    reserve = Flaky()
    with pytest.raises(RuntimeError):
        K.with_reserve(Flaky("invalid key"), reserve, sleep=quiet)
    assert reserve.calls == 0


def test_warm_up_stops_after_failures_in_a_row(spark):
    asked = spark.createDataFrame([(f"q{i:02d}",) for i in range(20)] * 2 + [(None,), (" ",)], "text string")
    stored = spark.createDataFrame([("q00", [1.0], "a"), ("q01", [1.0], "b")], "text string, vector array<double>, provider string")

    def embed(text):
        if text in ("q02", "q04") or text >= "q08":
            raise RuntimeError("quota")
        return [2.0]

    got = sorted(r.text for r in K.warm_up(asked, stored, embed, "a").collect())
    assert got == ["q01", "q03", "q05", "q06", "q07"]
    assert K.warm_up(asked.limit(0), None, embed, "a").collect() == []


def test_cached_vectors(spark, tmp_path):
    assert K.cached_vectors(spark, str(tmp_path / "none"), "a").collect() == []
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"no parquet")
    assert K.cached_vectors(spark, str(tmp_path / "broken"), "a").collect() == []
    rows = spark.createDataFrame([("q", [1.0], "a"), ("q", [2.0], "b")], "text string, vector array<double>, provider string")
    rows.write.parquet(str(tmp_path / "good"))
    assert [r.vector for r in K.cached_vectors(spark, str(tmp_path / "good"), "b").collect()] == [[2.0]]


def test_report_and_results(spark, tmp_path):
    docs, blocks = corpus.documents(spark, SMALL), corpus.blocks(spark, SMALL)
    K.write_report(K.report(docs, blocks, corpus.weeks(spark)), str(tmp_path / "report"))
    lines = [line for p in (tmp_path / "report").glob("*.txt") for line in p.read_text().splitlines()]
    assert lines[0] == "CORPUS" and f"documents {docs.count():,}" in lines[1] and [x for x in lines if not x.startswith(" ")][2:] == ["BY KIND", "BY WEEK", "LARGEST DOCUMENTS"]
    assert len(lines) == 5 + docs.select("kind").distinct().count() + 14 + 8
    K.write_results(spark.createDataFrame([(1, ["a"])], "qid int, blocks array<string>"), str(tmp_path / "results"))
    assert [json.loads(x) for p in (tmp_path / "results").glob("*.json") for x in p.read_text().splitlines()] == [{"qid": 1, "blocks": ["a"]}]


def test_steps_stop_at_a_critical_failure():
    done = []
    steps = [("a", lambda: done.append("a"), True), ("b", lambda: 1 / 0, False), ("c", lambda: 1 / 0, True), ("d", lambda: done.append("d"), True)]
    got = K.run_steps(steps)
    assert [(n, e.split(":")[0]) for n, e in got] == [("a", "ok"), ("b", "ZeroDivisionError"), ("c", "ZeroDivisionError")] and done == ["a"]


def test_system_prompts():
    assert set(COMPLEMENTS) == set(MODES) and len(set(COMPLEMENTS.values())) == 8
    assert all(system_prompt(m).startswith(CORE) for m in (*MODES, None, "otro")) and system_prompt("otro") == system_prompt("preguntar")


def test_a_saved_index_gives_the_same_rankings(spark, tmp_path):
    index = I.of(spark, SMALL)
    assert I.of(spark, SMALL) is index
    index.save(str(tmp_path / "index"))
    again = I.load(spark, str(tmp_path / "index"))
    reqs = spark.createDataFrame([(1, "r1", "nucleo", "the tionthe", ["tionthe", "eran"], [])], "qid long, rid string, kind string, question string, terms array<string>, entities array<string>")
    plan = spark.createDataFrame([(1, 3, None, True)], "qid long, week int, unit int, admin boolean")
    for a, b in zip(R.signals(reqs, plan, index).values(), R.signals(reqs, plan, again).values(), strict=True):
        key = lambda df: sorted((r.rank, r.block_ix) for r in df.collect())
        assert key(a) == key(b)
    rows = index.postings.filter("block_ix < 20 * 1048576").collect()
    from test_search import tokens

    blocks = {r.block_ix: r for r in index.blocks.filter("block_ix < 20 * 1048576").collect()}
    for i, b in blocks.items():
        ctx, body = tokens(b.ctx), tokens(b.body)
        own = {r.term: (r.tf, r.ctf, r.dl) for r in rows if r.block_ix == i}
        assert own == {t: ((ctx + body).count(t), ctx.count(t), len(ctx + body)) for t in set(ctx + body)} and b.terms == body


def test_vectors_rank_and_gate(spark):
    """A question with a vector is ranked and gated by it, whatever its words; one without keeps its words."""
    index = I.of(spark, SMALL)
    some = index.blocks.orderBy("block_ix").limit(60).select("block_ix").collect()
    unit = lambda i: [1.0, 0.0] if i % 3 == 0 else [0.6, 0.8] if i % 3 == 1 else [0.0, 1.0]
    blocks = spark.createDataFrame([(r.block_ix, unit(i)) for i, r in enumerate(some)], "block_ix long, vector array<double>")
    asked = spark.createDataFrame([(1, "zzzz qqqq wwww"), (2, "zzzz qqqq wwww"), (3, "the tionthe")], "qid long, question string")
    vectors = R.Vectors(blocks, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "qid long, vector array<double>"))
    near = {r.qid: r.similarity for r in R.similarity(vectors, index).collect()}
    assert near == {1: 1.0, 2: 0.0}  # blocks without a vector have 0
    plan = C.plans(asked, index)
    reqs = C.requirements(plan, index)
    meant = R.signals(reqs, plan, index, vectors=vectors)["dense"].filter("rid = 'r1'").collect()
    first = [r.block_ix for r in sorted(meant, key=lambda r: r["rank"]) if r.qid == 1]
    assert first == [r.block_ix for i, r in enumerate(some) if i % 3 == 0] + [r.block_ix for i, r in enumerate(some) if i % 3 == 1]
    assert not [r for r in meant if r.qid == 2]
    words = R.signals(reqs, plan, index)["dense"].filter("rid = 'r1' AND qid = 3").collect()
    assert sorted((r.block_ix, r.score) for r in meant if r.qid == 3) == sorted((r.block_ix, r.score) for r in words)
    reasons = {r.qid: r.reason for r in S.retrieve(asked, index, vectors).collect()}
    assert reasons[2] in ("other_topic", "unknown_terms") and set(reasons) == {1, 2, 3}


def test_ask(spark):
    index = I.of(spark, SMALL)
    question = "¿Qué se ve en la semana 3?"  # a week's questions always are in scope
    rows = [(1, question, "preguntar"), (2, question, "repasar"), (3, "  ", "debate"), (4, "quantum chromodynamics lagrangian", "otro"), (5, None, None), (6, question, "practicar")]
    requests = spark.createDataFrame(rows, "qid long, question string, mode string")

    def model(system, user):
        assert "EVIDENCE" in user
        if "TARJETA" in system:
            return "TARJETA_PREGUNTA: uno\nTARJETA_RESPUESTA: dos [1]"
        if "OPCION" in system:
            raise RuntimeError("invalid key")
        return "texto [1]"

    got = {r.qid: r for r in SV.ask(requests, index, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1].answer == "texto [1]" and got[1].by == "model" and got[1].parsed is None and got[1].decision in ("ANSWER", "PARTIAL")
    assert json.loads(got[2].parsed)["answer"] == "dos [1]" and got[2].system == system_prompt("repasar")
    assert got[3].error == got[5].error == "no question" and got[3].contract is None
    assert got[4].decision == "INSUFFICIENT" and got[4].mode == "preguntar" and got[4].contract.evidence == [] and got[4].user is None and got[4].answer is None
    assert got[6].answer is None and got[6].error.startswith("RuntimeError")
    c = got[1].contract
    assert [e.id for e in c.evidence] == [f"ev_{i + 1}" for i in range(len(got[1].blocks))] and [p.block_ix for p in got[1].packages] == got[1].blocks
    assert c.question == question and {r.status for r in c.requirements} <= {"SUPPORTED", "MISSING"} and all(r.support_ids == [e.id for e in c.evidence] for r in c.requirements)
    assert c.unmet_requirements == got[1].missing and c.coverage == got[1].coverage
    assert all(len(p.extract) <= 600 for p in got[1].packages) and "answer" not in SV.ask(requests.limit(1), index).columns
    assert SV.info(index).first().blocks == index.blocks.count()


def test_contained_equals_brute_force(spark):
    docs = [(1, "a b c d e f g h"), (2, "xa b c d e f gx\nz"), (3, "a b  c"), (4, ""), (5, None), (6, "b\nc d e f g h i"), (7, "a b c d e f g h a b c d e f g h")]
    bank = [(1, "a b c d e f g"), (2, "b c"), (3, ""), (4, "c d e f g h i j"), (5, None), (6, "b  c"), (7, "a b c d e f"), (8, "zz zz zz zz zz zz zz"), (9, "c d e f g h")]
    d = spark.createDataFrame(docs, "doc long, text string")
    b = spark.createDataFrame(bank, "item long, text string")
    want = sorted((i, k) for i, s in bank for k, t in docs if s is not None and t is not None and s in t)
    assert sorted((r.item, r.doc) for r in V.contained(b, d, "item", "doc").collect()) == want
    found = V.contained(spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", F.col("text")), spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "item_id", "doc_id")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == sorted((r.item_id, k) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for k, t in texts.items() if r.text in t)
