"""The whole retrieval against a brute-force search over lists in memory."""

import math
import re
import unicodedata
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from gleaner.functions import wordlists as W
from gleaner.operators import index as I
from gleaner.plans import compile as C
from gleaner.plans import search as S
from gleaner.plans.queries_retrieval import questions


def tokens(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return [t for t in re.findall("[a-z0-9]+", plain) if len(t) > 2 and t not in W.STOP_WORDS]


def four(x):
    return float(Decimal(repr(round(x, 9))).quantize(Decimal("0.0001"), ROUND_HALF_UP))


class Brute:
    def __init__(self, rows, plans, reqs):
        self.b = {r.block_ix: r for r in rows}
        self.order = sorted(self.b)
        self.bag = {i: set(tokens(r.body)) for i, r in self.b.items()}
        self.full = {i: tokens(r.ctx + "\n" + r.body) for i, r in self.b.items()}
        self.ctx = {i: set(tokens(r.ctx)) for i, r in self.b.items()}
        self.plans, self.reqs = plans, reqs
        n = len(self.b)
        self.df = defaultdict(int)
        self.body_df = defaultdict(int)
        for i in self.order:
            for t in set(self.full[i]):
                self.df[t] += 1
            for t in self.bag[i]:
                self.body_df[t] += 1
        raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in self.df.items()}
        mean = sum(raw.values()) / len(raw)
        self.bm_idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
        self.avg = sum(map(len, self.full.values())) / n
        self.tf_idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in self.df.items() if 2 <= d <= 0.6 * n}
        self.vector = {i: self.weigh(self.full[i]) for i in self.order}
        self.near = {}
        docs = defaultdict(list)
        for i in self.order:
            docs[self.b[i].doc_id].append(i)
        for line in docs.values():
            for k, i in enumerate(line):
                self.near[i] = {line[k - 1] if k else None, line[k + 1] if k + 1 < len(line) else None} - {None}

    def idf(self, t):
        return math.log((len(self.b) + 1) / (self.body_df[t] + 1)) + 1

    def weigh(self, words):
        raw = {t: (1 + math.log(words.count(t))) * self.tf_idf[t] for t in set(words) if t in self.tf_idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    def frontier(self, question, kind, terms, entities, plan):
        def ranked(score, n):
            found = [(-round(s, 9), i) for i in self.order if (s := score(i)) > 0 and round(s, 9) > 0]
            return [i for _, i in sorted(found)[:n]]

        def bm25(i):
            words = self.full[i]
            return sum(self.bm_idf[t] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(words) / self.avg)) for t in terms if (f := words.count(t)))

        q = self.weigh(tokens(question if kind == "nucleo" else " ".join(terms)))
        structure = []
        if plan.week is not None:
            structure += [i for i in self.order if self.b[i].week == plan.week]
        if plan.unit is not None:
            structure += [i for i in self.order if self.b[i].unit == plan.unit]
        allowed = set(structure)
        for k in ("rector", "evaluacion") if plan.admin else ():
            structure += [i for i in self.order if self.b[i].kind == k]
        structure = list(dict.fromkeys(structure))[:20]
        lists = [
            ranked(bm25, 40), ranked(lambda i: sum(w * self.vector[i].get(t, 0) for t, w in q.items()), 40), ranked(lambda i: len(set(terms) & self.ctx[i]), 20),
            ranked(lambda i: 10 * len(set(entities) & {self.b[i].source.lower()}) + len(set(entities) & self.bag[i]), 20), structure,
        ]
        score, first = defaultdict(float), {}
        for k, line in enumerate(lists):
            for at, i in enumerate(line):
                score[i] += 1 / (61 + at)
                first.setdefault(i, (k, at))
        if allowed & set(score):
            score = {i: s for i, s in score.items() if i in allowed}
        return {i: round(s, 12) for i, s in score.items()}, first

    def cover(self, r, state):
        terms = set(r.terms)
        if not terms:
            return 0.0
        have = set().union(*(self.bag[i] for i in state))
        base = sum(map(self.idf, terms & have)) / sum(map(self.idf, terms))
        if r.kind == "causal":
            base = min(base, min(1.0, len(set(r.markers) & have) / 3))
        if r.kind == "contraste" and len({self.b[i].doc_id for i in state}) < 2:
            return 0.0
        return round(base, 9)

    def supported(self, r, state):
        return self.cover(r, state) >= (0.55 if r.kind == "nucleo" else 0.40)

    def score(self, reqs, state, union, plan=None):
        covers = [self.cover(r, state) for r in reqs]
        worst = min((c for c, r in zip(covers, reqs, strict=True) if r.mandatory), default=0.0)
        n = len(state)
        pairs = [(a, b) for k, a in enumerate(state) for b in state[k + 1 :]]
        jac = lambda a, b: len(self.bag[a] & self.bag[b]) / len(self.bag[a] | self.bag[b]) if self.bag[a] | self.bag[b] else 0.0
        red = sum(jac(a, b) for a, b in pairs) / len(pairs) if pairs else 0.0
        base = sum(union[i] for i in state) / n
        authority = sum(W.AUTHORITY[self.b[i].authority] for i in state) / n
        p = four(0.45 * len({self.b[i].doc_id for i in state}) / n + 0.30 * authority + 0.25 * min(base * 60, 1.0) - 0.40 * round(red, 9))
        if plan is not None:
            over = max(0.0, (sum(self.b[i].tokens for i in state) - plan.budget) / max(plan.budget, 1))
            p = four(p + 0.12 * sum(bool(self.near[i] & set(state)) for i in state) / n - 0.35 * min(over, 1.0))
        return (int(worst > 0), four(worst), four(sum(covers) / len(covers)), p)

    def search(self, qid):
        plan, reqs = self.plans[qid], self.reqs[qid]
        union = defaultdict(float)
        for r in reqs:
            for i, s in self.frontier(r.question, r.kind, r.terms, r.entities, plan)[0].items():
                union[i] += s
        union = {i: round(s, 12) for i, s in union.items()}
        bridges = lambda state: [i for _, i in sorted(((s, i) for i, s in union.items() if i not in state), reverse=True)[:5]]
        beam, done = [[i] for i in bridges([])], []
        for _ in range(3):
            grown = []
            for state in beam:
                missing = [r for r in reqs if r.mandatory and not self.supported(r, state)]
                if not missing:
                    done.append(state)
                    continue
                have = set().union(*(self.bag[i] for i in state))
                for r in missing:
                    if r.kind == "causal":
                        left = r.terms[:3] + [m for m in r.markers if m not in have][:6]
                    else:
                        left = list(dict.fromkeys(t for t in r.terms if t not in have)) or r.terms
                    front, first = self.frontier(r.question, r.kind, left, r.entities, plan)
                    for b in bridges(state):
                        scored = []
                        for c, s in front.items():
                            if c == b:
                                continue
                            x, y = self.bag[c], self.bag[b]
                            bonus = 0.5 * (c in self.near[b]) + 0.2 * (self.b[c].doc_id == self.b[b].doc_id)
                            if x and y:
                                j = len(x & y) / len(x | y)
                                bonus += 0.3 * j if j < 0.6 else -0.3
                            scored.append((-round(s + bonus + 0.15 * len((set(r.terms) & x) - y), 9), first[c], c))
                        grown += [state + [c] for _, _, c in sorted(scored)[:20] if c not in state]
            if not grown:
                break
            first_of: dict = {}
            for e in grown:
                first_of.setdefault(tuple(sorted(e)), e)
            unique = list(first_of.values())
            unique.sort(key=lambda e: self.score(reqs, e, union), reverse=True)
            beam, seen = [], set()
            for e in unique:
                mark = tuple(sorted({self.b[i].doc_id for i in e}))
                if mark in seen and len(beam) >= 6:
                    continue
                seen.add(mark)
                beam.append(e)
                if len(beam) >= 12:
                    break
            if done:
                break
        return max(done + beam, key=lambda e: self.score(reqs, e, union, plan)), union

    def packed(self, qid):
        proof, union = self.search(qid)
        plan = self.plans[qid]
        state = list(proof)
        held = defaultdict(int)
        for i in state:
            held[self.b[i].doc_id] += 1
        total = sum(self.b[i].tokens for i in state)
        order = sorted(union, key=lambda i: (-union[i], i))
        for fresh in (True, False) if plan.kind != "puntual" else ():
            for i in order:
                d, t = self.b[i].doc_id, self.b[i].tokens
                if len(state) >= W.FRAGMENTS[plan.kind] or i in state or (fresh and held[d]) or held[d] >= plan.quota or total + t > int(plan.budget * 0.92):
                    continue
                state.append(i)
                held[d] += 1
                total += t
        out, used, held = [], 0, defaultdict(int)
        for i in sorted(state, key=lambda i: (-union[i], i)):
            d, t = self.b[i].doc_id, self.b[i].tokens
            if held[d] >= plan.quota or (used + t > plan.budget and out):
                continue
            held[d] += 1
            used += t
            out.append(i)
        says = [self.supported(r, proof) for r in self.reqs[qid]]
        return out, used, "ANSWER" if all(says) else "PARTIAL"


def test_retrieval_equals_brute_force(spark):
    index = I.build(spark, SMALL)
    asked = questions(spark, SMALL).filter("qid IN (0, 1, 2, 1001, 1002, 1003, 1004, 1005, 1008, 1009, 1010)")
    plan = C.plans(asked, index)
    reqs = defaultdict(list)
    for r in C.requirements(plan, index).orderBy("qid", "rid").collect():
        reqs[r.qid].append(r)
    brute = Brute(index.blocks.collect(), {p.qid: p for p in plan.collect()}, reqs)
    got = {r.qid: r for r in S.retrieve(asked, index).collect()}
    assert set(got) == set(brute.plans)
    searched = 0
    for qid, r in got.items():
        if r.reason is not None:
            assert r.blocks == [] and r.decision == "INSUFFICIENT"
            continue
        blocks, used, said = brute.packed(qid)
        assert (r.blocks, r.tokens, r.decision) == (blocks, used, said), qid
        searched += 1
    assert searched >= 4


@pytest.mark.parametrize("text,mode", [("", "x"), ("   ", None), ("?" * 500, "debate"), ("'; DROP TABLE blocks; --", "resumen"), ("<b>x</b>", "otro"), ("😀😀", "repasar"), ("hola " * 200, "evaluar")])
def test_hostile_questions_do_no_harm(spark, text, mode):
    from gleaner.operators.answers import valid_request

    index = I.build(spark, SMALL)
    df = spark.createDataFrame([(1, text, mode)], "qid long, question string, mode string")
    q, m = valid_request(F.col("question"), F.col("mode"))
    row = df.select(q.alias("q"), m.alias("m")).first()
    assert row.m in ("preguntar", "debate", "resumen", "repasar", "evaluar") and (row.q is None) == (not text.strip())
    assert C.plans(df.select("qid", "question"), index).count() == 1
