"""Each operator on small rows with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import base64
import functools
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import archive, bpe, exact_dedup, katz, language_id, metric_tree, mixing, near_dedup, token_files, url_filter
from gleaner.llm.shared import retain, ship

FORM = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def prose(n, seed, letters="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n))


def documents():
    base = prose(200, 1)
    words = base.split()
    near = " ".join(["x" if i == 100 else w for i, w in enumerate(words)])
    rows = [
        (1, base, "en", "a", 0), (2, base, "en", "a", 0), (3, base.replace(" ", "\n\t "), "fr", "b", 0), (4, near, "en", None, 0), (5, near + " y", "en", "b", 0),
        (6, None, None, "a", 0), (7, "", "en", "c", 0), (8, " \n", None, "c", 0), (9, "één wörd", "de", "a", 0), (None, "no id here", "en", "a", 0), (None, None, None, None, None),
        (10, prose(3000, 2), "fr", "a", 0), (11, "x" * 30_000, "en", "b", 0), (12, "12 34 !!", "en", "b", 0), (13, "one two", "en", "c", 0), (13, "one two", "en", "c", 0), (14, "<|endoftext|> it's  a\n\n b c ", "en", "c", 0),
    ]
    return rows + [(100 + i, prose(60, 50 + i), "en" if i % 2 else "fr", "abc"[i % 3], 0) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    # columns that an operator may use for itself
    rows = [(*r, 1, "k", 2, 3.0, "b") for r in documents()]
    return spark.createDataFrame(rows, FORM + ", key int, kept string, uid int, score double, bucket string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def bare(text):
    return BLANK.sub("", text or "")


def expected_groups():
    groups = defaultdict(list)
    for d, text, *_ in documents():
        groups[bare(text)].append((d, len(text or "")))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(d, keep[0], len(members), hashlib.sha256(text.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=repr)


def test_exact_groups(docs, empty):
    got = exact_dedup.decisions(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected_groups()
    assert sum(r.kept for r in got) == len({bare(t) for _, t, *_ in documents()})
    assert exact_dedup.decisions(empty).collect() == []


def test_colliding_fingerprints_are_told_apart(docs):
    """With tiny moduli different texts of one length share fingerprints; the comparison splits them."""
    got = exact_dedup.groups(docs, moduli=(2, 2, 2, 2)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected_groups()


def test_huge_texts_take_the_chunk_rows(docs):
    got = exact_dedup.groups(docs, huge=1000).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected_groups()


def test_fingerprints_combine():
    data = bytes(random.Random(3).randbytes(200_000))
    whole = exact_dedup.fingerprint(data)
    for cut in (0, 1, 77, 100_000):
        assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])) == whole
    assert exact_dedup.fingerprint(b"\0a") != exact_dedup.fingerprint(b"a")


def shingles(text):
    w = [x for x in BLANK.split(text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_classes(docs, empty):
    rows = documents()
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = defaultdict(list)
    for x, r in zip(label, rows, strict=True):
        ids[x].append(r[0])
    want = sorted(((r[0], min((d for d in ids[x] if d is not None), default=None), len(ids[x])) for x, r in zip(label, rows, strict=True)), key=repr)
    got = near_dedup.decisions(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(ids)
    assert near_dedup.decisions(empty).collect() == []


def test_near_copies_in_chains(spark):
    """A class whose members are alike only to their neighbours, and a large star, lose no link."""
    ship(spark)
    words = prose(120, 9).split()
    chain = [" ".join([f"n{k}" if i < 4 * k else w for i, w in enumerate(words)]) for k in range(6)]
    star = prose(100, 10).split()
    edited = [" ".join(f"e{k}" if i == 5 + k % 90 else w for i, w in enumerate(star)) for k in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chain + edited)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.decisions(df).collect()}
    sets = [shingles(t) for t in chain + edited]
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert got[i] == got[j]


def test_signatures_estimate_weighted_jaccard():
    """Coordinates agree with the probability of the weighted Jaccard similarity."""
    r = np.random.default_rng(1)
    element = r.integers(0, 1 << 40, 300).astype(np.uint64)
    a, b = r.integers(1, 9, 300).astype(float), r.integers(1, 9, 300).astype(float)
    b[:100] = a[:100]
    sig = near_dedup.signatures(np.repeat([0, 1], 300), np.concatenate([element, element]), np.concatenate([a, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_counted_shingles(spark):
    ship(spark)
    a = " ".join(["a b c d e f g"] * 20)
    df = spark.createDataFrame([(1, a), (2, " ".join(["a b c d e f g"] * 30))], "doc_id long, text string")
    assert len({r.class_id for r in near_dedup.classes(df).collect()}) == 1
    assert len({r.class_id for r in near_dedup.classes(df, counted=True).collect()}) == 2


def test_retain_keeps_one_of_equal_rows(docs):
    out = retain(docs, exact_dedup.groups(docs))
    assert out.columns == docs.columns
    assert out.count() == len({bare(t) for _, t, *_ in documents()})


CLASHES = "_k long, _id long, _key string, _n int, _s string, _r int, _time int, row int, form string, n long, r int, times long, kept_id long, kept_key long, own_id long, `a.b` int, carried string"


def clashing(spark, rows):
    """Documents (doc_id, text, source) whose other columns carry names that an operator may use, with values of their own."""
    kinds = [c.split()[1] for c in CLASHES.split(", ")]
    more = lambda i: tuple(f"v{i}" if k == "string" else 7 * i + j for j, k in enumerate(kinds))
    return spark.createDataFrame([(*r, *more(i)) for i, r in enumerate(rows)], "doc_id long, text string, source string, " + CLASHES)


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_other_columns_of_any_name_come_through(spark):
    ship(spark)
    a, b = prose(40, 1), prose(40, 2)
    rows = [(1, a, "s"), (2, a, "s"), (3, b, "t"), (3, b, "t"), (3, b, "t"), (None, None, None), (None, None, None), (4, prose(40, 3), "s")]
    docs = clashing(spark, rows)
    given = {tuple(r) for r in docs.collect()}
    for decide in (exact_dedup.groups, near_dedup.classes):
        out = retain(docs, decide(docs))
        assert out.columns == docs.columns
        got = as_tuples(out)
        # of nulls, empty texts are equal for the one and alike to nothing for the other; rows equal in id and text are one
        assert set(got) <= given and [g[0] for g in got if g[0]] == [1, 3, 4] and sum(g[0] is None for g in got) == 1
        assert got == as_tuples(retain(docs.repartition(7), decide(docs.repartition(5))))
    mixed = mixing.mixture(docs, weights=(1, 1))
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= given
    assert as_tuples(mixed) == as_tuples(mixing.mixture(docs.repartition(6), weights=(1, 1)))


def test_mixture_takes_each_variant_of_equal_rows(spark):
    """Rows that are the same in id, source and text but not in other columns all take part in complete epochs."""
    ship(spark)
    docs = clashing(spark, [(1, "a b c", "s")] * 4 + [(2, "a b c", "t")] * 4)
    got = Counter(tuple(r) for r in mixing.mixture(docs, weights=(3, 1)).collect())
    taken = sum(r.taken for r in mixing.mix(docs, weights=(3, 1)).collect())
    assert sum(got.values()) * 3 == taken
    assert len([r for r in got if r[2] == "s"]) == 4 and all(got[r] in (1, 2) for r in got if r[2] == "s")


def best_of(rows, width, k=20, every=20):
    """Brute force in Python's integers: (query, rank, vector, score) of the best of all others."""
    good = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(64 * x) for x in v] + [0] * (width - len(v))))
    want = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), j) for j, x in good if j != i)[:k]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("tree", [metric_tree.TREE, 90])
def test_top_k(spark, monkeypatch, tree):
    """tree = 90: many regions, blocks and visits."""
    ship(spark)
    for name, size in (("TREE", tree), ("QUERIES", 9 if tree < 100 else 512), ("FOREST", 3)):
        monkeypatch.setattr(metric_tree, name, size)
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], 0) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8, 0) for i in range(60)] + [(2000, None, 0), (2020, [None] * 8, 0), (2040, [float("nan")] * 8, 0), (2060, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), (2080, [], 0), (2100, [0.25] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    ask = lambda d: sorted((x.query_id, x.rank, x.vec_id, x.score) for x in metric_tree.neighbours(d).collect())
    assert ask(df) == best_of(rows, 8)
    if tree < 100:
        return
    assert ask(df.limit(0)) == []
    assert ask(df.filter("vec_id = 20")) == []
    assert ask(df.filter("vec_id IN (2080, 2100)")) == [(2080, 1, 2100, 0), (2100, 1, 2080, 0)]


def test_top_k_of_large_components(spark):
    """Products of up to, and beyond, 53 and 64 bits are exact (or held at the bounds), and no vector is lost."""
    ship(spark)
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(100)] + [(100 + i, [r.uniform(-1, 1) * 10.0 ** r.choice([4, 6, 7]) for _ in range(4)]) for i in range(60)]
    rows += [(200, [300000.0, 1.0, 0.0, 0.0]), (220, [1e30, -1e30, 1.0, 0.0]), (221, [1e20, 1.0, 0.0, 0.0]), (240, [-1e12, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in metric_tree.neighbours(df).collect()) == best_of(rows, 4)


def test_repeated_vectors_and_ids(spark):
    ship(spark)
    rows = [(i % 7 * 20, [1.0, float(i % 3)]) for i in range(60)] + [(500 + i % 30, [1.0, 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in metric_tree.neighbours(df).collect())
    assert got == best_of(rows, 2)


def searched(x, queries, k=10, limit=np.inf):
    import pyarrow as pa

    space = metric_tree.Space((x * x).sum(1).max())
    sink = pa.BufferOutputStream()
    metric_tree.stored(x, [np.array([i]) for i in range(len(x))], metric_tree.build(x, space), sink)
    tree = metric_tree.Tree(sink.getvalue(), x.shape[1])
    s = metric_tree.Search(space, queries, np.full(len(queries), -1), k, np.full(len(queries), limit))
    s.run([tree], [np.zeros(len(queries))])
    return s, tree


def test_tree_pages_cover():
    r = np.random.default_rng(2)
    x = r.integers(-64, 64, (3000, 6)).astype(float)
    x[:400] = x[0]
    space = metric_tree.Space((x * x).sum(1).max())
    pages = metric_tree.build(x, space)
    below = lambda p: p["rows"] if p["child"][0] < 0 else np.concatenate([below(pages[c]) for c in p["child"]])
    assert sorted(below(pages[0]).tolist()) == list(range(3000))
    for p in pages:
        for row, radius, child in zip(p["rows"], p["radius"], p["child"], strict=True):
            if child >= 0:
                assert space.between(x[below(pages[child])], x[row]).max() <= radius + 1e-9
                assert np.allclose(space.between(x[pages[child]["rows"]], x[row]), pages[child]["to_parent"])


def test_search_prunes_where_vectors_lie_in_groups():
    r = np.random.default_rng(3)
    middle = r.integers(-64, 64, (60, 16))
    x = (middle[r.integers(0, 60, 12_000)] + r.integers(-3, 4, (12_000, 16))).astype(float)
    q = x[:: 20]
    s, tree = searched(x, q)
    want = -np.sort(-(q @ x.T), 1)[:, :10]
    assert (s.score == want).all()
    assert s.computed < 0.2 * len(q) * len(x)
    one, tree = searched(x, q[:1])
    assert (one.score == want[:1]).all() and len(tree.read) < 0.5 * tree.file.num_record_batches


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_scores(docs, empty, order):
    """Scores against the recursion written out, each context's probabilities summed over all words."""
    rows = documents()
    words = lambda t: [x.lower() for x in BLANK.split(t or "") if x] + [None]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, *_ in rows]
    grams = [Counter() for _ in range(order + 1)]  # by length, of histories of that length less one with a word
    for r, h in zip(rows, held, strict=True):
        past = ["<s>"]
        for w in () if h else words(r[1]):
            for m in range(1, min(order, len(past) + 1) + 1):
                grams[m][(*past[len(past) - m + 1 :], w)] += 1
            past.append(w)
    one = {w: c for (w,), c in grams[1].items()}
    n, v = sum(one.values()), len(one)
    contexts = [Counter() for _ in range(order + 1)]
    after = [defaultdict(list) for _ in range(order + 1)]
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            contexts[m][g[:-1]] += c
            after[m][g[:-1]].append(g[-1])

    def discount(counts):
        c = Counter(counts.values())
        return katz.Discounts.good_turing([c[r] for r in range(katz.K + 2)]).d

    d = [None, *(discount(g) for g in grams[1:])]
    of = lambda m, c: d[m][min(c, katz.K + 1)]
    unknown = sum((1 - of(1, c)) * c for c in one.values()) / n

    @functools.cache
    def weights(h):
        m, c = len(h) + 1, contexts[len(h) + 1][h]
        rest = sum((1 - of(m, grams[m][(*h, w)])) * grams[m][(*h, w)] for w in after[m][h]) / c
        scale = 1.0
        if rest <= 1e-12:
            rest, scale = 1 / (c + 1), c / (c + 1)
        return rest / (1 - sum(p(h[1:], w) for w in after[m][h])), scale

    def p(h, w):
        m = len(h) + 1
        if not h:
            return of(1, one[w]) * one[w] / n if w in one else unknown
        if h not in contexts[m]:
            return p(h[1:], w)
        alpha, scale = weights(h)
        c = grams[m][(*h, w)]
        return scale * of(m, c) * c / contexts[m][h] if c else alpha * p(h[1:], w)

    for m in range(2, order + 1):
        for h in list(contexts[m])[:20]:
            assert abs(sum(p(h, w) for w in one) + p(h, "never seen") - 1) < 1e-9
    want = []
    for r, h in zip(rows, held, strict=True):
        s, past = 0.0, ["<s>"]
        for w in words(r[1]):
            s += math.log10(p(tuple(past[max(0, len(past) - order + 1) :]), w))
            past.append(w)
        base = sum(math.log10((one.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words(r[1]))
        want.append((r[0], h, len(words(r[1])), sum(w in one for w in words(r[1])), n, round(base, 6), round(s, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.held_out_scores(docs, order).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert katz.held_out_scores(empty, order).collect() == []


def test_repeated_integers():
    for x in ([], [7], [5, 5, 5, 1 << 40] * 30, list(range(50)), [3, 1, 2] * 100):
        assert katz.unpack_repeated(katz.pack_repeated(np.array(x, np.uint64))).tolist() == x


def test_katz_frequent_contexts(spark, monkeypatch):
    """Contexts, of one word and of two, that are dealt over all buckets: the scores are those of a few large buckets."""
    r = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(r.choices("abcde", (9, 4, 2, 1, 1), k=40))) for i in range(9)], "doc_id long, text string").repartition(2)
    want = {x.doc_id: x.score for x in katz.held_out_scores(df, 3).collect()}
    monkeypatch.setattr(katz, "GRAM_BUCKET", 15)
    frequent, found = katz._frequent, []
    monkeypatch.setattr(katz, "_frequent", lambda *a: found.append(frequent(*a)) or found[-1])
    got = {x.doc_id: x.score for x in katz.held_out_scores(df, 3).collect()}
    assert len(found) == 2 and all(map(len, found))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_katz_keeps_answers_once(spark, tmp_path):
    """When the last order is scored, what the orders below told lies only in the chunks' files; contexts' sums and last ids aren't sent."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(r.choices("abcdefgh", k=60))) for i in range(40)], "doc_id long, text string").repartition(3)
    ship(spark)
    out = katz.score(df, F.col("doc_id") % 10 == 0, 4, f"file://{tmp_path}")
    answers = []
    for folder in (d for d in tmp_path.iterdir() if list(d.glob("part-*.parquet"))):
        table = spark.read.parquet(str(folder))
        if "totals" in table.columns:
            answers.append(table.agg(F.expr("count_if(chunk >= 0)"), F.expr("count_if(chunk < 0 AND table_words IS NOT NULL)"), F.count("ranks")).first())
    assert sorted(a[0] > 0 for a in answers) == [False, False, True]  # a table for each order above one
    assert all(a[1] > 0 for a in answers) and not any(a[2] for a in answers)
    assert "over" not in [x.split()[0] for x in katz._ASK.split(",")]
    assert out.count() == 40


def test_good_turing_by_hand():
    """Katz's discounts from counts of counts, by exact fractions; where they don't exist, fewer counts are discounted."""
    from fractions import Fraction

    n = [0, 1000, 400, 220, 140, 100, 75]
    common = Fraction(6 * n[6], n[1])
    want = [(Fraction((r + 1) * n[r + 1], r * n[r]) - common) / (1 - common) for r in range(1, 6)]
    assert all(0 < w <= 1 for w in want)
    d = katz.Discounts.good_turing(n).d
    assert np.allclose(d[1:6], [float(w) for w in want]) and d[6] == 1.0
    # what the discounts take away is what Good-Turing gives to the unseen, n1
    assert np.isclose(sum((1 - d[r]) * r * n[r] for r in range(1, 6)), n[1])
    # without counts of four only one and two are discounted
    top = Fraction(3, 10)
    d = katz.Discounts.good_turing([0, 10, 4, 1, 0, 0, 0]).d
    assert np.allclose(d[1:4], [float((Fraction(8, 10) - top) / (1 - top)), float((Fraction(3, 8) - top) / (1 - top)), 1.0])


def test_katz_without_training(spark):
    ship(spark)
    out = katz.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), __import__("pyspark").sql.functions.lit(True)).collect()
    assert [(r.score, r.base_score, r.train_tokens) for r in out] == [(0.0, 0.0, 0)] * 2


def test_archives(spark):
    ship(spark)
    rows = [(1, "http://a.com/x y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b.net/", None), (4, "", ""), (5, "http://c.org/", "é" * 50_000), (None, "http://d.org/", "<p>same</p>"), (6, "http://e.org/", "HTTP/1.1 \n\n{}"), (6, "http://e.org/", "HTTP/1.1 \n\n{}")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, rid int").repartition(3)
    got = archive.round_trip(df).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        to = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None))
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to if r.record_type == "revisit" else r.page_id) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.record_type == "response" for r in got) == len({h or "" for _, _, h in rows})
    assert all(r.record_type == "response" for r in archive.round_trip(df, least=1 << 30).collect())
    assert archive.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    content = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nwith lines"
    fields = {"URL": "http://a.com/", "IP-address": "1.2.3.4", "Archive-date": "19970102030405", "Content-type": "text/html", "Result-code": "200"}
    block = archive.arc_version_block(version, "x.arc", "19970102030405")
    plain = block + archive.arc_record(version, fields, content) + archive.arc_record(version, {**fields, "URL": "dns:a.com", "Content-type": "text/dns"}, b"a.com IN A 1.2.3.4")
    for data in (plain, archive.member(plain)):
        records = list(archive.read_arc(data))
        assert [r[0]["URL"] for r in records] == ["filedesc://x.arc", "http://a.com/", "dns:a.com"] and records[1][1] == content
    kinds = []
    for f, c in records:
        (head, body), = archive.read_warc(archive.convert_record(f, c, archive.record_id(f["URL"])))
        kinds.append(head["warc-type"])
        assert head["warc-date"] == "1997-01-02T03:04:05Z" and (kinds[-1] == "warcinfo" or body == c)
    assert kinds == ["warcinfo", "response", "response"]


def test_languages(spark, docs, empty):
    ship(spark)
    r = random.Random(5)
    make = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(3, 7))) for _ in range(n))
    kinds = {"aa": "abcdeg", "bb": "fghijé", "cc": "klmnop"}
    rows = [(i, make(kinds[k], 30), k) for i, k in enumerate(list(kinds) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.held_out_predictions(df).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    odd = {(x.doc_id, x.lang_pred) for x in language_id.held_out_predictions(docs).collect() if x.doc_id in (6, 7, 8, 12)}
    assert odd == {(6, "und"), (7, "und"), (8, "und"), (12, "und")}
    assert language_id.held_out_predictions(empty).collect() == []
    assert {x.lang_pred for x in language_id.held_out_predictions(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None)).collect()} <= {"und", ""}
    assert language_id.accepted(df).count() == len(rows)
    assert language_id.accepted(docs).filter("doc_id IN (6, 7, 8, 12)").count() == 0


def letter_grams(text):
    """Letters, pairs and triples of each lower-cased word, with its edges."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = "^" + word + "^"
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_language_codes_decoded_by_hand(spark):
    """Counts, classifiers, margins, losses and scores in plain dictionaries, for languages that share half of their letters."""
    ship(spark)
    r = random.Random(11)
    kinds = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnab", "dd": "mnopefgh"}
    rows = [(i, " ".join("".join(r.choices(kinds[k], k=r.randint(2, 6))) for _ in range(r.randint(1, 12))), k) for i, k in enumerate(list(kinds) * 60)]
    counts = {k: Counter() for k in kinds}
    for i, text, k in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[k].update(letter_grams(text))
    # an n-gram is known by its bucket; here no two of these that differ share one
    n, add = language_id.BUCKETS, language_id.ADD
    share = lambda k, g: (counts[k][g] + add) / (sum(counts[k].values()) + add * n)
    every = set().union(*counts.values())
    names = sorted(kinds)
    bits = []
    for s in range(1, 8):
        one, zero = ([k for i, k in enumerate(names) if (s >> i & 1) == v] for v in (1, 0))
        p = lambda g, side: sum(share(k, g) for k in side) / len(side)
        rest = lambda side: sum(add / (sum(counts[k].values()) + add * n) for k in side) / len(side)
        weight = {g: math.log(p(g, one)) - math.log(p(g, zero)) for g in every}
        empty_weight, empty = math.log(rest(one)) - math.log(rest(zero)), n - len(every)
        up = sum(p(g, one) * weight[g] for g in every) + empty * rest(one) * empty_weight
        down = sum(p(g, zero) * weight[g] for g in every) + empty * rest(zero) * empty_weight
        bits.append((s, weight, empty_weight, (up + down) / 2, up - down))
    want = {}
    for i, text, _ in rows:
        grams = letter_grams(text)
        margin = [sum(c * (w.get(g, e) - middle) for g, c in grams.items()) / sum(grams.values()) for _, w, e, middle, _ in bits]
        whole = sum(b[4] for b in bits)
        loss = [sum(b[4] / whole * math.log1p(math.exp(-language_id.STEEP * m / (b[4] / 2) * (1 if b[0] >> j & 1 else -1))) for b, m in zip(bits, margin, strict=True)) for j in range(4)]
        best = min(range(4), key=lambda j: loss[j])
        want[i] = (names[best], 1 / sum(math.exp(8 * (loss[best] - x)) for x in loss))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.held_out_predictions(df).collect()}
    assert [i for i in want if got[i].lang_pred != want[i][0]] == []
    assert max(abs(got[i].score - want[i][1]) for i in want) < 1e-3
    out = language_id.classify(df.withColumn("carried", df.lang), language_id.fit(df), ["doc_id", "text", "carried"]).collect()
    assert sorted((x.doc_id, x.text, x.carried) for x in out) == sorted(rows)


@pytest.mark.parametrize("n", [2, 4, 7, 40])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n and all(len(set(b)) == 2 for b in code.T)


def test_urls(spark):
    ship(spark)
    r = random.Random(6)
    good = [f"http://site{r.randint(0, 99)}.com/page/{r.randint(0, 999)}" for _ in range(200)]
    bad = [f"http://x{r.randint(0, 99)}.net/{r.choice(['es', 'fr'])}/q?z={r.randint(0, 999)}" for _ in range(200)]
    special = ["http://example.com/en/a", "http://www.example.com/en/b", "HTTP://A.EXAMPLE.COM/en/", "http://example.com", "http://notcom/", "no scheme", None, "", "http://x.org/page/7", "http://y.net:80/es/", "http://u@z.net/es/?a#b", "http://k.net/fr/x?com/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(good + bad + special)], "page_id long, url string, host string")
    got = {x.page_id: x for x in url_filter.judge(df).collect()}
    rules = [(v, h, p) for v, h, p in url_filter.RULES]
    for i, u in enumerate(good + bad + special):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] + best[2] if best else None)
        assert got[i].verdict == best[0] if best else got[i].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).collect() == []
    assert {x.verdict for x in url_filter.judge(df.filter("url LIKE '%.org%'")).collect()} == {"allow"}


def test_url_models_tell_held_out_urls():
    r = random.Random(7)
    make = lambda kind, n: [f"http://{kind}{r.randint(0, 9999)}.{kind}.org/{kind}/{r.randint(0, 999)}" for _ in range(n)]
    pack = lambda urls: (np.frombuffer("".join(urls).encode(), np.uint8), np.cumsum([0, *map(len, urls)]))
    model = url_filter.UrlModel(url_filter.Markov.fit(*pack(make("news", 300))), url_filter.Markov.fit(*pack(make("spam", 300))))
    assert (model.scores(*pack(make("news", 100))) > 0).mean() > 0.95 and (model.scores(*pack(make("spam", 100))) < 0).mean() > 0.95


def markov_by_hand(urls):
    """Counts of (context, next) for contexts of 0 to ORDER symbols; -1 stands before a text, 0 ends it."""
    seen = defaultdict(Counter)
    for u in urls:
        symbols = [x + 1 for x in u.encode()] + [0]
        for i, s in enumerate(symbols):
            before = ([-1] * url_filter.ORDER + symbols[:i])[-url_filter.ORDER :]
            for k in range(url_filter.ORDER + 1):
                seen[tuple(before[len(before) - k :])][s] += 1

    def p(before, s):
        out = 1 / 257
        for k in range(url_filter.ORDER + 1):
            c = seen.get(tuple(before[len(before) - k :]))
            if c and sum(c.values()) >= url_filter.LEAST:
                out = (c[s] + len(c) * out) / (sum(c.values()) + len(c))
        return out

    return p


def mean_by_hand(p, url):
    symbols = [x + 1 for x in url.encode()] + [0]
    own = [math.log(p(([-1] * url_filter.ORDER + symbols[:i])[-url_filter.ORDER :], s)) for i, s in enumerate(symbols)]
    return sum(own) / len(own)


def test_url_verdicts_by_hand(spark):
    """Witten-Bell by dictionaries: probabilities add up to one, and scores, threshold and verdicts are the query's."""
    ship(spark)
    r = random.Random(12)
    good = [f"http://site{r.randint(0, 40)}.com/page/{r.randint(0, 99)}" for _ in range(60)]
    bad = [f"http://x{r.randint(0, 40)}.net/{r.choice(['es', 'fr'])}/q?z={r.randint(0, 99)}" for _ in range(60)]
    rest = ["http://y.org/page/7", "http://z.org/es/q", "", "no scheme", "http://long.org/" + "a" * 5000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + rest)], "page_id long, url string")
    hashed = {x.url: x.h for x in df.selectExpr("url", "xxhash64(url) AS h").collect()}
    halves = {}
    for name, urls in (("allow", good), ("block", bad)):
        own = sorted(set(urls), key=lambda u: (hashed[u], u))
        halves[name] = own[::2], own[1::2]
    p, q = markov_by_hand(halves["allow"][0]), markov_by_hand(halves["block"][0])
    for before in ([-1] * 5, [x + 1 for x in b"ttp:/"], [x + 1 for x in b"zzzzz"]):
        assert abs(sum(p(before, s) for s in range(257)) - 1) < 1e-9
    score = {u: mean_by_hand(p, u) - mean_by_hand(q, u) for u in good + bad + rest}
    got = {x.page_id: x for x in url_filter.judge(df).collect()}
    assert all(abs(got[i].score - score[u]) < 1e-9 for i, u in enumerate(good + bad + rest))
    a, b = ([score[u] for u in halves[k][1]] for k in ("allow", "block"))
    every = sorted(set(a + b))
    cuts = [every[0] - 1] + [(x + y) / 2 for x, y in zip(every, every[1:], strict=False)]
    threshold = max(cuts, key=lambda c: (sum(x >= c for x in a) / len(a) + sum(x < c for x in b) / len(b), -c))
    for i, u in enumerate(rest):
        assert got[len(good + bad) + i].verdict == ("allow" if score[u] >= threshold else "block")


def test_mix(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (10, None), (None, 1)], "doc_id long, quality int")
    out = mixing.mix(docs, mixing.label_weights(labels)).collect()
    rows = documents()
    size = lambda t: len([x for x in BLANK.split(t or "") if x])
    total, by = sum(size(r[1]) for r in rows), Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = total - sum(3 * by[s] for s in capped)
        level = rest / max(1e-9, sum(weight[s] for s in by if s not in capped))
        over = {s for s in by if s not in capped and weight[s] * level > 3 * by[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * by[s] if s in capped else weight[s] * level for s in by}
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["size"] * 3 >= r.taken and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in by)
    again = mixing.mix(docs.repartition(5), mixing.label_weights(labels)).collect()
    key = lambda r: repr((r.doc_id, r.source, r["size"], r.taken))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(empty).collect() == []
    rows_out = mixing.mixture(docs, mixing.label_weights(labels))
    assert rows_out.columns == docs.columns and Counter(r.source for r in rows_out.collect() for _ in range(size(r.text))) == +taken


def test_better_documents_are_taken_more_often(spark):
    ship(spark)
    df = spark.createDataFrame([(i, "a b c d e f g h i j", "s") for i in range(4000)] + [(9999, "w " * 28_000, "t")], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 3.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, weight double")
    out = mixing.mix(df, quality, weights=(1, 3)).filter("source = 's'").collect()
    odd, even = (sum(r.chosen for r in out if r.doc_id % 2 == k) for k in (1, 0))
    assert 0 < even < odd


TRICKY = ["", " ", "  ", "a  b", "a   b ", "it's we'll I'M 'sand", "naïve Æsop ÀÉ ß", "tab\tnew\nline\r\n x", "a b c", "a\x1cb c", "数字 123 ４５", "<|endoftext|>x<|endoftext|>", "👍🏽 é ﬁ ½ ª º µ", "x" * 20_000, "ab" * 9_000 + "!" * 9_000, "\n\n  \n a", "__ -- ??!! (a)", "İstanbul Σας ΣΑΣ", "a\u0085b", "word sep"]


@pytest.mark.parametrize("name,by_word", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_library(name, by_word):
    from tokenizers import Tokenizer

    path = bpe.vocabulary(name)
    lib = Tokenizer.from_file(path)
    r = random.Random(8)
    texts = TRICKY + ["".join(r.choices("ab'sé 1\n\t.,<|> ", k=r.randint(1, 60))) for _ in range(1500)] + [prose(50, i) for i in range(50)]
    raw = [t.encode() for t in texts]
    for _ in range(2):  # the second time from what it remembers
        ids, at = bpe.encoder(path, by_word).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids, t[:60]


LONG_TEXTS = [
    "a" * 3001, "ab" * 999, "the" * 700 + "a" * 900 + "then" * 400, "=" * 1000 + "-" * 1001, " " * 700 + "x" + "\n" * 600, "don't we'll 'sand 'tis " * 90, "x'sx'tx're" * 120,
    "<|endoftext|>" * 40 + "a<|endoftext|> b" * 30, "\u6570\u5b57 \u7b26\u53f7\uff0c" * 90, "\u6570\u5b57\u7b26\u53f7" * 200, "\U0001f44d\U0001f3fd \u00e9 \ufb01" * 60, "a\u00a0b\u0085 c\x1cd " * 80, "1234567890" * 150 + "x1y2!3" * 100, "", "a",
]


@pytest.mark.parametrize("leaf", [5, 16, 64])
def test_tree_concatenation_equals_one_pass(monkeypatch, leaf):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "LONG", leaf)
    monkeypatch.setattr(bpe, "WINDOW", 2)
    path = bpe.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Encoder(path, False)
    r = random.Random(9)
    texts = LONG_TEXTS + ["".join(r.choices("abcdeth", k=2000)), *("".join(r.choices("ab'sé 1\n\t.,<|>數 ", k=r.randint(20, 400))) for _ in range(150)), *(prose(60, i) for i in range(10))]
    raw = [t.encode() for t in texts]
    ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids, t[:60]
    assert own.tree.windows > 1000


def test_long_documents_take_the_tree():
    """In the query's own path, with its own sizes: as many windows as a text has joins, more only where one had to grow."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Encoder(path, False)
    text = prose(60_000, 3)
    data = np.frombuffer(text.encode(), np.uint8)
    leaves = len(bpe.halves(data, 0, len(data)))
    ids, _ = own.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert leaves > 16 and leaves - 1 <= own.tree.windows < 2 * leaves


def test_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for d, t, *_ in documents():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.round_trip(docs, path).collect()), key=repr) == sorted(want, key=repr)
    assert sorted((r.text for r in bpe.decode(bpe.encode(docs, path), path).collect())) == sorted(t or "" for _, t, *_ in documents())
    assert bpe.round_trip(empty, path).collect() == []


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    each = [(d, lib.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in documents()]
    got = token_files.round_trip(docs, path, 1).collect()
    want, at = [], 0
    for d, ids in sorted(each, key=lambda x: (x[0] is not None, x[0] or 0, token_files._thin(np.array(x[1], np.uint32)))):
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_files.round_trip(empty, path, 1).collect() == []


@pytest.mark.parametrize("limit", [16, 5])
def test_huffman(limit):
    r = np.random.default_rng(3)
    ids = np.minimum(r.geometric(0.05, 20_000), 40 if limit == 16 else 30).astype(np.uint32)
    counts = np.bincount(ids, minlength=50)
    lengths = token_files.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= limit and abs((2.0**-used).sum() - 1) < 1e-12
    if limit == 16:  # optimal: as good as Huffman's
        import heapq

        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            two = heapq.heappop(heap) + heapq.heappop(heap)
            cost += two
            heapq.heappush(heap, two)
        assert int((counts * lengths).sum()) == cost
    bits, starts = token_files.encode_bits(ids, lengths, token_files.canonical(lengths))
    assert token_files.decode_bits(bits, starts, len(ids), lengths).tolist() == ids.tolist()
    assert token_files.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
