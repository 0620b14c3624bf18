"""The pipeline on the smallest tables: each stage's decisions take effect."""

import hashlib
import random
import struct
from collections import Counter

import corpus_pipeline
import pytest
from conftest import SMALL
from test_operators import bare, clashing, prose, shingles

from gleaner.llm import exact_dedup, near_dedup


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "exact_dedup":
            assert exact_dedup.decisions(docs).filter("group_size > 1").count() == 0
        if name == "near_dedup":
            assert near_dedup.decisions(docs).filter("class_size > 1").count() == 0
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] and docs.select("doc_id").distinct().count() <= sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and last.filter("octet_length(ids) <> 2 * n_tokens").count() == 0


def odd_rows():
    """Documents in two made-up languages with copies, near copies, nulls, junk, null and repeated ids."""
    r = random.Random(21)
    make = lambda k, seed: prose(r.randint(40, 70), seed, "abcdeg" if k else "mnopqu")
    rows = [(i, make(i % 2, 100 + i), "st"[i % 3 == 0]) for i in range(60)]
    first = rows[0][1].split()
    rows += [(200, rows[1][1] + "  \n", "s"), (201, " ".join([*first[:-1], "abc"]), None), (202, None, "s"), (203, "", "t"), (204, "12 + 34!!", "t"), (None, make(1, 7), "t"), (None, None, None)]
    rows += [(300, make(0, 8), "t")] * 3 + [(301, make(1, 9), "s"), (301, make(0, 10), "s")] + [(302, rows[5][1], "t"), (303, prose(30_000, 11, "abcdeg"), "t")]
    return rows


@pytest.fixture
def folder(spark, tmp_path):
    docs = clashing(spark, odd_rows())
    lang = "CASE WHEN text IS NULL THEN NULL WHEN text RLIKE '[mnopqu]{2}' THEN 'mm' WHEN text RLIKE '[abcdeg]{2}' THEN 'aa' END AS lang"
    docs.selectExpr("*", lang).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_of_odd_rows_against_brute_force(spark, folder):
    from tokenizers import Tokenizer

    from gleaner.llm import bpe, language_id, mixing

    stages = dict(corpus_pipeline.STAGES)
    take = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = take(docs)
    at = {c: docs.columns.index(c) for c in ("doc_id", "text", "source")}
    text = lambda r: r[at["text"]] or ""
    one = stages["language_id"](spark, docs, folder).cache()
    model = language_id.fit(docs, none=True)
    known = take(one)
    assert known == [r for r, keep in zip(given, model.predict([r[at["text"]] for r in given])[3], strict=True) if keep]
    assert [r[at["doc_id"]] for r in given if r not in known and any(c.isalpha() for c in text(r))] == []
    two = stages["exact_dedup"](spark, one, folder).cache()
    groups = {}
    for r in known:
        groups.setdefault(bare(text(r)), []).append(r)
    best = lambda rows: min((-len(text(r)), r[at["doc_id"]] is None, r[at["doc_id"]] or 0) for r in rows)
    kept = take(two)
    assert sorted((bare(text(r)), r[at["doc_id"]]) for r in kept) == sorted((t, min(rows, key=lambda r: (-len(text(r)), r[at["doc_id"]] is None, r[at["doc_id"]] or 0))[at["doc_id"]]) for t, rows in groups.items())
    assert set(kept) <= set(known) and all(best([r]) == best(groups[bare(text(r))]) for r in kept)
    three = stages["near_dedup"](spark, two, folder).cache()
    sets = [shingles(text(r)) for r in kept]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((r[at["doc_id"]] is None, r[at["doc_id"]] or 0) for r, y in zip(kept, label, strict=True) if y == x) for x in label}
    left = take(three)
    assert sorted((r[at["doc_id"]] is None, r[at["doc_id"]] or 0) for r in left) == sorted(least.values()) and set(left) <= set(kept) and len(left) < len(kept)
    four = stages["mixing"](spark, three, folder).cache()
    mixed = Counter(take(four))
    taken = Counter()
    for r in mixing.mix(three, mixing.label_weights(spark.read.parquet(f"{folder}/labels.parquet"))).collect():
        taken[r.doc_id] += r.epochs + r.chosen
    assert set(mixed) <= set(left)
    assert Counter(r[at["doc_id"]] for r in mixed.elements()) == +taken
    last = stages["bpe"](spark, four, folder).collect()
    lib = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r, n in mixed.items():
        ids = lib.encode(text(r), add_special_tokens=False).ids
        want[r[at["doc_id"]], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in last) == want
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, last))


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    clashing(spark, odd_rows()).selectExpr("*", "'en' AS lang").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
