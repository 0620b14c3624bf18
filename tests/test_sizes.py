"""What shows only on larger tables or odd rows: queries against their SQL there, and rankings that don't grow with the pairs of questions and blocks."""

import duckdb
from conftest import SMALL
from pyspark.sql import functions as F
from test_oracles import in_order

from gleaner.operators import index as I
from gleaner.operators import rank as R
from gleaner.operators import scan
from gleaner.plans import compile as C
from gleaner.plans import queries_corpus, queries_evaluation  # noqa: F401
from gleaner.plans import queries_retrieval as Q
from gleaner.plans.registry import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """The query's rows and the SQL's over tables (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    result = con.execute(ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in cols]
    return in_order(tuple(r) for r in df.select(cols).collect()), in_order(tuple(r[i] for i in at) for r in result.fetchall())


def test_names_with_one_character_between_them(spark, tmp_path):
    texts = ["Onelle\nPour mentpach", "Lima-Cusco y Puno Tacna", "Ica.Piura", "Onelle\n\nPour", "Lima", "a Áncash\n", "\nÑandú", "Lima_ Cusco2 Puno", ""]
    got, want = against_sql(spark, tmp_path, "capitalised_names", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want and dict((int(d), n) for d, n in got)[0] == "onelle"


def test_grounding_of_an_answer_that_cites_one_of_many_blocks(spark, tmp_path):
    text = "the first of many passages that the corpus holds again, and still again"
    docs = [(d, f"{text} number {d} of all\nanother line of the document {d}, longer than forty characters", "en", "src1") for d in range(120)]
    bank = [(150, text), (31, text[:55]), (33, text[:56]), (35, "a passage that no document holds, in more than sixty characters")]
    docs.append((500, f"{text} [7] and what follows it\nan other line of it, longer than forty characters", "en", "src2"))
    bank.append((41, f"{text} [7] and what follows it"))
    got, want = against_sql(spark, tmp_path, "grounding_overlap", documents=(docs, "doc_id long, text string, lang string, source string"), benchmark=(bank, "item_id long, text string"))
    assert got == want and {int(a) for a, _ in got} == {150, 33, 41}


def test_rankings_over_many_chunks_and_pieces(spark, monkeypatch):
    """Chunks of a few blocks and pieces of a few requirements give the rankings of one chunk and one piece."""
    whole = I.of(spark, SMALL)
    asked = Q.questions(spark, SMALL).filter("qid % 3 = 0 OR qid > 1000")
    plan = C.plans(asked, whole).cache()
    reqs = C.requirements(plan, whole).cache()
    key = lambda df: sorted((r.qid, r.rid, r.rank, r.block_ix, round(r.score, 9)) for r in df.collect())
    want = {k: key(v) for k, v in R.signals(reqs, plan, whole).items()}
    dense = {r.qid: round(r.density, 9) for r in C.density(reqs, whole).collect()}
    assert all(want.values()) and dense
    monkeypatch.setattr(I, "CHUNK", 50)
    parts = I.build(spark, SMALL)
    assert parts.chunks.count() > 20
    for few, piece, held in ((20_000, 1024, 100_000), (0, 5, 7)):
        for name, value in (("FEW", few), ("PIECE", piece), ("HELD", held)):
            monkeypatch.setattr(scan, name, value)
        assert {k: key(v) for k, v in R.signals(reqs, plan, parts).items()} == want
        assert {r.qid: round(r.density, 9) for r in C.density(reqs, parts).collect()} == dense


def test_rankings_shuffle_the_best_alone(spark):
    """Requirements that meet most blocks hand on their best blocks of each task, not a row for each pair."""
    index = I.of(spark, SMALL)
    common = [r.term for r in index.stats.orderBy(F.desc("df")).limit(3).collect()]
    reqs = spark.createDataFrame([(i, "r1", common) for i in range(40)], "qid long, rid string, terms array<string>")
    found = scan.scanned(R._title(reqs).unionByName(R._bm25(reqs, index)), index, {"title": 20, "bm25": 40})
    assert 40 * 40 <= found.count() <= 40 * (20 + 40) * index.chunks.rdd.getNumPartitions()
    assert index.blocks.count() > 1000


def test_narrowed_index_keeps_statistics(spark, monkeypatch):
    index = I.of(spark, SMALL)
    ids = [r.block_ix for r in index.blocks.orderBy("block_ix").limit(5).collect()]
    asked = spark.createDataFrame([(i,) for i in [*ids, ids[0], -1]], "block_ix long")
    for few in (10, 0):
        monkeypatch.setattr(I, "FEW", few)
        near = index.narrowed(asked, "block_ix", "terms")
        assert sorted(r.block_ix for r in near.blocks.collect()) == ids and near.blocks.columns == ["block_ix", "terms"]
        assert near.size == index.size and near.stats is index.stats
