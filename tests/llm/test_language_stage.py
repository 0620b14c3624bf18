"""The language stage rejects by its codewords: texts in no learned language go, clean and mixed ones stay."""

import base64
import random

import pytest
from conftest import SMALL

from gleaner.llm import language_id
from gleaner.llm.shared import ship

LARGER = SMALL.replace("sf0.001", "sf0.01")
FORM = "doc_id long, text string, lang string"
ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura. Questa è una bella giornata e gli uomini vanno alla stazione per prendere il treno della mattina"
FINNISH = "Tämä on suomenkielinen teksti joka kertoo siitä miten ihmiset elävät maaseudulla ja kuinka he viettävät kesää järven rannalla saunoen ja uiden"

RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских"
KOREAN = "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며"


@pytest.fixture(scope="module")
def learned(spark):
    ship(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").cache()


def kept(spark, learned, texts):
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(texts)], FORM)
    got = {r.doc_id - 10**6 for r in language_id.accepted(learned.unionByName(more)).filter("doc_id >= 1000000").collect()}
    return [i in got for i in range(len(texts))]


def test_texts_in_no_learned_language_go(spark, learned):
    r = random.Random(3)
    letters = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    junk = [base64.b64encode(r.randbytes(300)).decode() for _ in range(20)]
    assert not any(kept(spark, learned, [ITALIAN, FINNISH, RUSSIAN, KOREAN, *letters, *junk]))


def test_clean_and_mixed_texts_stay(spark, learned):
    by = {k: [x.text for x in learned.filter(learned.lang == k).orderBy("doc_id").limit(12).collect()] for k in ("en", "fr", "de", "es")}
    mixed = [a[:600] + "\n" + b[:600] for x, y in (("en", "fr"), ("de", "es")) for a, b in zip(by[x], by[y], strict=True)]
    woven = [" ".join(w for pair in zip(a.split()[:80], b.split()[:80], strict=False) for w in pair) for a, b in zip(by["en"], by["de"], strict=True)]
    assert all(kept(spark, learned, mixed + woven))
    assert language_id.accepted(learned).count() == learned.count()


GREEK = [
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
    "Είναι προικισμένοι με λογική και συνείδηση και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης",
]
CHINESE = ["人人生而自由在尊嚴和權利上一律平等他們賦有理性和良心並應以兄弟關係的精神相對待", "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少床前明月光疑是地上霜舉頭望故鄉"]


def test_small_languages_with_scripts_of_their_own_stay(spark):
    ship(spark)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    few = [(10**6 + i, t, k) for i, (t, k) in enumerate([*((t, "el") for t in GREEK), *((t, "zh") for t in CHINESE)])]
    few += [(2 * 10**6 + i, t, None) for i, t in enumerate([RUSSIAN, KOREAN, FINNISH])]
    got = [r.doc_id for r in language_id.accepted(docs.unionByName(spark.createDataFrame(few, FORM))).select("doc_id").collect()]
    assert sorted(d for d in got if d >= 10**6) == [10**6 + i for i in range(4)]
    assert len(got) == docs.count() + 4
