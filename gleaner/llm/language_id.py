"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A binary classifier of letter n-grams (1 to 3 letters of lower-cased words with
their edges) predicts each bit: the log ratio of n-gram shares among the languages whose bit is 1 and those whose bit
is 0, averaged over the text. Decoding adds, for each language, a logistic loss of the margins against its codeword's
bits, each weighted by how far the bit's two sides lie apart; the least loss wins. A text is ambiguous if no codeword is
clearly nearest.

All labelled rows teach, by counts alone: a task sends a count for each language and n-gram bucket. Defined results: a
text that is null or has no letter is `und` with score 0; so is every text if there is no labelled one; rows without
lang teach nothing; equal losses go to the language first in code point order.

A stage that rejects texts in no learned language adds a bit that all languages' codewords share and a codeword that has
only this bit, and the other way. What it stands for is seven eighths random words (letters drawn by the square roots of
their shares in languages alike in letters), one eighth all n-grams alike. A text nearest to this codeword goes. A text
in two languages is about as far from either's codeword, but far from that of none, and stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import arrow_schema, column, mixed, pieces, ship, spread, word_hashes, working_for

#: Buckets of n-grams, smoothing, steepness of the loss, and the share of the loss that a clear winner must save.
BUCKETS, ADD, STEEP, CLEAR = 1 << 15, 0.5, 4.0, 0.02
#: Letters of the random words that stand for no language.
DRAWN = 1 << 20
#: How far from the middle between no language and the languages the border lies, as a share of the way to these.
BORDER = 0.2
UNKNOWN = "und"
#: Bytes of text that are taken apart at once: n-grams of their words take fifty times as many.
PIECE = 1 << 19


def fold(name: str, of: int) -> Column:
    """crc32 of an id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % of


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The distinct words of some texts as n-gram buckets, and which word comes where."""

    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray
    word: np.ndarray
    row: np.ndarray
    letters: np.ndarray  # code points of all letters, and the text of each
    letter_row: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    joined = "\n".join((t or "").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = _letters()[points]
    starts = np.flatnonzero(letter[1:-1] & ~letter[:-2])
    stops = np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    key = word_hashes(points, starts, stops)
    _, one, word = np.unique(key, return_index=True, return_inverse=True)
    starts1, size = starts[one], stops[one] - starts[one]
    # each distinct word with an edge (0) before and behind it
    padded = np.zeros(int(size.sum()) + 2 * len(size), np.uint64)
    begin = np.cumsum(size + 2) - (size + 2)
    padded[spread(begin + 1, size)] = points[spread(starts1, size)]
    b, c = (np.roll(padded, -k) for k in (1, 2))
    inner = np.zeros(len(padded), bool)
    inner[spread(begin + 1, size)] = True
    last = np.zeros(len(padded), bool)
    last[begin + size + 1] = True
    two = ~last
    three = two & np.roll(inner, -1)
    mask = np.uint64(BUCKETS - 1)
    gram = [mixed(padded[inner], 11) & mask, mixed(padded[two] * np.uint64(1 << 21) + b[two], 12) & mask, mixed((padded[three] * np.uint64(1 << 21) + b[three]) * np.uint64(1 << 21) + c[three], 13) & mask]
    owner = np.repeat(np.arange(len(size)), size + 2)
    own = np.concatenate([owner[inner], owner[two], owner[three]])
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=len(size))
    at = np.flatnonzero(letter[1:-1])
    return Words(np.concatenate(gram)[order].astype(np.int64), np.cumsum(count) - count, count, word.reshape(-1), np.searchsorted(ends, starts, "right"), points[at], np.searchsorted(ends, at, "right"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("lang string, bucket int, n long")
    total: dict[str, tuple[np.ndarray, Counter]] = {}
    working_for("language_id", _letters.cache_clear)
    for batch in pieces(batches, "text", PIECE):
        langs = column(batch, "lang").to_pylist()
        names = sorted(set(langs))
        at = np.array([names.index(x) for x in langs])
        w = words_of(column(batch, "text").to_pylist())
        if not len(w.word):
            continue
        owner = np.repeat(np.arange(len(w.count)), w.count)
        for i, name in enumerate(names):
            uses = np.bincount(w.word[at[w.row] == i], minlength=len(w.count))
            grams, letters = total.setdefault(name, (np.zeros(BUCKETS, np.int64), Counter()))
            grams += np.bincount(w.grams, uses[owner], minlength=BUCKETS).astype(np.int64)
            point, n = np.unique(w.letters[at[w.letter_row] == i], return_counts=True)
            letters.update(dict(zip(point.tolist(), n.tolist(), strict=True)))
    for name, (grams, letters) in total.items():  # letters are numbered behind the n-gram buckets
        used = np.flatnonzero(grams)
        place = np.concatenate([used, BUCKETS + np.array([*letters], np.int64)])
        n = np.concatenate([grams[used], np.array([*letters.values()], np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(place, pa.int32()), pa.array(n)], schema=schema)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all different splits for up to five languages, else the farthest apart of random ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = range(1, 1 << (n - 1))
        return np.array([[1.0 if (s >> i) & 1 else -1.0 for s in splits] for i in range(n)])
    draw = np.random.default_rng(n)
    best, bits = None, 12 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        near = (code @ code.T - 2 * code.shape[1] * np.eye(n)).max() / max(1, code.shape[1])
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    apart: np.ndarray
    beyond: bool  # whether the last of weight and apart is the bit of languages against none

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Row by language: logistic losses of the margins (in units of half the distance of a bit's sides)."""
        apart = self.apart[: self.code.shape[1]]
        z = STEEP * margins[:, : len(apart)] / (apart / 2)
        share = apart / apart.sum()
        return np.stack([(np.logaddexp(0, -z * c) * share).sum(1) for c in self.code], 1)

    def learned(self, loss: np.ndarray, margins: np.ndarray) -> np.ndarray:
        """Whether a language's codeword is nearer than that of no language, whose loss is log 2 on each bit it lacks."""
        z = STEEP * (margins[:, -1] / (self.apart[-1] / 2) - BORDER)
        return loss.min(1) + np.logaddexp(0, -z) < np.log(2) + np.logaddexp(0, z)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether it is ambiguous, and whether it is in a learned language, of each text."""
        w = words_of(texts)
        n = len(texts)
        grams = np.bincount(w.row, w.count[w.word], minlength=n) if len(w.word) else np.zeros(n)
        margins = np.zeros((n, len(self.weight)))
        for b, weight in enumerate(self.weight) if len(w.word) else ():
            own = np.add.reduceat(weight[w.grams], w.first)
            margins[:, b] = np.bincount(w.row, own[w.word], minlength=n)
        margins /= np.maximum(grams, 1)[:, None]
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
        loss = self.losses(margins)
        best = loss.argmin(1)
        odds = np.exp((loss.min(1)[:, None] - loss) * 8)
        score = np.where(grams > 0, 1 / odds.sum(1), 0.0)
        other = np.sort(loss, 1)[:, 1] if len(self.langs) > 1 else loss[:, 0] * 2
        ambiguous = (grams == 0) | (other - loss.min(1) < CLEAR * other)
        return [self.langs[k] if g else UNKNOWN for k, g in zip(best, grams, strict=True)], score, ambiguous, (grams > 0) & (self.learned(loss, margins) if self.beyond else True)


def random_words(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Counts by bucket of words of letters drawn independently; letters: counts by language and point."""
    root = np.sqrt(letters)
    p = root / root.sum(1, keepdims=True)
    near = np.sqrt(p) @ np.sqrt(p).T  # languages of one script lend each other their letters
    mixed_p = near @ p
    draw = np.random.default_rng(len(points))
    words = []
    for q in mixed_p / mixed_p.sum(1, keepdims=True):
        chars = draw.choice(points.astype(np.uint32), DRAWN // len(p), p=q).tobytes().decode("utf-32-le")
        ends = np.cumsum(draw.integers(2, 11, len(chars) // 6)).tolist()
        words += [chars[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    w = words_of([" ".join(words)])
    uses = np.bincount(w.word, minlength=len(w.count))
    return np.bincount(w.grams, uses[np.repeat(np.arange(len(w.count)), w.count)], minlength=BUCKETS)


def fit(docs: DataFrame, none: bool = False) -> Model:
    """The classifiers of all rows (text, lang) with a lang; what comes to the driver is a count for each language and bucket or letter.

    none: with the bit for texts in no learned language.
    """
    ship(docs.sparkSession)
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    found = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(names), BUCKETS))
    place = {x: i for i, x in enumerate(names)}
    rows_at = np.fromiter((place[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    gram = bucket < BUCKETS
    counts[rows_at[gram], bucket[gram]] = n[gram]
    add = np.minimum(ADD, counts.sum(1, keepdims=True) / (64 * BUCKETS)) if none else ADD  # else a language of few rows is near any text
    share = (counts + add) / (counts + add).sum(1, keepdims=True) if names else counts
    sides = []
    code = codewords(len(names))
    for bit in code.T:
        ones = share[bit > 0].mean(0) if (bit > 0).any() else np.full(BUCKETS, 1 / BUCKETS)
        zeros = share[bit < 0].mean(0) if (bit < 0).any() else np.full(BUCKETS, 1 / BUCKETS)
        sides.append((ones, zeros))
    if none and names:
        points, at = np.unique(bucket[~gram] - BUCKETS, return_inverse=True)
        letters = np.zeros((len(names), len(points)))
        letters[rows_at[~gram], at.reshape(-1)] = n[~gram]
        drawn = random_words(points, letters)
        sides.append((share.mean(0), (7 * drawn / drawn.sum() + 1 / BUCKETS) / 8))
    weights, apart = [], []
    for ones, zeros in sides:
        weight = np.log(ones) - np.log(zeros)
        middle = (ones @ weight + zeros @ weight) / 2
        weights.append(weight - middle)
        apart.append(max(1e-9, (ones - zeros) @ weight))
    return Model(names, code, np.array(weights).astype(np.float32), np.array(apart), none and bool(names))


def classify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns of docs named in carry, with lang_pred, score and ambiguous; the text may be one of them."""
    spark = docs.sparkSession
    ship(spark)
    form = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(form)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("language_id", _letters.cache_clear)
        for batch in pieces(batches, "text", PIECE):
            langs, score, ambiguous, _ = sent.value.predict(column(batch, "text").to_pylist())
            held = column(batch, "carried").flatten() if carry else []
            own = [x.cast(schema.field(i).type) for i, x in enumerate(held)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs), pa.array(score), pa.array(ambiguous)], schema=schema)

    # what is carried is one column, so that no name can clash with the text's
    return docs.select(F.struct(*(F.col(c) for c in carry)).alias("carried"), "text").mapInArrow(run, form)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose nearest codeword is a language's: texts without letters go, and those nearest to no language's.

    A text in two languages is ambiguous, but stays. All labelled rows teach, so a language of a few rows is learned too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, none=True))

    @F.arrow_udf("boolean")
    def clear(text: pa.Array) -> pa.Array:
        working_for("language_id", _letters.cache_clear)
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        out = [sent.value.predict(column(b, "text").to_pylist())[3] for b in pieces([batch], "text", PIECE)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(clear("text"))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learn from rows whose fold is not 2; predict all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    return classify(rows, fit(rows.filter("NOT held_out")), ["doc_id", "held_out"])
