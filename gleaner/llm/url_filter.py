"""URL filtering: host and path rules first, then the ratio of two character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each character of a URL a probability:
contexts of up to ORDER bytes, each interpolated with its shorter one by the number of different bytes seen after it
(Witten-Bell), and only contexts seen LEAST times. A URL is kept if the difference of its mean log-likelihoods is above a
threshold, which is the one with the best balanced accuracy on URLs that neither model has seen.

The rules label the URLs that teach. SAMPLE labelled URLs of each verdict at most teach and calibrate, those with the
smallest hashes, and only URLs of at most LONGEST bytes: both bounds are parameters, what comes to the driver and what it
sends is at most about 2 * SAMPLE * LONGEST bytes, and all URLs, whatever their length, are judged as wholes.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule and is judged by its text; if
one verdict has no labelled URL, every URL without a rule gets the other (allow, if there is none at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import arrow_schema, column, mixed, pieces, ship, utf8

#: The rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER, LEAST, SAMPLE, LONGEST = 5, 2, 40_000, 2_048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(rules=RULES) -> Column:
    """The longest rule (host and path) that fits columns host and path, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The symbols of all rows (bytes plus 1, then an end 0), and for each order the hash of the symbols before each."""
    n = np.diff(at)
    size = int(len(data) + len(n))
    symbols = np.zeros(size, np.uint64)
    ends = at[1:] + np.arange(len(n))
    body = np.ones(size, bool)
    body[ends] = False
    symbols[body] = data.astype(np.uint64) + np.uint64(1)
    place = np.arange(size) - np.repeat(at[:-1] + np.arange(len(n)), n + 1)
    hashes = [np.zeros(size, np.uint64)]
    for k in range(1, ORDER + 1):
        # before the text's first byte stands a symbol of its own
        before = np.where(place >= k, np.roll(symbols, k), np.uint64(300))
        hashes.append(mixed(hashes[-1] * np.uint64(521) + before, k))
    return symbols, hashes


@dataclass
class Markov:
    """For each order: sorted contexts with their counts and kinds, sorted context-and-symbol pairs with their counts."""

    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, data: np.ndarray, at: np.ndarray) -> Markov:
        symbols, hashes = _contexts(data, at)
        tables = []
        for h in hashes:
            pairs, first, n = np.unique(mixed(h, 77) + symbols * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
            own, of, kinds = np.unique(h[first], return_inverse=True, return_counts=True)
            total = np.bincount(of.reshape(-1), n, minlength=len(own))
            keep = total >= LEAST
            stay = keep[of.reshape(-1)]
            tables.append((own[keep], total[keep], kinds[keep].astype(float), pairs[stay], n[stay].astype(float)))
        return cls(tables)

    def mean_log(self, symbols: np.ndarray, hashes: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p = np.full(len(symbols), 1 / 257)
        for h, (own, total, kinds, pairs, n) in zip(hashes, self.tables, strict=True):
            if not len(own):
                continue
            i = np.minimum(np.searchsorted(own, h), len(own) - 1)
            known = own[i] == h
            key = mixed(h, 77) + symbols * np.uint64(0x9E3779B97F4A7C15)
            j = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            seen = np.where(pairs[j] == key, n[j], 0.0)
            p = np.where(known, (seen + kinds[i] * p) / (total[i] + kinds[i]), p)
        return np.add.reduceat(np.log(p), starts) / sizes


@dataclass
class UrlModel:
    accepted: Markov | None
    rejected: Markov | None
    threshold: float = 0.0
    only: str = "allow"

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Differences of mean log-likelihoods; the end counts as a character."""
        if self.accepted is None or self.rejected is None or len(at) < 2:
            return np.zeros(len(at) - 1)
        symbols, hashes = _contexts(data, at)
        sizes = np.diff(at) + 1
        starts = np.cumsum(sizes) - sizes
        return self.accepted.mean_log(symbols, hashes, starts, sizes) - self.rejected.mean_log(symbols, hashes, starts, sizes)

    def verdicts(self, scores: np.ndarray) -> list[str]:
        if self.accepted is None or self.rejected is None:
            return [self.only] * len(scores)
        return ["allow" if s >= self.threshold else "block" for s in scores]


def _cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the best balanced accuracy: between two neighbouring scores."""
    if not len(good) or not len(bad):
        return 0.0
    every = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([every[:1] - 1, (every[1:] + every[:-1]) / 2])
    right = 1 - np.searchsorted(np.sort(good), cuts) / len(good) + np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[right.argmax()])


def fit(labelled: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> UrlModel:
    """Of (url, verdict): the models from one half of the sample, the threshold from the other."""
    rows = labelled.filter(F.octet_length("url") <= longest).select("url", "verdict").distinct().withColumn("h", F.xxhash64("url"))
    parts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for verdict in ("allow", "block"):
        urls = [r["url"].encode() for r in rows.filter(F.col("verdict") == verdict).orderBy("h", "url").limit(sample).collect()]
        for half in (0, 1):
            own = urls[half::2]
            parts[verdict, half] = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
    have = {v: len(parts[v, 0][1]) > 1 for v in ("allow", "block")}
    if not all(have.values()):
        return UrlModel(None, None, only="block" if have["block"] else "allow")
    model = UrlModel(Markov.fit(*parts["allow", 0]), Markov.fit(*parts["block", 0]))
    model.threshold = _cut(*(model.scores(*parts[v, 1]) for v in ("allow", "block")))
    return model


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the models) of each row."""
    ship(pages.sparkSession)
    host, path = split_url()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("host", host).withColumn("path", path).withColumn("found", best_rule(rules))
    model = fit(rows.filter("found IS NOT NULL").select("url", F.col("found.verdict").alias("verdict")), sample)
    sent = pages.sparkSession.sparkContext.broadcast(model)
    form = "page_id long, host string, path string, rule string, verdict string, score double"
    schema = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "url", 1 << 20):
            scores = sent.value.scores(*utf8(column(batch, "url")))
            own = sent.value.verdicts(scores)
            said = [r or v for r, v in zip(column(batch, "verdict").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "host"), column(batch, "path"), column(batch, "rule"), pa.array(said), pa.array(scores)], schema=schema)

    return rows.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict")).mapInArrow(run, form)
