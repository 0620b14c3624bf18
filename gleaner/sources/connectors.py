"""Callers' services and what comes of them: models that write or embed, with tries and a reserve; reports, prompts and results as files."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import TRANSIENT
from gleaner.operators import evaluate as V

#: Tries, seconds before the second one, tries of the reserve, and failures in a row after which a warm-up stops.
TRIES, PAUSE, RESERVE_TRIES, STOP = 3, 1.5, 2, 5


def transient(error: Exception) -> bool:
    return re.search(TRANSIENT, str(error)) is not None


def tried(call: Callable[[], object], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
    """The call's result; passing failures are tried again after 1, 2, 4 ... pauses and up to half a second, others are raised at once."""
    for i in range(tries):
        try:
            return call()
        except Exception as e:
            if not transient(e) or i + 1 == tries:
                raise
            sleep(pause * 2**i + random.uniform(0, 0.5))


def with_reserve(model: Callable, reserve: Callable | None, *args, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str]:
    """The answer and which of the two gave it: the reserve is asked when the model's passing failures don't pass."""
    try:
        return tried(lambda: model(*args), sleep=sleep), "model"
    except Exception as e:
        if reserve is None or not transient(e):
            raise
        return tried(lambda: reserve(*args), RESERVE_TRIES, sleep=sleep), "reserve"


def generate(prompts: DataFrame, model: Callable[[str, str], str], reserve: Callable[[str, str], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts (qid, system, user): qid, answer, by, error. A prompt that fails gives its message; a null prompt, of no evidence, isn't sent."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for r in frame.itertuples():
                answer = by = error = None
                try:
                    answer, by = with_reserve(model, reserve, r.system, r.user, sleep=sleep)
                    error = None if (answer or "").strip() else "empty answer"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((r.qid, answer, by, error))
            yield pd.DataFrame(out, columns=["qid", "answer", "by", "error"])

    sent = prompts.filter("user IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), "system", "user")
    return sent.mapInPandas(run, "qid long, answer string, by string, error string")


def warm_up(asked: DataFrame, stored: DataFrame | None, embed: Callable[[str], list[float]], provider: str, stop: int = STOP) -> DataFrame:
    """Vectors of the distinct texts of asked (text) that the store (text, vector, provider) lacks, until `stop` calls fail in a row.

    A service's quota is one for all, so one task asks, text after text; what it got is returned, the rest is for another run.
    """
    todo = asked.select("text").filter("text IS NOT NULL AND trim(text) <> ''").distinct()
    if stored is not None:
        todo = todo.join(stored.filter(F.col("provider") == provider).select("text"), "text", "left_anti")

    def run(batches):
        import pandas as pd

        failed = 0
        for frame in batches:
            out = []
            for text in frame["text"]:
                if failed >= stop:
                    break
                try:
                    out.append((text, [float(x) for x in embed(text)], provider))
                    failed = 0
                except Exception:
                    failed += 1
            yield pd.DataFrame(out, columns=["text", "vector", "provider"])

    return todo.repartition(1).sortWithinPartitions("text").mapInPandas(run, "text string, vector array<double>, provider string")


def cached_vectors(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """text, vector, provider of a cache of query vectors: those of the provider; a cache that is missing or broken is empty."""
    form = "text string, vector array<double>, provider string"
    try:
        rows = spark.read.parquet(path).select("text", F.col("vector").cast("array<double>").alias("vector"), "provider").filter(F.col("provider") == provider)
        rows.count()
        return rows
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], form)


def report(docs: DataFrame, blocks: DataFrame, weeks: DataFrame) -> DataFrame:
    """The corpus in lines of text (n, line): totals, kinds, weeks (those without material marked), the largest documents."""
    one = lambda rows, part, key, line: rows.select(F.lit(part).alias("part"), key.cast("double").alias("key"), F.lit("").alias("name"), line.alias("line"))
    number = lambda c: F.format_number(c, 0)
    totals = V.corpus_totals(docs, blocks)
    kinds = V.totals_by(docs, "kind").select(F.lit(2).alias("part"), F.lit(0.0).alias("key"), F.col("kind").alias("name"), F.concat(F.lit("  "), F.rpad(F.coalesce("kind", F.lit("-")), 12, " "), F.col("n").cast("string"), F.lit(" docs "), number("tokens"), F.lit(" tok")).alias("line"))
    by_week = V.week_coverage(weeks, docs)
    head = lambda part, text: (part, -1.0, "", text)
    heads = docs.sparkSession.createDataFrame([head(0, "CORPUS"), head(2, "BY KIND"), head(3, "BY WEEK"), head(4, "LARGEST DOCUMENTS")], "part int, key double, name string, line string")
    largest = docs.select("doc_id", "title", "tokens").orderBy(F.desc("tokens"), "doc_id").limit(8)
    every = (
        heads.unionByName(one(totals, 1, F.lit(0), F.concat(F.lit("documents "), number("documents"), F.lit(", blocks "), number("blocks"), F.lit(", tokens "), number("doc_tokens"))))
        .unionByName(kinds).unionByName(one(by_week, 3, F.col("week"), F.concat(F.lit("  S"), F.col("week").cast("string"), F.lit("  "), F.col("documents").cast("string"), F.lit(" docs "), number("tokens"), F.lit(" tok"), F.when(F.col("documents") == 0, "   <-- nothing").otherwise(""))))
        .unionByName(one(largest, 4, -F.col("tokens"), F.concat(F.lit("  "), number("tokens"), F.lit(" tok  "), F.col("title"))))
    )
    from pyspark.sql import Window

    return every.select((F.row_number().over(Window.orderBy("part", "key", "name", "line"))).alias("n"), "line")  # some dozen lines


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Evaluation results, or prompts, as JSON lines; nested columns stay nested."""
    rows.write.mode("overwrite").json(path)


def run_steps(steps: list[tuple[str, Callable[[], object], bool]]) -> list[tuple[str, str]]:
    """Steps (name, what to do, critical) in order; each with `ok` or its error. A critical one that fails ends the run."""
    out = []
    for name, step, critical in steps:
        try:
            step()
            out.append((name, "ok"))
        except Exception as e:
            out.append((name, f"{type(e).__name__}: {e}"))
            if critical:
                break
    return out
