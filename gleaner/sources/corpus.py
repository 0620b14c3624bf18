"""Corpus sources and sinks: files, scanned pages, blocks as JSON lines, the manifest, vectors, and the tables at hand.

Tables stand in for a course's files: a document is a row of `documents`, its series is `source`, a block is a line of
40 characters and more. Week, unit, kind and authority follow from the series' number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.wordlists import MIN_BLOCK, UNITS, WEEKS

#: Kinds and authorities by the series' number modulo 5.
KINDS = (("lectura", "academica"), ("clase", "docente"), ("rector", "oficial"), ("evaluacion", "oficial"), ("guion", "oficial"))
BLOCK = "bloque_id string, doc_id string, texto string, tokens int, fuente struct<archivo:string,formato:string,pagina:int,diapositiva:int,documento:int,ocr:boolean>, curso string, unidad int, semana int, tipo string, autoridad string, imagenes int, notas_presentador string"
#: A document's blocks are numbered within this range, so block_ix keeps the order of documents and lines.
LINES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt over all cores if they lie in fewer files than there are: a file's rows may be one task's."""
    rows = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def weeks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEEKS, "week int, unit int, dates string, topic string")


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "unit int, unit_name string")


def _attributes(rows: DataFrame) -> DataFrame:
    number = F.expr("cast(substring(source, 4) as int)")
    week = number % 14 + 1
    kind, authority = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (k, a) in enumerate(KINDS):
        kind, authority = F.when(number % 5 == i, k).otherwise(kind), F.when(number % 5 == i, a).otherwise(authority)
    return rows.withColumns({"week": week, "unit": F.when(week < 8, 1).when(week > 8, 2), "kind": kind, "authority": authority})


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """block_ix, block_id, doc_id, n, body, tokens, source, lang, week, unit, kind, authority."""
    lines = texts(spark, folder).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("p", "body"))
    kept = lines.filter(F.length(X.strip(F.col("body"))) >= MIN_BLOCK).withColumn("n", F.col("p") + 1)
    named = kept.select(
        (F.col("doc_id") * LINES + F.col("n")).alias("block_ix"), F.concat_ws("#p", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("block_id"),
        "doc_id", "n", "body", X.word_count(F.col("body")).alias("tokens"), "source", "lang",
    )
    return _attributes(named)


def block_rows(spark: SparkSession, folder: str, context_too: bool = False) -> DataFrame:
    """blocks() with position, and previous and next within the document: each document's lines are one array, so nothing is shuffled.

    context_too: with ctx, its tokens (ctx_terms) and the runs of the author's name (names), made once in the document's row.
    """
    lines = F.transform(F.split("text", "\n"), lambda body, p: F.struct((p + 1).alias("n"), body.alias("body")))
    kept = F.filter(lines, lambda x: F.length(X.strip(x["body"])) >= MIN_BLOCK)
    docs, more = texts(spark, folder), []
    if context_too:
        docs = _described(spark, docs.select("doc_id", "source", "lang", "text", *_heading())).withColumn("ctx", context())
        docs, more = docs.withColumns({"ctx_terms": X.tokens(F.col("ctx")), "names": author_terms(F.col("author"))}), ["ctx", "ctx_terms", "names"]
    # a list of one list is exploded so that the list is made once, and not again for each place that is looked up in it
    rows = docs.select("doc_id", "source", "lang", *more, F.explode(F.array(kept)).alias("lines"))
    at = lambda i: F.when(i >= 0, F.get("lines", i)["n"])
    each = F.transform("lines", lambda x, i: F.struct(x["n"].alias("n"), x["body"].alias("body"), (i + 1).alias("position"), at(i - 1).alias("previous"), at(i + 1).alias("next")))
    rows = rows.withColumn("each", each).select("doc_id", "source", "lang", *more, F.explode("each").alias("e")).select("doc_id", "source", "lang", *more, "e.*")
    ix = lambda c: F.col("doc_id") * LINES + F.col(c)
    named = rows.select(
        ix("n").alias("block_ix"), F.concat_ws("#p", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("block_id"), "doc_id", "n", "body",
        X.word_count(F.col("body")).alias("tokens"), "source", "lang", "position", ix("previous").alias("previous"), ix("next").alias("next"), *more,
    )
    return _attributes(named)


def context() -> Column:
    """A document's title, author, week's topic and unit's name."""
    return F.concat_ws(" | ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "author", "topic", "unit_name")))


def author_terms(author: Column) -> Column:
    """Runs of letters and digits in the author's name, each once."""
    return F.array_distinct(F.regexp_extract_all(X.normalise(author), F.lit("([a-z0-9]+)"), F.lit(1)))


def _heading() -> tuple[Column, Column]:
    """title (the first line, 60 characters), author (the series)."""
    return F.left(F.split("text", "\n")[0], F.lit(60)).alias("title"), F.col("source").alias("author")


def _described(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """With week, unit, kind, authority, topic, unit_name."""
    return _attributes(rows).join(F.broadcast(weeks(spark).select("week", "topic")), "week", "left").join(F.broadcast(units(spark)), "unit", "left")  # 14 and 2 rows


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, title (the first line, 60 characters), author (the series), week, unit, kind, authority, tokens, topic, unit_name."""
    return _described(spark, table(spark, folder, "documents").select("doc_id", "source", "lang", *_heading(), X.word_count(F.col("text")).alias("tokens")))


def with_context(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks with ctx (title, author, week's topic, unit's name) and full (that and the body)."""
    joined = rows.join(docs.select("doc_id", "title", "author", "topic", "unit_name"), "doc_id")
    return joined.withColumn("ctx", context()).withColumn("full", F.concat_ws("\n", "ctx", "body"))


# --- files


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,pptx,docx}") -> DataFrame:
    """Files below a folder: path, name, ext, length, content, and the first 16 characters of their SHA-256."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "length", "content", fingerprint(F.col("content")).alias("hash"))


def fingerprint(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(16))


def extract_units(files: DataFrame, extract) -> DataFrame:
    """Pages, slides or paragraphs of files: extract(ext, content) gives (number, text, pictures, tables, notes) for each; parsers plug in here.

    A parser that knows no tables or notes may leave these out.
    """

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = [(r.path, int(n), text, int(pictures), *(tuple(rest) or (0, None))) for r in frame.itertuples() for n, text, pictures, *rest in extract(r.ext, r.content)]
            yield pd.DataFrame(out, columns=["path", "n", "text", "pictures", "tables", "notes"])

    units_ = files.select("path", "ext", "content").mapInPandas(run, "path string, n int, text string, pictures int, tables int, notes string")
    return units_.withColumns({"text": X.tidy(F.col("text")), "notes": X.tidy(F.col("notes"))})


def office_text(ext: str, content: bytes) -> list[tuple[int, str, int, int, str | None]]:
    """Paragraphs and table rows of .docx files and slides of .pptx files, with pictures, tables and speaker notes, by the standard library alone."""
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    space = {"docx": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "pptx": "http://schemas.openxmlformats.org/drawingml/2006/main"}.get(ext)
    if not space:
        return []

    def said(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{{{space}}}t"))

    def notes(z, number: int) -> str | None:
        """What the slide's relations name as its notes; without relations there are none."""
        name = f"ppt/slides/_rels/slide{number}.xml.rels"
        targets = [r.get("Target", "") for r in ET.fromstring(z.read(name)).iter()] if name in z.namelist() else []
        for t in targets:
            if "notesSlide" in t and (page := "ppt/" + t.removeprefix("../").removeprefix("/ppt/")) in z.namelist():
                return "\n".join(x for p in ET.fromstring(z.read(page)).iter(f"{{{space}}}p") if (x := said(p)).strip()) or None
        return None

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if ext == "docx":
            body = ET.fromstring(z.read("word/document.xml"))
            inside = {p for row in body.iter(f"{{{space}}}tr") for p in row.iter(f"{{{space}}}p")}
            lines = [said(p) for p in body.iter(f"{{{space}}}p") if p not in inside]
            lines += [" | ".join(said(c).strip() for c in row.iter(f"{{{space}}}tc")) for row in body.iter(f"{{{space}}}tr")]
            return [(1, "\n".join(x for x in lines if x.strip()), 0, sum(1 for _ in body.iter(f"{{{space}}}tbl")), None)]
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for number, name in names:
            slide = ET.fromstring(z.read(name))
            rows = list(slide.iter(f"{{{space}}}tr"))
            inside = {p for row in rows for p in row.iter(f"{{{space}}}p")}
            lines = [said(p) for p in slide.iter(f"{{{space}}}p") if p not in inside]
            lines += [" | ".join(said(c).strip() for c in row.iter(f"{{{space}}}tc")) for row in rows]
            out.append((number, "\n".join(x for x in lines if x.strip()), sum(1 for n in slide.iter() if n.tag.endswith("}pic")), sum(1 for _ in slide.iter(f"{{{space}}}tbl")), notes(z, number)))
        return out


def ocr_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of scanned files: stem, n, text, from one JSON file for each."""
    rows = spark.read.schema("paginas array<struct<pagina:int,texto:string>>").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"), F.explode("paginas").alias("p")).select("stem", F.col("p.pagina").alias("n"), X.clean_scan(F.col("p.texto")).alias("text"))


def prefer_scan(native: DataFrame, scanned: DataFrame, margin: float = 1.15) -> DataFrame:
    """Of both (stem, n, text): a stem's scanned pages if they hold more than margin times the characters of its own."""
    size = lambda rows, name: rows.groupBy("stem").agg(F.sum(F.length("text")).alias(name))
    both = size(native, "own").join(size(scanned, "ocr"), "stem", "full_outer")
    better = both.filter(F.coalesce("ocr", F.lit(0)) > margin * F.coalesce("own", F.lit(0))).select("stem")
    return native.join(better, "stem", "left_anti").withColumn("ocr", F.lit(False)).unionByName(scanned.join(better, "stem", "left_semi").withColumn("ocr", F.lit(True)))


def write_blocks(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).json(path)


def write_manifest(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest: one object with the list `documentos`, or a line for each document."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("documentos").alias("d")).select("d.*") if "documentos" in rows.columns else rows


def write_vectors(rows: DataFrame, path: str, provider: str, model: str) -> None:
    """Ids and unit vectors, with the provider and model that made them."""
    rows.select("id", X.unit_length(F.col("vector")).cast("array<float>").alias("vector")).withColumns({"provider": F.lit(provider), "model": F.lit(model)}).write.mode("append").parquet(path)


def read_vectors(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Vectors of one provider: those of another are never compared with them."""
    return spark.read.parquet(path).filter(F.col("provider") == provider)


def embed_missing(rows: DataFrame, stored: DataFrame | None, embed, provider: str) -> DataFrame:
    """Vectors of rows (id, text) that the store lacks for this provider: embed(list of texts) gives them, a batch at a time."""
    todo = rows.join(stored.filter(F.col("provider") == provider).select("id"), "id", "left_anti") if stored is not None else rows

    def run(batches):
        import pandas as pd

        for frame in batches:
            for a in range(0, len(frame), 96):
                part = frame.iloc[a : a + 96]
                yield pd.DataFrame({"id": part["id"], "vector": [list(map(float, v)) for v in embed(list(part["text"]))]})

    return todo.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, vector array<double>")


def keep_labels(candidates: DataFrame, before: DataFrame) -> DataFrame:
    """Candidates (question, block_id) with the labels given before, else `pendiente`."""
    return candidates.join(before.select("question", "block_id", "gold"), ["question", "block_id"], "left").withColumn("gold", F.coalesce("gold", F.lit("pendiente")))
