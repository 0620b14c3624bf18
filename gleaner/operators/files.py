"""What file names and folders say: unit, week, kind, authority, authors, year, and which of several formats to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int(found: Column) -> Column:
    return F.when(found != "", found.cast("int"))


def classify_path(path: Column, stem: Column) -> dict[str, Column]:
    kind = (
        F.when(path.contains("Trabajos calificados"), "evaluacion")
        .when(stem.startswith("Clase") | stem.contains("Clase_"), "clase")
        .when((stem == "Cronograma_HCP_2026_1_A") | stem.contains("122005"), "rector")
        .when(stem.startswith("HCP_"), "guion")
        .otherwise("lectura")
    )
    authority = F.when(kind == "clase", "docente").when(kind == "lectura", "academica").otherwise("oficial")
    # the last folder of each sort counts
    last = lambda pattern: F.coalesce(F.try_element_at(F.regexp_extract_all(path, F.lit(pattern), F.lit(1)), F.lit(-1)), F.lit(""))
    return {"kind": kind, "authority": authority, "unit": _int(last(r"(?:^|/)Unidad (\d)")), "week": _int(last(r"(?:^|/)Semana (\d+)"))}


def file_authors(stem: Column, kind: Column) -> Column:
    """Of readings, up to three words before the year or `_sf_`."""
    head = F.split(stem, r"_\d{4}|_sf_")[0]
    names = F.filter(F.split(F.translate(head, "_", " "), r"\s+"), lambda a: F.length(a) > 2)
    return F.when(kind == "lectura", F.slice(names, 1, 3)).otherwise(F.expr("cast(array() as array<string>)"))


def file_year(stem: Column, known: dict[str, int]) -> Column:
    """A year set by hand, else the first one between underscores, else the first four digits, within 1901 and 2029."""
    between = F.regexp_extract(F.concat(stem, F.lit("_")), r"_(\d{4})_", 1)
    year = _int(F.coalesce(F.nullif(between, F.lit("")), F.regexp_extract(stem, r"(\d{4})", 1)))
    out = F.when(stem.contains("_sf_"), None).when((year > 1900) & (year < 2030), year)
    for name, y in known.items():
        out = F.when(stem == name, y).otherwise(out)
    return out.cast("int")


def canonical_format(files: DataFrame) -> DataFrame:
    """files (stem, ext): kept (pdf, else pptx, else the first) and dropped ones of each stem."""
    per = files.groupBy("stem").agg(F.array_sort(F.collect_set("ext")).alias("all"))
    kept = F.when(F.array_contains("all", "pdf"), "pdf").when(F.array_contains("all", "pptx"), "pptx").otherwise(F.col("all")[0])
    return per.withColumn("kept", kept).withColumn("dropped", F.array_remove("all", F.col("kept")))
