"""Queries over the corpus: text functions, extraction, checks, index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.wordlists import QUESTION_WORDS, STOP_WORDS
from gleaner.operators import evaluate as V
from gleaner.operators import index as I
from gleaner.operators.files import canonical_format, classify_path, file_authors, file_year
from gleaner.plans.oracle import count_words, plain, question_words, quoted, strip, tokens, unique, values, with_tables
from gleaner.plans.registry import query, rows
from gleaner.sources import corpus

_LETTERS = "[a-zA-ZáéíóúñÁÉÍÓÚÑ]{3,}"


@query(with_tables("docs blocks", query="SELECT (SELECT count(*) FROM docs) AS documents, (SELECT CAST(sum(tokens) AS BIGINT) FROM docs) AS doc_tokens, (SELECT count(*) FROM blocks) AS blocks, (SELECT CAST(sum(tokens) AS BIGINT) FROM blocks) AS block_tokens"))
def corpus_totals(spark, d):
    return V.corpus_totals(corpus.documents(spark, d), corpus.blocks(spark, d))


@query(with_tables("docs", query="SELECT kind, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY kind"))
def totals_by_kind(spark, d):
    return V.totals_by(corpus.documents(spark, d), "kind")


@query(with_tables("blocks", query="SELECT kind, authority, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM blocks GROUP BY ALL"))
def blocks_by_kind_and_authority(spark, d):
    return V.totals_by(corpus.blocks(spark, d), "kind", "authority")


@query(with_tables("docs", query="SELECT w.week, count(d.doc_id) AS documents, CAST(coalesce(sum(d.tokens), 0) AS BIGINT) AS tokens, CASE WHEN strip_accents(lower(w.topic)) LIKE '%examen%' THEN 'exam' WHEN coalesce(sum(d.tokens), 0) > 3000 THEN 'ok' WHEN coalesce(sum(d.tokens), 0) = 0 THEN 'VAC' ELSE 'BAJ' END AS status FROM weeks w LEFT JOIN docs d USING (week) GROUP BY w.week, w.topic"))
def week_coverage(spark, d):
    return V.week_coverage(corpus.weeks(spark), corpus.documents(spark, d))


@query("SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return V.duplicates(corpus.table(spark, d, "documents"), "text")


@query(with_tables("docs", query="SELECT doc_id, tokens, CASE WHEN tokens = 0 THEN 'empty' ELSE 'poor' END AS state FROM docs WHERE tokens < 600"))
def short_docs(spark, d):
    return corpus.documents(spark, d).filter("tokens < 600").select("doc_id", "tokens", F.when(F.col("tokens") == 0, "empty").otherwise("poor").alias("state"))


@query(with_tables("blocks", query=f"SELECT block_ix, round(coalesce(list_sum(list_transform(regexp_extract_all(body, '{_LETTERS}'), lambda w: length(w))), 0) / length(body), 6) AS share FROM blocks"))
def word_ratio(spark, d):
    return corpus.blocks(spark, d).select("block_ix", F.round(X.letters_share(F.col("body")), 6).alias("share"))


@query(with_tables("blocks", query=f"SELECT source, count(*) AS blocks, count(*) FILTER (WHERE share < 0.55) AS degraded, round(avg(tokens), 6) AS tokens_per_block, count(*) FILTER (WHERE share < 0.55) > 0.25 * count(*) AS warns FROM (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(body, '{_LETTERS}'), lambda w: length(w))), 0) / length(body) AS share FROM blocks) GROUP BY source"))
def scan_quality(spark, d):
    bad = F.count_if(X.letters_share(F.col("body")) < 0.55)
    return corpus.blocks(spark, d).groupBy("source").agg(F.count("*").alias("blocks"), bad.alias("degraded"), F.round(F.avg("tokens"), 6).alias("tokens_per_block")).withColumn("warns", F.col("degraded") > 0.25 * F.col("blocks"))


@query(with_tables("docs blocks", query="SELECT count(*) FILTER (WHERE sev = 'error') AS errors, count(*) FILTER (WHERE sev = 'warning') AS warnings, CASE WHEN count(*) FILTER (WHERE sev = 'error') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE sev = 'warning') > 0 THEN 'usable' ELSE 'valid' END AS verdict FROM (SELECT 'error' AS sev, count(*) AS n FROM docs WHERE tokens = 0 UNION ALL SELECT 'warning', count(*) FROM docs WHERE tokens > 0 AND tokens < 600 UNION ALL SELECT 'error', count(*) FROM (SELECT block_id FROM blocks GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'error', count(*) FROM blocks WHERE source IS NULL OR n IS NULL) WHERE n > 0"))
def corpus_verdict(spark, d):
    docs, blocks = corpus.documents(spark, d), corpus.blocks(spark, d)
    parts = [
        docs.agg(F.lit("error").alias("severity"), F.count_if(F.col("tokens") == 0).alias("n")),
        docs.agg(F.lit("warning").alias("severity"), F.count_if((F.col("tokens") > 0) & (F.col("tokens") < 600)).alias("n")),
        V.duplicates(blocks, "block_id").agg(F.lit("error").alias("severity"), F.count("*").alias("n")),
        blocks.agg(F.lit("error").alias("severity"), F.count_if(F.col("source").isNull() | F.col("n").isNull()).alias("n")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return V.verdict(every)


@query(with_tables("docs", query="SELECT kind, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(title, '[0-9]{4}')) AS with_year, count(*) FILTER (WHERE title = '') AS without_title FROM docs GROUP BY kind"))
def citability(spark, d):
    return corpus.documents(spark, d).groupBy("kind").agg(F.count("*").alias("documents"), F.count_if(F.col("title").rlike("[0-9]{4}")).alias("with_year"), F.count_if(F.col("title") == "").alias("without_title"))


@query(with_tables("blocks", query="SELECT doc_id, count(*) AS blocks, CAST(sum(tokens) AS BIGINT) AS tokens FROM blocks GROUP BY doc_id"))
def tokens_by_document(spark, d):
    return corpus.blocks(spark, d).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))


@query(with_tables("blocks", query=" UNION ALL ".join(f"SELECT '{k}' AS map, CAST({k} AS VARCHAR) AS key, count(*) AS blocks, min(block_ix) AS first FROM blocks WHERE {k} IS NOT NULL GROUP BY {k}" for k in ("week", "unit", "kind", "authority", "source", "doc_id"))))
def structure_maps(spark, d):
    b, out = corpus.blocks(spark, d), None
    for k in ("week", "unit", "kind", "authority", "source", "doc_id"):
        part = I.structure_map(b, k).select(F.lit(k).alias("map"), F.col(k).cast("string").alias("key"), "blocks", "first")
        out = part if out is None else out.unionByName(part)
    return out


@query(with_tables("docs", query="SELECT doc_id, tokens FROM docs ORDER BY tokens DESC, doc_id LIMIT 8"))
def largest_documents(spark, d):
    return corpus.documents(spark, d).select("doc_id", "tokens").orderBy(F.desc("tokens"), "doc_id").limit(8)


@query(with_tables("blocks", query=f"SELECT block_ix, array_to_string({tokens('body')}, ' ') AS tokens FROM blocks"))
def normalize_tokens(spark, d):
    return corpus.blocks(spark, d).select("block_ix", F.array_join(X.tokens(F.col("body")), " ").alias("tokens"))


@query(f"SELECT item_id, array_to_string({unique('t')}, ' ') AS entities FROM (SELECT item_id, list_filter({tokens('text')}, lambda w: NOT list_contains({question_words()}, w)) AS t FROM benchmark)")
def question_entities(spark, d):
    return corpus.table(spark, d, "benchmark").select("item_id", F.array_join(X.entities(F.col("text")), " ").alias("entities"))


_CAP = "regexp_extract_all(replace(text, ' ', '  '), '(?:^|[^\\p{L}\\p{N}_])([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,})(?:$|[^\\p{L}\\p{N}_])', 1)"


@query(f"""WITH found AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT doc_id, {_CAP} AS l FROM documents)),
 once AS (SELECT doc_id, {plain('w')} AS name, min(i) AS i FROM found WHERE {plain('w')} NOT IN (SELECT unnest({quoted(sorted({*QUESTION_WORDS, *STOP_WORDS}))})) GROUP BY ALL)
 SELECT doc_id, coalesce(string_agg(name, ' ' ORDER BY i), '') AS names FROM documents LEFT JOIN once USING (doc_id) GROUP BY doc_id""")
def capitalised_names(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", F.array_join(X.capitalised(F.col("text")), " ").alias("names"))


@query("SELECT doc_id, left(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7f]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 60) AS slug FROM documents")
def slugs(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, md5({strip('''regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')}) AS tidy FROM documents")
def tidy_text(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", F.md5(X.tidy(F.col("text"))).alias("tidy"))


_SCANS = [
    (1, "Scanned with CamScanner\nLa población andina cayó durante el siglo dieciséis.\n1 1 1i 1 1 on r 1 niii 1i 1 2 3"),
    (2, "Texto corto\n\n\n\nEscaneado con CamScanner hoy\nOtra línea con palabras completas y legibles"),
    (3, "sólo una línea   con    espacios"),
    (4, ""),
]
_SQL_SCANS = f"(SELECT id, body FROM {values(_SCANS, 'id, body')} UNION ALL SELECT 100 + doc_id, text FROM documents)"
_RATIO = f"coalesce(list_sum(list_transform(regexp_extract_all({strip('l')}, '{_LETTERS}'), lambda w: length(w))), 0)"


@query(f"SELECT id, {strip('''regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(body, '(?im)^.*(escaneado con camscanner|scanned with camscanner|camscanner).*$', '', 'g'), chr(10)), lambda l: NOT (length(STRIP) > 20 AND RATIO < 0.5 * length(STRIP))), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')'''.replace('RATIO', _RATIO).replace('STRIP', strip('l')))} AS cleaned FROM {_SQL_SCANS}")
def clean_scans(spark, d):
    """Pages by hand, and the documents as scanned ones."""
    docs = corpus.table(spark, d, "documents").select((100 + F.col("doc_id")).alias("id"), F.col("text").alias("body"))
    return rows(spark, _SCANS, "id long, body string").unionByName(docs).select("id", X.clean_scan(F.col("body")).alias("cleaned"))


_PATHS = [
    (1, "Unidad 1/Semana 3/Contreras_2020_Crisis_demografica.pdf"), (2, "Unidad 2/Semana 11/Clase_11.pptx"), (3, "Trabajos calificados/Rubrica.docx"),
    (4, "Cronograma_HCP_2026_1_A.pdf"), (5, "Unidad 2/HCP_guion_12.docx"), (6, "Unidad 1/Semana 2/Contreras_sf_Concepto.pdf"), (7, "Unidad 1/moneda-190-07.pdf"),
    (8, "Unidad 2/Semana 14/Aldana_Pereyra_2022_Regiones vivas.pdf"), (9, "Lectura 1850 antigua.pdf"), (10, "Unidad 1/Semana 3/Contreras_2020_Crisis_demografica.docx"),
]
_SQL_PATHS = f"(SELECT id, path FROM {values(_PATHS, 'id, path')} UNION ALL SELECT 100 + page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '_2020_x.pdf' WHEN 1 THEN '.pptx' ELSE '_1999.docx' END FROM pages)"


def _paths(spark, d):
    """Paths by hand, and the pages' addresses as those of files."""
    ending = F.when(F.col("page_id") % 3 == 0, "_2020_x.pdf").when(F.col("page_id") % 3 == 1, ".pptx").otherwise("_1999.docx")
    pages = corpus.table(spark, d, "pages").select((100 + F.col("page_id")).alias("id"), F.concat(F.regexp_replace("url", "[?#].*$", ""), ending).alias("path"))
    return rows(spark, _PATHS, "id long, path string").unionByName(pages)


_STEM = "regexp_extract(path, '([^/]+)\\.[^./]+$', 1)"
_KIND = f"CASE WHEN contains(path, 'Trabajos calificados') THEN 'evaluacion' WHEN starts_with({_STEM}, 'Clase') OR contains({_STEM}, 'Clase_') THEN 'clase' WHEN {_STEM} = 'Cronograma_HCP_2026_1_A' OR contains({_STEM}, '122005') THEN 'rector' WHEN starts_with({_STEM}, 'HCP_') THEN 'guion' ELSE 'lectura' END"


@query(f"SELECT id, kind, CASE kind WHEN 'evaluacion' THEN 'oficial' WHEN 'clase' THEN 'docente' WHEN 'rector' THEN 'oficial' WHEN 'guion' THEN 'oficial' ELSE 'academica' END AS authority, TRY_CAST(nullif(regexp_extract(path, '(?:^|/)Unidad (\\d)', 1), '') AS INTEGER) AS unit, TRY_CAST(nullif(regexp_extract(path, '(?:^|/)Semana (\\d+)', 1), '') AS INTEGER) AS week, CASE WHEN kind = 'lectura' THEN array_to_string(list_filter(string_split(replace(regexp_extract(stem || '_0000', '^(.*?)(?:_\\d{{4}}|_sf_)', 1), '_', ' '), ' '), lambda a: length(a) > 2)[1:3], '|') ELSE '' END AS authors, CASE WHEN stem = 'moneda-190-07' THEN 2020 WHEN contains(stem, '_sf_') THEN NULL WHEN y > 1900 AND y < 2030 THEN y END AS year FROM (SELECT *, {_STEM} AS stem, {_KIND} AS kind, TRY_CAST(coalesce(nullif(regexp_extract({_STEM} || '_', '_(\\d{{4}})_', 1), ''), nullif(regexp_extract({_STEM}, '(\\d{{4}})', 1), '')) AS INTEGER) AS y FROM {_SQL_PATHS})")
def classify_paths(spark, d):
    p = _paths(spark, d)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    c = classify_path(F.col("path"), stem)
    out = p.select("id", stem.alias("stem"), *(v.alias(k) for k, v in c.items()))
    return out.select("id", "kind", "authority", "unit", "week", F.array_join(file_authors(F.col("stem"), F.col("kind")), "|").alias("authors"), file_year(F.col("stem"), {"moneda-190-07": 2020}).alias("year"))


@query(f"SELECT stem, CASE WHEN list_contains(e, 'pdf') THEN 'pdf' WHEN list_contains(e, 'pptx') THEN 'pptx' ELSE list_min(e) END AS kept, array_to_string(list_sort(list_filter(e, lambda x: x <> CASE WHEN list_contains(e, 'pdf') THEN 'pdf' WHEN list_contains(e, 'pptx') THEN 'pptx' ELSE list_min(e) END)), '|') AS dropped FROM (SELECT {_STEM} AS stem, list(DISTINCT lower(regexp_extract(path, '\\.([^./]+)$', 1))) AS e FROM {_SQL_PATHS} GROUP BY 1)")
def canonical_formats(spark, d):
    p = _paths(spark, d).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    return canonical_format(p).select("stem", "kept", F.array_join("dropped", "|").alias("dropped"))


_NATIVE = [("a", 1, "corto"), ("a", 2, "más"), ("b", 1, "un texto propio bastante largo"), ("d", 1, "sólo propio")]
_SCANNED = [("a", 1, "un texto escaneado mucho más largo"), ("b", 1, "un texto escaneado"), ("c", 1, "sólo escaneado")]
_BETTER = "SELECT coalesce(n.stem, s.stem) AS stem FROM (SELECT stem, sum(length(text)) AS c FROM native GROUP BY 1) n FULL JOIN (SELECT stem, sum(length(text)) AS c FROM scanned GROUP BY 1) s ON n.stem = s.stem WHERE coalesce(s.c, 0) > 1.15 * coalesce(n.c, 0)"


@query(f"WITH native AS {values(_NATIVE, 'stem, n, text')}, scanned AS {values(_SCANNED, 'stem, n, text')}, better AS ({_BETTER}) SELECT *, FALSE AS ocr FROM native WHERE stem NOT IN (FROM better) UNION ALL SELECT *, TRUE FROM scanned WHERE stem IN (FROM better)")
def prefer_scans(spark, d):
    return corpus.prefer_scan(rows(spark, _NATIVE, "stem string, n int, text string"), rows(spark, _SCANNED, "stem string, n int, text string"))


@query(with_tables("near", query="SELECT * FROM near"))
def neighbors(spark, d):
    return I.neighbours(corpus.blocks(spark, d))


@query(with_tables("full_blocks", query="SELECT block_ix, ctx, md5(whole) AS whole FROM full_blocks"))
def context_enrichment(spark, d):
    return corpus.with_context(corpus.blocks(spark, d), corpus.documents(spark, d)).select("block_ix", "ctx", F.md5("full").alias("whole"))


@query(with_tables("cover_idf", query="SELECT term, df, round(idf, 6) AS idf FROM cover_idf"))
def idf_table(spark, d):
    b = corpus.blocks(spark, d)
    return I.cover_idf(I.postings(b, "body"), I.block_count(b)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(with_tables("bm_idf", query="SELECT term, df, round(idf, 6) AS idf FROM bm_idf"))
def bm25_stats(spark, d):
    b = corpus.with_context(corpus.blocks(spark, d), corpus.documents(spark, d))
    return I.bm25_terms(I.postings(b, "full"), I.block_count(b)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(with_tables("blocks", query=f"SELECT block_ix, i AS position, {strip('s')} AS sentence FROM (SELECT block_ix, unnest(p) AS s, unnest(range(0, len(p))) AS i FROM (SELECT block_ix, list_filter(string_split(regexp_replace(body, '([.!?])\\s+([A-ZÁÉÍÓÚÑ¿¡])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda s: length({strip('s')}) > 40) AS p FROM blocks))"))
def sentence_split(spark, d):
    return corpus.blocks(spark, d).select("block_ix", F.posexplode(X.sentences(F.col("body"))).alias("position", "sentence"))


@query("SELECT page_id, left(sha256(html), 16) AS hash FROM pages")
def file_fingerprints(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", corpus.fingerprint(F.col("html").cast("binary")).alias("hash"))


@query(with_tables("blocks", query="SELECT doc_id, md5(string_agg('[p.' || n || '] ' || body, chr(10) ORDER BY n)) AS context FROM blocks GROUP BY doc_id"))
def full_context(spark, d):
    from gleaner.operators.answers import full_context as run

    return run(corpus.blocks(spark, d)).select("doc_id", F.md5("context").alias("context"))


@query(with_tables("blocks", query=f"SELECT {count_words('body')} AS words, count(*) AS blocks FROM blocks GROUP BY 1"))
def block_lengths(spark, d):
    return corpus.blocks(spark, d).groupBy(F.col("tokens").alias("words")).agg(F.count("*").alias("blocks"))
