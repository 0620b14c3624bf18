"""SQL pieces that the oracles share; each name is a common table expression over the given tables."""

from __future__ import annotations

from gleaner.functions.wordlists import QUESTION_WORDS, STOP_WORDS, UNITS, WEEKS


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, list):
        return "[" + ", ".join(map(quoted, value)) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({columns}))"


def plain(e: str) -> str:
    return f"strip_accents(lower({e}))"


def tokens(e: str) -> str:
    return f"list_filter(regexp_extract_all({plain(e)}, '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({quoted(STOP_WORDS)}, t))"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def unique(e: str) -> str:
    """A list's elements at their first places."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def count_words(e: str) -> str:
    return f"len(regexp_extract_all({e}, '\\S+'))"


def has_phrase(e: str, phrases: list[str]) -> str:
    padded = f"(' ' || trim(regexp_replace({plain(e)}, '[^a-z0-9]+', ' ', 'g')) || ' ')"
    return "(" + " OR ".join(f"contains({padded}, {quoted(' ' + p + ' ')})" for p in phrases) + ")"


def question_words() -> str:
    return quoted(QUESTION_WORDS)


_K = "CAST(substr(source, 4) AS INTEGER)"
_ATTRIBUTES = f"""{_K} % 14 + 1 AS week, CASE WHEN {_K} % 14 + 1 < 8 THEN 1 WHEN {_K} % 14 + 1 > 8 THEN 2 END AS unit,
 ['lectura', 'clase', 'rector', 'evaluacion', 'guion'][{_K} % 5 + 1] AS kind, ['academica', 'docente', 'oficial', 'oficial', 'oficial'][{_K} % 5 + 1] AS authority"""

CTE = {
    "weeks": f"weeks AS {values(WEEKS, 'week, unit, dates, topic')}",
    "units": f"units AS {values(UNITS, 'unit, unit_name')}",
    "lines": "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)",
    "blocks": f"blocks AS (SELECT doc_id * 1048576 + n AS block_ix, doc_id || '#p' || n AS block_id, doc_id, n, body, {count_words('body')} AS tokens, source, lang, {_ATTRIBUTES} FROM lines WHERE length({strip('body')}) >= 40)",
    "docs": f"docs AS (SELECT d.*, w.topic, u.unit_name FROM (SELECT doc_id, source, lang, left(string_split(text, chr(10))[1], 60) AS title, source AS author, {count_words('text')} AS tokens, {_ATTRIBUTES} FROM documents) d LEFT JOIN weeks w USING (week) LEFT JOIN units u ON u.unit = d.unit)",
    "full_blocks": "full_blocks AS (SELECT b.*, c.ctx, c.ctx || chr(10) || b.body AS whole FROM blocks b JOIN (SELECT doc_id, concat_ws(' | ', nullif(title, ''), nullif(author, ''), nullif(topic, ''), nullif(unit_name, '')) AS ctx FROM docs) c USING (doc_id))",
    "body_post": f"body_post AS (SELECT block_ix, term, count(*) AS tf FROM (SELECT block_ix, unnest({tokens('body')}) AS term FROM blocks) GROUP BY ALL)",
    "full_post": f"full_post AS (SELECT block_ix, term, count(*) AS tf FROM (SELECT block_ix, unnest({tokens('whole')}) AS term FROM full_blocks) GROUP BY ALL)",
    "ctx_post": f"ctx_post AS (SELECT DISTINCT block_ix, term FROM (SELECT block_ix, unnest({tokens('ctx')}) AS term FROM full_blocks))",
    "n_blocks": "n_blocks AS (SELECT count(*) AS n FROM blocks)",
    "cover_idf": "cover_idf AS (SELECT term, count(*) AS df, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM body_post, n_blocks GROUP BY term)",
    "bm_idf": "bm_idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER () ELSE r END AS idf FROM (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM full_post, n_blocks GROUP BY term))",
    "bm_weights": "bm_weights AS (SELECT p.block_ix, p.term, i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / a.avgdl)) AS weight FROM full_post p JOIN (SELECT block_ix, sum(tf) AS dl FROM full_post GROUP BY 1) l USING (block_ix) JOIN bm_idf i USING (term), (SELECT sum(tf) / max(n) AS avgdl FROM full_post, n_blocks) a)",
    "tf_idf": "tf_idf AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM full_post, n_blocks GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.6 * max(n))",
    "tf_weights": "tf_weights AS (SELECT block_ix, term, r / sqrt(sum(r * r) OVER (PARTITION BY block_ix)) AS weight FROM (SELECT block_ix, term, (1 + ln(tf)) * idf AS r FROM full_post JOIN tf_idf USING (term)))",
    "near": "near AS (SELECT block_ix, doc_id, lag(block_ix) OVER w AS previous, lead(block_ix) OVER w AS next, row_number() OVER w AS position, count(*) OVER (PARTITION BY doc_id) AS total FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY n))",
}
#: In an order in which each needs only earlier ones.
_NEEDS = {
    "blocks": ["lines"], "docs": ["weeks", "units"], "full_blocks": ["blocks", "docs"], "body_post": ["blocks"], "full_post": ["full_blocks"], "ctx_post": ["full_blocks"],
    "n_blocks": ["blocks"], "cover_idf": ["body_post", "n_blocks"], "bm_idf": ["full_post", "n_blocks"], "bm_weights": ["bm_idf"], "tf_idf": ["full_post", "n_blocks"], "tf_weights": ["tf_idf"], "near": ["blocks"],
}


def with_tables(names: str, *more: str, query: str) -> str:
    """WITH the named tables and all they need, then further expressions, then the query."""
    found: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in found:
            found.append(name)

    for name in names.split():
        need(name)
    materialised = [CTE[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in found]
    return "WITH " + ",\n".join([*materialised, *more]) + "\n" + query
