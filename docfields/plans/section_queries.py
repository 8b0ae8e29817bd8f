"""Queries over sections of texts. Their SQL reads texts line by line, with its own patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import extract as X
from docfields.operators import sections as Se
from docfields.plans.registry import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles

# every line with its place; lines that head a section with their level and label
_LINES = r"""WITH l AS (SELECT *, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM (
        SELECT doc_id, length(text) AS size, unnest(s) AS line, unnest(range(len(s))) AS j FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM {sectioned}))),
    m AS (SELECT *, upper(trim(line)) AS u FROM l),
    h AS (SELECT *, CASE WHEN regexp_matches(u, '^SECTION[ -]*([IVXLC]+|[0-9]+)\b') THEN 'SECTION-' || regexp_extract(u, '^SECTION[ -]*([IVXLC]+|[0-9]+)', 1) WHEN regexp_matches(u, '^ANNEXURE[ -]*([IVXLC]+|[0-9]+|[A-Z])\b') THEN 'ANNEXURE-' || regexp_extract(u, '^ANNEXURE[ -]*([IVXLC]+|[0-9]+|[A-Z])', 1)
            WHEN regexp_matches(u, '^CLAUSE[ -]*(NO[.]? *)?[0-9]') THEN 'CLAUSE-' || regexp_extract(u, '([0-9]+([.][0-9]+)*)', 1) WHEN regexp_matches(u, '^[0-9]+([.][0-9]+)*([. ]|$)') THEN 'ITEM-' || regexp_extract(u, '^([0-9]+([.][0-9]+)*)', 1) END AS label FROM m),
    v AS (SELECT *, CASE WHEN label IS NULL THEN NULL WHEN label LIKE 'SECTION-%' OR label LIKE 'ANNEXURE-%' THEN 1 WHEN label LIKE 'CLAUSE-%' THEN 2 ELSE least(4, 2 + length(label) - length(replace(label, '.', ''))) END AS level FROM h),
    q AS (SELECT * FROM v WHERE label IS NOT NULL OR j = 0),
    s AS (SELECT q.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY q.j) - CASE WHEN first(q.label IS NULL) OVER (PARTITION BY q.doc_id ORDER BY q.j) THEN 1 ELSE 0 END AS n, coalesce(q.level, 0) AS level, coalesce(q.label, '') AS label, CASE WHEN q.label IS NOT NULL THEN trim(q.line) END AS heading, CAST(q.place AS BIGINT) AS start, q.size FROM q),
    t AS (SELECT *, coalesce((SELECT min(o.start) - 1 FROM s o WHERE o.doc_id = s.doc_id AND o.start > s.start AND (s.level = 0 OR o.level <= s.level)), size + 1) AS stop FROM s),
    a AS (SELECT t.doc_id, t.n, coalesce(string_agg(u.label, '/' ORDER BY u.n) FILTER (u.level > 0), '') AS path, max(u.n) FILTER (u.n < t.n AND u.level > 0) AS parent FROM t JOIN t u ON u.doc_id = t.doc_id AND (u.n = t.n OR (u.start <= t.start AND t.start < u.stop)) GROUP BY 1, 2)"""


@query("x2_section_table", _LINES + " SELECT t.doc_id, t.n, t.level, t.label, t.heading, t.start, t.stop, a.parent, a.path FROM t JOIN a ON a.doc_id = t.doc_id AND a.n = t.n")
def _(get):
    return Se.section_table(get("sectioned")).select("doc_id", "n", "level", "label", "heading", "start", "stop", "parent", F.array_join("path", "/").alias("path"))


@query("x2_first_slice", r"""WITH l AS (SELECT doc_id, j, line, sum(CASE WHEN j > 0 AND regexp_matches(upper(trim(line)), '^(SECTION|ANNEXURE|CLAUSE|[0-9]+([. ]|$))') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) AS piece
        FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {sectioned}))),
    p AS (SELECT doc_id, piece, lower(string_agg(line, chr(10) ORDER BY j)) AS body FROM l GROUP BY 1, 2),
    f AS (SELECT doc_id, arg_min(regexp_extract(substr(body, strpos(body, 'security deposit') + 16), '([0-9]+) ?%', 1), piece) AS pct FROM p WHERE strpos(body, 'security deposit') > 0 AND regexp_matches(substr(body, strpos(body, 'security deposit') + 16), '[0-9] ?%') GROUP BY 1)
    SELECT doc_id, pct FROM {sectioned} LEFT JOIN f USING (doc_id)""")
def _(get):
    return get("sectioned").select("doc_id", Se.first_slice(F.col("text"), r"security\s+deposit", r"([0-9]+) ?%").alias("pct"))


@query("x2_values_in_sections", _LINES + r""", w AS (SELECT doc_id, k, text, part, 1 + sum(length(part) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) AS place, word FROM (
        SELECT doc_id, text, unnest(w) AS word, unnest(p[1:len(w)]) AS part, unnest(range(len(w))) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+ ?%') AS w, string_split_regex(text, '[0-9]+ ?%') AS p FROM {sectioned})))
    SELECT w.doc_id, CAST(w.place AS BIGINT) AS place, w.word AS value, (SELECT arg_max(t.label, t.start) FROM t WHERE t.doc_id = w.doc_id AND t.start <= w.place AND w.place < t.stop) AS label, (SELECT arg_max(a.path, t.start) FROM t JOIN a ON a.doc_id = t.doc_id AND a.n = t.n WHERE t.doc_id = w.doc_id AND t.start <= w.place AND w.place < t.stop) AS path FROM w""")
def _(get):
    docs = get("sectioned")
    values = X.keyword_windows(docs, "[0-9]+ ?%", 0, 0, regex=True).select("doc_id", "place", F.col("match").alias("value"))
    return Se.in_sections(values, Se.section_table(docs)).select("doc_id", "place", "value", F.col("section.label").alias("label"), F.array_join("section.path", "/").alias("path"))


@query("j19_deferred_sections", _LINES + r""", b AS (SELECT t.*, string_agg(v.line, chr(10) ORDER BY v.j) AS own FROM t JOIN v ON v.doc_id = t.doc_id AND v.place >= t.start AND v.place < coalesce((SELECT min(o.start) FROM t o WHERE o.doc_id = t.doc_id AND o.start > t.start), t.size + 2) GROUP BY ALL),
    x AS (SELECT *, nullif(regexp_extract(own, '([0-9]+) ?%', 1), '') AS mine, nullif(upper(regexp_extract(own, 'as per ((Section|Annexure)[ -][A-Z]+)', 1)), '') AS said FROM b),
    y AS (SELECT doc_id, n, heading, mine, CASE WHEN mine IS NULL THEN replace(said, ' ', '-') END AS target FROM x WHERE regexp_matches(heading, 'Payment')),
    z AS (SELECT y.*, (SELECT arg_min(x.mine, x.n) FROM t JOIN x ON x.doc_id = t.doc_id AND x.start >= t.start AND x.start < t.stop WHERE t.doc_id = y.doc_id AND t.label = y.target AND x.mine IS NOT NULL) AS theirs FROM y)
    SELECT doc_id, n, heading, target, coalesce(mine, theirs) AS value, CASE WHEN mine IS NOT NULL THEN 'own' WHEN theirs IS NOT NULL THEN 'deferred' WHEN target IS NOT NULL THEN 'unresolved' ELSE 'none' END AS status FROM z""")
def _(get):
    return Se.deferred_values(Se.section_table(get("sectioned")), "payment", r"([0-9]+) ?%", r"as per (?:the )?((?:section|annexure)[ \t-]*[a-z0-9]+)")
