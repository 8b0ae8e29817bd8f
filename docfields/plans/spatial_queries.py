"""Queries over blocks, words and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import rules as Ru
from docfields.operators import spatial as P
from docfields.plans.registry import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles

SHARED = "greatest(0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0, least(b.y2, r.y2) - greatest(b.y1, r.y1))"
DX, DY = "(b.x1 + b.x2 - a.x1 - a.x2)", "(b.y1 + b.y2 - a.y1 - a.y2)"


@query("j3_containment_join", f"SELECT doc_id, page_no, ord, shared FROM (SELECT b.doc_id, b.page_no, b.ord, b.x1 + b.x2 BETWEEN 2 * r.x1 AND 2 * r.x2 AND b.y1 + b.y2 BETWEEN 2 * r.y1 AND 2 * r.y2 AS centre, {SHARED} AS shared, (b.x2 - b.x1) * (b.y2 - b.y1) AS area FROM {{blocks}} b JOIN {{regions}} r ON b.doc_id = r.doc_id AND b.page_no = r.page_no) WHERE centre OR (area > 0 AND 2 * shared >= area)")
def _(get):
    return P.contained_blocks(get("blocks"), get("regions"))


@query("j4_nearest_block", f"SELECT doc_id, page_no, ord, match_ord, distance FROM (SELECT a.doc_id, a.page_no, a.ord, b.ord AS match_ord, {DX} * {DX} + {DY} * {DY} AS distance, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY {DX} * {DX} + {DY} * {DY}, b.ord) AS rn FROM {{blocks}} a JOIN {{blocks}} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.ord <> b.ord WHERE a.is_header AND ((b.x1 >= a.x2 AND abs({DY}) < 60) OR (b.y1 >= a.y2 AND abs({DX}) < 300)) AND {DX} * {DX} + {DY} * {DY} < 90000) WHERE rn = 1")
def _(get):
    return P.nearest_block(get("blocks").where("is_header"), get("blocks"))


@query("j5_adjacent_rows", "SELECT doc_id, page_no, ord, next_ord FROM (SELECT doc_id, page_no, ord, y2, lead(ord) OVER w AS next_ord, lead(y1) OVER w AS ny FROM {blocks} WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY ord)) WHERE abs(ny - y2) < 20")
def _(get):
    return P.adjacent_rows(get("blocks"), 20)


_PAIRS = "SELECT a.doc_id, a.page_no, a.ord AS a_ord, b.ord AS b_ord, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS overlap FROM {blocks} a JOIN {blocks} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE a.x1 < 400 AND b.x1 >= 400 AND least(a.y2, b.y2) > greatest(a.y1, b.y1)"


@query("j6_mutual_pairs", f"SELECT doc_id, page_no, a_ord, b_ord, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, a_ord ORDER BY overlap DESC, b_ord) AS ra, row_number() OVER (PARTITION BY doc_id, page_no, b_ord ORDER BY overlap DESC, a_ord) AS rb FROM ({_PAIRS})) WHERE ra = 1 AND rb = 1")
def _(get):
    return P.mutual_pairs(get("blocks").where("x1 < 400"), get("blocks").where("x1 >= 400"))


@query("j6_greedy_pairs", """WITH RECURSIVE l AS (SELECT doc_id, page_no, ord, y1, y2, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS k FROM {blocks} WHERE x1 < 400),
    f AS (SELECT DISTINCT doc_id, page_no, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a_ord, CAST(NULL AS BIGINT) AS b_ord, CAST(NULL AS BIGINT) AS overlap FROM l
        UNION ALL SELECT doc_id, page_no, k, CASE WHEN b_ord IS NULL THEN used ELSE list_append(used, b_ord) END, CASE WHEN b_ord IS NOT NULL THEN a END, b_ord, overlap FROM (
            SELECT f.doc_id, f.page_no, l.k, f.used, l.ord AS a, r.ord AS b_ord, least(l.y2, r.y2) - greatest(l.y1, r.y1) AS overlap, row_number() OVER (PARTITION BY f.doc_id, f.page_no ORDER BY least(l.y2, r.y2) - greatest(l.y1, r.y1) DESC NULLS LAST, r.ord) AS rn
            FROM f JOIN l ON l.doc_id = f.doc_id AND l.page_no = f.page_no AND l.k = f.k + 1
            LEFT JOIN {blocks} r ON r.doc_id = f.doc_id AND r.page_no = f.page_no AND r.x1 >= 400 AND least(l.y2, r.y2) > greatest(l.y1, r.y1) AND NOT list_contains(f.used, r.ord)) WHERE rn = 1)
    SELECT doc_id, page_no, a_ord, b_ord, overlap FROM f WHERE b_ord IS NOT NULL""")
def _(get):
    return P.greedy_pairs(get("blocks").where("x1 < 400"), get("blocks").where("x1 >= 400"))


@query("j7_header_above", "SELECT doc_id, page_no, ord, header_ord FROM (SELECT b.doc_id, b.page_no, b.ord, h.ord AS header_ord, row_number() OVER (PARTITION BY b.doc_id, b.page_no, b.ord ORDER BY h.y1 DESC NULLS LAST, h.ord DESC) AS rn FROM {blocks} b LEFT JOIN (SELECT * FROM {blocks} WHERE is_header) h ON b.doc_id = h.doc_id AND b.page_no = h.page_no AND h.y1 < b.y1 WHERE NOT b.is_header) WHERE rn = 1")
def _(get):
    return P.header_above(get("blocks"))


@query("j8_segments", "SELECT doc_id, page_no, ord, coalesce(header_ord, 0) AS segment FROM (SELECT b.doc_id, b.page_no, b.ord, b.has, h.ord AS header_ord, row_number() OVER (PARTITION BY b.doc_id, b.page_no, b.ord ORDER BY h.y1 DESC NULLS LAST, h.ord DESC) AS rn FROM (SELECT *, max(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no) AS has FROM {blocks}) b LEFT JOIN (SELECT * FROM {blocks} WHERE is_header) h ON b.doc_id = h.doc_id AND b.page_no = h.page_no AND h.y1 <= b.y1) WHERE rn = 1 AND (has = 0 OR header_ord IS NOT NULL)")
def _(get):
    return P.segments(get("blocks"))


@query("j9_nearest_context", "SELECT doc_id, page_no, ord, note_ord FROM (SELECT a.doc_id, a.page_no, a.ord, b.ord AS note_ord, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY b.y1 - a.y2, b.ord) AS rn FROM {blocks} a JOIN {blocks} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE a.is_header AND b.y1 >= a.y2) WHERE rn = 1")
def _(get):
    from docfields.operators.extract import nearest_below

    return nearest_below(get("blocks").where("is_header"), get("blocks"))


_ABOVE = "SELECT doc_id, page_no, ord, context_ord, context FROM (SELECT a.doc_id, a.page_no, a.ord, b.ord AS context_ord, b.v AS context, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY b.y2 DESC, b.ord) AS rn FROM {blocks} a LEFT JOIN (SELECT *, nullif(regexp_extract(text, '([AN] [0-9])', 1), '') AS v FROM {blocks}) b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.y2 < a.y1 AND b.v IS NOT NULL WHERE a.is_header) WHERE rn = 1"


@query("j9_context_above", _ABOVE)
def _(get):
    return P.context_above(get("blocks").where("is_header"), get("blocks"), "([AN] [0-9])")


@query("j9_context_below", "SELECT doc_id, page_no, ord, CASE WHEN rn <= 3 AND v IS NOT NULL THEN o END AS context_ord, CASE WHEN rn <= 3 THEN v END AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, ord ORDER BY v IS NULL, rn) AS pick FROM (SELECT a.doc_id, a.page_no, a.ord, b.ord AS o, nullif(regexp_extract(b.text, 'N [0-9]'), '') AS v, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY b.y1, b.ord) AS rn FROM {blocks} a LEFT JOIN {blocks} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.y1 > a.y2 WHERE a.is_header)) WHERE pick = 1")
def _(get):
    return P.context_below(get("blocks").where("is_header"), get("blocks"), "N [0-9]", 3)


@query("j10_glyph_labels", f"SELECT doc_id, page_no, ord, label_ord FROM (SELECT a.doc_id, a.page_no, a.ord, b.ord AS label_ord, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY {DX} * {DX} + {DY} * {DY}, b.ord) AS rn FROM {{blocks}} a JOIN {{blocks}} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE a.ord % 5 = 0 AND b.ord % 5 <> 0 AND abs({DY}) <= 50) WHERE rn = 1")
def _(get):
    return P.glyph_labels(get("blocks").where("ord % 5 = 0"), get("blocks").where("ord % 5 <> 0"))


_GLYPHS = "substr('☑☐þ¨x', CAST(1 + ord % 5 AS INT), 1) || CASE WHEN x1 % 3 = 0 THEN '✔' ELSE ' y' END"


@query("j10_glyph_states", f"SELECT doc_id, page_no, ord, place, glyph, CASE WHEN contains('þ✔☑', glyph) THEN 'CHECKED' WHEN contains('¨☐', glyph) THEN 'UNCHECKED' ELSE 'AMBIGUOUS_CHECKBOX' END AS state FROM (SELECT doc_id, page_no, ord, font, unnest(range(length(g))) AS place, unnest(string_split(g, '')) AS glyph FROM (SELECT *, {_GLYPHS} AS g, CASE WHEN ord % 4 = 0 THEN 'Wingdings 2' END AS font FROM {{blocks}})) WHERE contains('þ✔☑¨☐', glyph) OR font IS NOT NULL")
def _(get):
    spans = get("blocks").select("doc_id", "page_no", "ord", F.expr(_GLYPHS).alias("text"), F.when(F.col("ord") % 4 == 0, "Wingdings 2").alias("font"))
    return P.glyph_states(spans).select("doc_id", "page_no", "ord", "place", "glyph", "state")


@query("j11_text_in_boxes", "SELECT r.doc_id, r.page_no, r.x1, r.y1, r.x2, r.y2, string_agg(b.text, ' ' ORDER BY b.ord) AS text FROM (SELECT DISTINCT doc_id, page_no, x1, y1, x2, y2 FROM {regions}) r JOIN {blocks} b ON b.doc_id = r.doc_id AND b.page_no = r.page_no WHERE b.x1 < r.x2 + 5 AND b.x2 > r.x1 - 5 AND b.y1 < r.y2 + 5 AND b.y2 > r.y1 - 5 GROUP BY ALL")
def _(get):
    return P.text_in_boxes(get("regions"), get("blocks"))


@query("j20_checkbox_over_text", "SELECT r.doc_id, r.page_no, coalesce(c.checked, r.region_type = 'table') AS flag FROM {regions} r LEFT JOIN (SELECT doc_id, page_no, max(CASE WHEN x1 % 2 = 0 THEN 1 ELSE 0 END) = 1 AS checked FROM {blocks} WHERE ord % 5 = 0 GROUP BY ALL) c ON r.doc_id = c.doc_id AND r.page_no = c.page_no")
def _(get):
    boxes = get("blocks").where("ord % 5 = 0").groupBy(*P.PAGE).agg(F.bool_or(F.col("x1") % 2 == 0).alias("checked"))
    return get("regions").join(boxes, P.PAGE, "left").select(*P.PAGE, F.coalesce("checked", F.col("region_type") == "table").alias("flag"))


@query("a1_words_to_lines", "SELECT doc_id, page_no, block_no, line_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY x1, ord) AS line_text, avg(conf_pct) AS conf FROM {blocks} GROUP BY ALL")
def _(get):
    return P.words_to_lines(get("blocks"))


@query("a2_paragraph_boxes", "SELECT doc_id, page_no, block_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {blocks} GROUP BY ALL")
def _(get):
    return get("blocks").groupBy(*P.PAGE, "block_no").agg(*[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")])


@query("a3_detect_table", "SELECT doc_id, page_no, count(*) AS lines, count(*) FILTER (cols > 1) AS multi, (count(*) FILTER (cols > 1)) * 100 >= count(*) * 35 OR (count(*) >= 2 AND count(*) FILTER (cols > 1) >= 2) AS is_table FROM (SELECT doc_id, page_no, line_no, 1 + coalesce(sum(CASE WHEN g > 40 THEN 1 ELSE 0 END), 0) AS cols FROM (SELECT doc_id, page_no, line_no, x1 - lag(x2) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x1, ord) AS g FROM {blocks}) GROUP BY ALL) GROUP BY ALL")
def _(get):
    return P.detect_tables(get("blocks"))


@query("a4_page_summary", "SELECT block_no, is_header, count(*) AS blocks, sum(x2 - x1) AS width FROM {blocks} GROUP BY ROLLUP (block_no, is_header)")
def _(get):
    return get("blocks").rollup("block_no", "is_header").agg(F.count("*").alias("blocks"), F.sum(F.col("x2") - F.col("x1")).alias("width"))


@query("a16_x_histogram", "SELECT doc_id, page_no, rank, bin, n FROM (SELECT doc_id, page_no, bin, n, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, f) AS rank FROM (SELECT doc_id, page_no, CAST(floor(x1 / 20) AS BIGINT) AS bin, count(*) AS n, min(ord) AS f FROM {blocks} GROUP BY ALL)) WHERE rank <= 2")
def _(get):
    return P.x_histogram(get("blocks"))


@query("a17_page_confidence", "SELECT doc_id, page_no, avg(conf_pct) AS confidence FROM {blocks} GROUP BY 1, 2")
def _(get):
    return get("blocks").groupBy("doc_id", "page_no").agg(F.avg("conf_pct").alias("confidence"))


def _fold(name: str, c: str, tolerance: int) -> str:
    """Recursive SQL of lines along c."""
    far = f"abs(s.v * f.n - f.total) > {tolerance} * f.n"
    return f"""{name}_s AS (SELECT doc_id, page_no, ord, {c} AS v, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {c}, ord) AS k FROM {{blocks}}),
    {name} AS (SELECT doc_id, page_no, ord, k, v AS total, CAST(1 AS BIGINT) AS n, 1 AS line FROM {name}_s WHERE k = 1
          UNION ALL SELECT s.doc_id, s.page_no, s.ord, s.k, CASE WHEN {far} THEN s.v ELSE f.total + s.v END, CASE WHEN {far} THEN 1 ELSE f.n + 1 END,
                 CASE WHEN {far} THEN f.line + 1 ELSE f.line END FROM {name} f JOIN {name}_s s ON s.doc_id = f.doc_id AND s.page_no = f.page_no AND s.k = f.k + 1)"""


@query("w4_cluster_lines", f"WITH RECURSIVE {_fold('y', 'y1', 12)} SELECT doc_id, page_no, ord, line FROM y")
def _(get):
    return P.cluster_lines(get("blocks"))


@query("w5_reconstruct_grid", f"""WITH RECURSIVE {_fold('y', 'y1', 12)}, {_fold('x', 'x1', 20)},
    c AS (SELECT b.doc_id, b.page_no, x.line, trunc(sum(b.x1) / count(*)) AS centre FROM {{blocks}} b JOIN x ON x.doc_id = b.doc_id AND x.page_no = b.page_no AND x.ord = b.ord GROUP BY 1, 2, 3),
    n AS (SELECT b.*, c.line AS near, row_number() OVER (PARTITION BY b.doc_id, b.page_no, b.ord ORDER BY abs(b.x1 - c.centre), c.line) AS rn FROM {{blocks}} b JOIN c ON c.doc_id = b.doc_id AND c.page_no = b.page_no)
    SELECT n.doc_id, n.page_no, y.line AS row, n.near AS "column", string_agg(n.text, ' ' ORDER BY n.y1, n.x1, n.ord) AS cell_text, avg(n.x1) AS x, avg(n.y1) AS y
    FROM n JOIN y ON y.doc_id = n.doc_id AND y.page_no = n.page_no AND y.ord = n.ord WHERE n.rn = 1 GROUP BY 1, 2, 3, 4""")
def _(get):
    return P.grid(get("blocks"))


@query("w6_merge_cells", "SELECT doc_id, page_no, col, cell, min(y1) AS y1, max(y2) AS y2, count(*) AS n FROM (SELECT *, sum(isnew) OVER (PARTITION BY doc_id, page_no, col ORDER BY y1, ord ROWS UNBOUNDED PRECEDING) AS cell FROM (SELECT *, CASE WHEN y1 - max(y2) OVER (PARTITION BY doc_id, page_no, col ORDER BY y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5 THEN 0 ELSE 1 END AS isnew FROM (SELECT *, CAST(floor(x1 / 200) AS BIGINT) AS col FROM {blocks}))) GROUP BY ALL")
def _(get):
    return P.merge_cells(get("blocks"), 5)


@query("w7_words_to_cells", "SELECT doc_id, page_no, cell, min(x1) AS x1, max(x2) AS x2, count(*) AS n FROM (SELECT *, sum(isnew) OVER (PARTITION BY doc_id, page_no ORDER BY y1, x1, ord ROWS UNBOUNDED PRECEDING) AS cell FROM (SELECT *, CASE WHEN abs(y1 - lag(y1) OVER w) < 5 AND x1 - lag(x2) OVER w < 15 THEN 0 ELSE 1 END AS isnew FROM {blocks} WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y1, x1, ord))) GROUP BY ALL")
def _(get):
    return P.words_to_cells(get("blocks"))


@query("w8_column_split", """WITH bins AS (SELECT doc_id, page_no, bin, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, f) AS rank FROM (SELECT doc_id, page_no, CAST(floor(x1 / 20) AS BIGINT) AS bin, count(*) AS n, min(ord) AS f FROM {blocks} GROUP BY ALL)),
    mids AS (SELECT doc_id, page_no, CASE WHEN count(*) = 2 AND max(bin) - min(bin) >= 4 THEN (min(bin) + max(bin) + 1) * 10 END AS mid FROM bins WHERE rank <= 2 GROUP BY doc_id, page_no),
    sides AS (SELECT b.doc_id, b.page_no, any_value(mid) AS mid, count(*) FILTER (x1 < mid) AS l, count(*) AS c FROM {blocks} b JOIN mids USING (doc_id, page_no) GROUP BY 1, 2),
    gaps AS (SELECT doc_id, page_no, x1, lead(x1) OVER (PARTITION BY doc_id, page_no ORDER BY x1, ord) AS nx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x1, ord) AS rn, count(*) OVER (PARTITION BY doc_id, page_no) AS c FROM {blocks}),
    best AS (SELECT doc_id, page_no, x1, nx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY nx - x1 DESC, x1) AS r FROM gaps WHERE rn * 100 >= 15 * c AND rn * 100 <= 85 * c AND nx > x1)
    SELECT s.doc_id, s.page_no, CAST(coalesce(CASE WHEN l * 100 >= 15 * c AND (c - l) * 100 >= 15 * c THEN mid END, floor(x1 + (nx - x1) / 2), 300) AS BIGINT) AS split FROM sides s LEFT JOIN best ON s.doc_id = best.doc_id AND s.page_no = best.page_no AND r = 1""")
def _(get):
    return P.column_split(get("blocks"))


@query("w10_reading_order", "SELECT doc_id, page_no, region_type, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y1, x1, x2, y2) - 1 AS reading_order FROM {regions}")
def _(get):
    return P.reading_order(get("regions")).select("doc_id", "page_no", "region_type", "reading_order")


@query("s8_page_markup", "SELECT doc_id, page_no, string_agg('<' || region_type || ' bbox=\"' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '\"/>', chr(10) ORDER BY y1, x1) AS markup FROM {regions} GROUP BY 1, 2")
def _(get):
    return P.page_markup(get("regions"))


@query("c20_bbox_normalize", f"SELECT b.doc_id, b.page_no, b.ord, b.x1 * 1000 // 900 AS nx1, b.y1 * 1000 // 100 AS ny1, {SHARED} AS shared FROM {{blocks}} b JOIN {{regions}} r ON b.doc_id = r.doc_id AND b.page_no = r.page_no")
def _(get):
    boxes = get("regions").select(*P.PAGE, *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    joined = get("blocks").join(boxes, P.PAGE)
    shared = S.intersection(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "r_x1", "r_y1", "r_x2", "r_y2")])
    return joined.select(*P.PAGE, "ord", F.expr("x1 * 1000 div 900").alias("nx1"), F.expr("y1 * 1000 div 100").alias("ny1"), shared.alias("shared"))


_ORG = "regexp_matches({c}, '" + Ru.ORGANISATIONS + "')"
_ENTITY = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}')" for _, p in Ru.ENTITIES) + f" WHEN {_ORG.format(c='text')} THEN CASE WHEN strpos(text, '/') = 0 THEN text ELSE trim(CASE WHEN {_ORG.format(c="split_part(text, '/', 2)")} THEN split_part(text, '/', 2) ELSE split_part(text, '/', 1) END) END END"
_TAG = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{name}'" for name, p in Ru.ENTITIES) + f" WHEN {_ORG.format(c='text')} THEN 'ORG' ELSE 'O' END"


@query("x13_entities", f"SELECT doc_id, page_no, ord, {_TAG} AS tag, {_ENTITY} AS entity FROM {{tender_lines}}")
def _(get):
    return Ru.entities(get("tender_lines")).select("doc_id", "page_no", "ord", "tag", "entity")


@query("x13_entity_spans", f"SELECT doc_id, page_no, tag, span, string_agg(text, ' ' ORDER BY ord) AS span_text FROM (SELECT *, sum(isnew) OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS span FROM (SELECT *, CASE WHEN tag = lag(tag) OVER (PARTITION BY doc_id, page_no ORDER BY ord) THEN 0 ELSE 1 END AS isnew FROM (SELECT *, {_TAG} AS tag FROM {{tender_lines}}))) GROUP BY ALL")
def _(get):
    from docfields.operators.extract import tag_spans

    return tag_spans(Ru.entities(get("tender_lines")))
