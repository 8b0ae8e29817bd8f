"""Queries over composite operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import composite as C
from docfields.operators import rules as Ru
from docfields.plans.registry import Registry
from docfields.plans.spatial_queries import DX, DY, SHARED
from docfields.plans.text_queries import TYPED

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles


@query("x14_anchored_candidates", f"""
    SELECT doc_id, page_no, ord, match_ord, path, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, ord ORDER BY p) AS rn FROM (
        SELECT doc_id, page_no, ord, m AS match_ord, 'row' AS path, 95 AS score, 0 AS p FROM (SELECT *, lead(ord) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x1, ord) AS m FROM {{blocks}}) WHERE is_header AND m IS NOT NULL
        UNION ALL SELECT doc_id, page_no, ord, m, 'next', 85, 1 FROM (SELECT *, lead(ord) OVER w AS m, lead(y1) OVER w AS ny FROM {{blocks}} WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY ord)) WHERE is_header AND abs(ny - y2) < 20
        UNION ALL SELECT doc_id, page_no, ord, m, 'near', 80, 2 FROM (SELECT a.doc_id, a.page_no, a.ord, b.ord AS m, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY {DX} * {DX} + {DY} * {DY}, b.ord) AS k FROM {{blocks}} a JOIN {{blocks}} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.ord <> b.ord
            WHERE a.is_header AND ((b.x1 >= a.x2 AND abs({DY}) < 60) OR (b.y1 >= a.y2 AND abs({DX}) < 300)) AND {DX} * {DX} + {DY} * {DY} < 90000) WHERE k = 1)) WHERE rn = 1""")
def _(get):
    return C.anchored_candidates(get("blocks"))


_RULES = [
    ("emd_amount", ("emd", "emd amount"), (), "currency"), ("bid_end", ("bid end date time",), (), "datetime"), ("validity", ("validity",), (), "validity"), ("experience", ("experience of",), (), "experience"),
    ("tender_fee", ("tender fee", "fee"), (), "fee"), ("ministry", ("ministry of",), (), "org"), ("pbg_percentage", ("pbg", "epbg percentage(%)"), (), "percentage"), ("make", ("make",), ("battery set",), "nit"), ("mii", ("mii",), (), "yes_no"),
]
_PLACED = "SELECT *, (ord - 1) % 2 * 300 + doc_id % 50 AS x1, CAST(floor((ord - 1) / 2) AS BIGINT) * 20 AS y1, (ord - 1) % 2 * 300 + doc_id % 50 + 100 AS x2, CAST(floor((ord - 1) / 2) AS BIGINT) * 20 + 10 AS y2, CAST(floor((ord - 1) / 2) AS BIGINT) AS line_no FROM {tender_lines}"


def _anchored(rule: tuple) -> str:
    name, anchors, script, kind = rule
    meets = lambda words: " OR ".join(f"regexp_matches(plain, '{Ru.anchor_pattern(w)}')" for w in words) or "false"
    typed = lambda c: f"(SELECT {TYPED[kind]} FROM (SELECT trim({c}) AS t))"
    return f"SELECT *, '{name}' AS field_name, CASE WHEN {meets(script)} THEN 40 ELSE 35 END AS anchor, {typed('rest')} AS v_row, {typed('text')} AS v_same, {typed('nxt')} AS v_next FROM b WHERE {meets(script)} OR {meets(anchors)}"


_NEAR = " UNION ALL ".join(f"SELECT a.doc_id, a.page_no, a.ord, a.field_name, v, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ord ORDER BY d, o) AS rn FROM (SELECT a.*, b.ord AS o, {DX} * {DX} + {DY} * {DY} AS d, (SELECT {TYPED[kind]} FROM (SELECT trim(b.text) AS t)) AS v FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.ord <> b.ord WHERE a.field_name = '{name}' AND ((b.x1 >= a.x2 AND abs({DY}) < 60) OR (b.y1 >= a.y2 AND abs({DX}) < 300)) AND {DX} * {DX} + {DY} * {DY} < 90000) a WHERE v IS NOT NULL" for name, _, _, kind in _RULES)


@query("x14_field_candidates", rf"""WITH p AS ({_PLACED}), b AS (SELECT *, coalesce((SELECT string_agg(trim(o.text), ' ' ORDER BY o.x1, o.ord) FROM p o WHERE o.doc_id = p.doc_id AND o.page_no = p.page_no AND o.line_no = p.line_no AND o.ord <> p.ord), '') AS rest,
        CASE WHEN abs(lead(y1) OVER w - y2) < 50 THEN lead(text) OVER w END AS nxt, trim(regexp_replace(regexp_replace(lower(text), '[/\\_.:\-]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM p WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY ord)),
    a AS ({" UNION ALL ".join(map(_anchored, _RULES))}), n AS ({_NEAR}),
    f AS (SELECT a.*, n.v AS v_near, CASE WHEN v_row IS NOT NULL THEN 'row' WHEN v_same <> trim(text) THEN 'same' WHEN v_next IS NOT NULL THEN 'next' WHEN n.v IS NOT NULL THEN 'near' END AS path FROM a LEFT JOIN n ON n.doc_id = a.doc_id AND n.page_no = a.page_no AND n.ord = a.ord AND n.field_name = a.field_name AND n.rn = 1)
    SELECT doc_id, page_no, ord, field_name, CASE path WHEN 'row' THEN v_row WHEN 'same' THEN v_same WHEN 'next' THEN v_next ELSE v_near END AS value, path, least(100, anchor + CASE WHEN path IN ('row', 'same') THEN 60 ELSE 50 END) AS conf_pct FROM f WHERE path IS NOT NULL""")
def _(get):
    lines = get("tender_lines")
    placed = lines.sparkSession.sql(_PLACED, tender_lines=lines)
    return C.field_candidates(placed, _RULES)


@query("x15_kv_candidates", "SELECT doc_id, line_no, trim(substr(line, 1, strpos(line, ':') - 1)) AS label, trim(substr(line, strpos(line, ':') + 1)) AS value FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {clause_docs})) WHERE strpos(line, ':') > 1 AND length(trim(substr(line, strpos(line, ':') + 1))) BETWEEN 1 AND 199")
def _(get):
    return C.kv_candidates(get("clause_docs"))


_ANCHORS = {"validity": ("Bid Validity (Days)",), "payment": ("Payment Terms", "Payment"), "period": ("Contract Period",), "rules": ("Custom Rules",)}
_PHRASES = " UNION ALL ".join(f"SELECT '{phrase.lower()}' AS anchor, '{field}' AS field_name, {k} AS rank" for k, (phrase, field) in enumerate((p, f) for f, ps in _ANCHORS.items() for p in ps))


# every page of the view has its columns at 0 and 400, so its split lies between
@query("x15_form_candidates", rf"""WITH g AS (SELECT *, x1 >= 200 AS side, CASE WHEN y1 - max(y2) OVER (PARTITION BY doc_id, page_no, x1 >= 200 ORDER BY y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 20 THEN 0 ELSE 1 END AS fresh FROM {{form_blocks}}),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no, side ORDER BY y1, ord) AS cell FROM g),
    c AS (SELECT doc_id, page_no, side, cell, min(y1) AS y1, max(y2) AS y2, min(conf_pct) AS conf_pct, arg_min(ord, y1 * 1000 + ord) AS ord, string_agg(trim(text), ' ' ORDER BY y1, ord) AS text FROM i GROUP BY 1, 2, 3, 4),
    o AS (SELECT l.doc_id, l.page_no, l.ord, l.text AS label, trim(r.text) AS value, least(l.conf_pct, r.conf_pct) AS conf_pct, row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.ord ORDER BY least(l.y2, r.y2) - greatest(l.y1, r.y1) DESC, r.ord) AS p, row_number() OVER (PARTITION BY l.doc_id, l.page_no, r.ord ORDER BY least(l.y2, r.y2) - greatest(l.y1, r.y1) DESC, l.ord) AS q
        FROM c l JOIN c r ON r.doc_id = l.doc_id AND r.page_no = l.page_no AND NOT l.side AND r.side AND least(l.y2, r.y2) > greatest(l.y1, r.y1)),
    n AS (SELECT doc_id, page_no, ord, label, value, conf_pct, 'pair' AS way FROM o WHERE p = 1 AND q = 1 UNION ALL SELECT doc_id, page_no, ord, substr(text, 1, strpos(text, ':') - 1), trim(substr(text, strpos(text, ':') + 1)), conf_pct, 'colon' FROM {{form_blocks}} WHERE contains(text, ':')),
    a AS ({_PHRASES}), t AS (SELECT *, lower(trim(label)) AS t FROM n WHERE trim(label) <> '' AND value <> ''),
    s AS (SELECT t.*, a.*, CAST(floor(100 - 100 * list_min(list_transform(range(1, greatest(1, length(t) - length(anchor) + 1) + 1), lambda k: levenshtein(substr(t, k, length(anchor)), anchor))) / length(anchor)) AS BIGINT) AS score FROM t CROSS JOIN a),
    h AS (SELECT *, floor(100 - 100 * list_min(list_transform(range(1, greatest(1, length(t) - 9) + 1), lambda k: levenshtein(substr(t, k, 10), 'emd detail'))) / 10) >= 85 AS head FROM s)
    SELECT doc_id, page_no, ord, field_name, value, way, conf_pct * score / 100 AS conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, ord, way ORDER BY score DESC, rank) AS rn FROM h WHERE score >= 80 AND NOT (head AND way = 'pair')) WHERE rn = 1
    UNION ALL SELECT * FROM (SELECT DISTINCT doc_id, page_no, ord, field_name, trim(regexp_replace(substr(text, strpos(lower(text), anchor) + length(anchor)), '^[:/\s-]+', '')) AS value, 'suffix' AS way, conf_pct * 85 / 100 AS conf_pct FROM {{form_blocks}} JOIN a ON contains(lower(text), anchor)) WHERE value <> '' AND length(value) < 200""")
def _(get):
    return C.form_candidates(get("form_blocks"), _ANCHORS, ("EMD Detail",))


@query("x16_schedules", "SELECT doc_id, page_no, segment, string_agg(ord || '=' || text, ';' ORDER BY ord) AS specs, count(*) AS n FROM (SELECT doc_id, page_no, ord, text, coalesce(h, 0) AS segment FROM (SELECT b.doc_id, b.page_no, b.ord, b.text, b.has, h.ord AS h, row_number() OVER (PARTITION BY b.doc_id, b.page_no, b.ord ORDER BY h.y1 DESC NULLS LAST, h.ord DESC) AS rn FROM (SELECT *, max(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no) AS has FROM {blocks}) b LEFT JOIN (SELECT * FROM {blocks} WHERE is_header) h ON b.doc_id = h.doc_id AND b.page_no = h.page_no AND h.y1 <= b.y1) WHERE rn = 1 AND (has = 0 OR h IS NOT NULL)) GROUP BY ALL")
def _(get):
    specs = F.array_join(F.transform(F.map_entries("specs"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";")
    return C.schedules(get("blocks")).select("doc_id", "page_no", "segment", specs.alias("specs"), "n")


def _roles(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{words}') THEN '{role}'" for role, words in C.ROLES.items()) + " END"


_VALUE = {role: f"CASE WHEN kind = 'body' AND len(cells) >= 2 THEN cells[list_position(roles, '{role}')] END" for role in C.ROLES}
_LAST = "arg_max({0}, line) FILTER ({0} IS NOT NULL)"


@query("x16_schedule_records", f"""WITH l AS (SELECT doc_id, page_no, CAST(floor(y1 / 30) AS BIGINT) AS line, list(trim(text, ' ') ORDER BY x1, ord) AS cells FROM {{schedule_blocks}} GROUP BY ALL),
    k AS (SELECT *, array_to_string(cells, ' ') AS t, TRY_CAST(regexp_extract(array_to_string(cells, ' '), '{C.SCHEDULE}', 1) AS INTEGER) AS number, nullif(regexp_extract(array_to_string(cells, ' '), '{C.ITEM}', 0), '') AS item0 FROM l),
    q AS (SELECT *, CASE WHEN number IS NOT NULL THEN 'schedule' WHEN item0 IS NOT NULL THEN 'item' WHEN len(cells) >= 2 AND regexp_matches(lower(cells[1]), '{C.SPECIFICATION}') AND NOT regexp_matches(lower(cells[1]), '{C.NOT_SPECIFICATION}') THEN 'spec'
        WHEN regexp_matches(lower(t), '{C.ROLES["consignee_name"]}') AND regexp_matches(lower(t), '{C.ROLES["quantity"]}|{C.ROLES["delivery_days"]}') THEN 'head' WHEN regexp_matches(lower(t), '{C.TABLE_END}') THEN 'end' ELSE 'body' END AS kind FROM k),
    r AS (SELECT *, last_value(CASE WHEN kind = 'head' THEN list_transform(cells, lambda c: {_roles("c")}) WHEN kind IN ('end', 'schedule') THEN CAST([] AS VARCHAR[]) END IGNORE NULLS) OVER w AS roles,
        last_value(CASE WHEN kind = 'schedule' THEN line END IGNORE NULLS) OVER w AS since, last_value(CASE WHEN kind = 'schedule' THEN number END IGNORE NULLS) OVER w AS named, CASE WHEN kind = 'item' THEN item0 END AS item
        FROM q WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, CAST(coalesce(named, 1) + greatest(0, count(item) OVER (PARTITION BY doc_id, page_no, since ORDER BY line ROWS UNBOUNDED PRECEDING) - 1) AS INTEGER) AS schedule FROM r),
    v AS (SELECT *, {", ".join(f"{x} AS {role}" for role, x in _VALUE.items())}, CASE WHEN kind = 'item' THEN TRY_CAST(regexp_extract(t, '{C.ITEM}', 2) AS INTEGER) END AS pieces FROM s),
    d AS (SELECT *, TRY_CAST(nullif(regexp_replace(quantity, '[^0-9]', '', 'g'), '') AS INTEGER) AS quantity_, TRY_CAST(nullif(regexp_replace(delivery_days, '[^0-9]', '', 'g'), '') AS INTEGER) AS days_ FROM v WHERE coalesce(consignee_name, consignee_address, quantity, delivery_days) IS NOT NULL OR kind IN ('item', 'spec'))
    SELECT doc_id, page_no, schedule, {_LAST.format("consignee_name")} AS consignee_name, {_LAST.format("consignee_address")} AS consignee_address, coalesce({_LAST.format("quantity_")}, {_LAST.format("pieces")}) AS quantity, {_LAST.format("days_")} AS delivery_days, {_LAST.format("item")} AS item,
        coalesce(string_agg(trim(regexp_replace(cells[1], '^[^a-zA-Z0-9\\s]+', '')) || '=' || array_to_string(cells[2:], ' '), ';' ORDER BY line) FILTER (kind = 'spec'), '') AS specs FROM d GROUP BY ALL""")
def _(get):
    return C.schedule_records(get("schedule_blocks"))


@query("x17_clause_tables", f"WITH t AS (SELECT DISTINCT doc_id, page_no, ord FROM (SELECT b.doc_id, b.page_no, b.ord, b.x1 + b.x2 BETWEEN 2 * r.x1 AND 2 * r.x2 AND b.y1 + b.y2 BETWEEN 2 * r.y1 AND 2 * r.y2 AS centre, {SHARED} AS shared, (b.x2 - b.x1) * (b.y2 - b.y1) AS area FROM {{blocks}} b JOIN {{regions}} r ON b.doc_id = r.doc_id AND b.page_no = r.page_no WHERE r.region_type = 'table') WHERE centre OR (area > 0 AND 2 * shared >= area)), h AS (SELECT * FROM (SELECT b.doc_id, b.page_no, b.ord, b.x1, b.y1, b.text, h.ord AS header_ord, row_number() OVER (PARTITION BY b.doc_id, b.page_no, b.ord ORDER BY h.y1 DESC, h.ord DESC) AS rn FROM {{blocks}} b JOIN (SELECT * FROM {{blocks}} WHERE is_header) h ON b.doc_id = h.doc_id AND b.page_no = h.page_no AND h.y1 < b.y1 WHERE NOT b.is_header) WHERE rn = 1) SELECT h.doc_id, h.page_no, h.header_ord, string_agg(h.text, ' ' ORDER BY CAST(floor(h.y1 / 10) AS BIGINT), h.x1, h.ord) AS text FROM h JOIN t ON t.doc_id = h.doc_id AND t.page_no = h.page_no AND t.ord = h.ord GROUP BY 1, 2, 3")
def _(get):
    return C.clause_tables(get("blocks"), get("regions"))


def _parts(clause: str, words: tuple[str, ...], noted: bool) -> str:
    note = r"(SELECT left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) FROM (SELECT o.text, row_number() OVER (ORDER BY o.y1, o.ord) AS rn FROM {part_blocks} o WHERE o.doc_id = z.doc_id AND o.page_no = z.page_no AND o.y1 > z.y2) WHERE rn <= 10 AND regexp_matches(lower(text), 'line\s+of\s+credit|bank') ORDER BY rn LIMIT 1)" if noted else "CAST(NULL AS VARCHAR)"
    return rf"""SELECT doc_id, page_no, ord, '{clause}' AS clause, value, {note} AS note FROM (SELECT *, list_aggregate(list_transform(regexp_extract_all(text, '(?i)Part\s*(?:-?\s*[0-9]+|1\s*&\s*2)[\s\S]*?[0-9.]+\s*(?:Lakh|Crore|Cr)'), lambda x: trim(x)), 'string_agg', '; ') AS value,
        (SELECT regexp_extract(b.text, '\b(1\.2|2\.1|2\.3|2\.2)\b', 1) FROM {{part_blocks}} b WHERE b.doc_id = t.doc_id AND b.page_no = t.page_no AND b.y2 < t.y1 AND regexp_matches(b.text, '\b(1\.2|2\.1|2\.3|2\.2)\b') ORDER BY b.y2 DESC, b.ord LIMIT 1) AS above
        FROM (SELECT r.doc_id, r.page_no, r.ord, r.y1, r.y2, string_agg(trim(b.text, ' '), ' ' ORDER BY round_even(b.y1 / 10, 0), b.x1, b.ord) AS text FROM {{part_tables}} r JOIN {{part_blocks}} b ON b.doc_id = r.doc_id AND b.page_no = r.page_no
            WHERE (b.x1 + b.x2 BETWEEN 2 * r.x1 AND 2 * r.x2 AND b.y1 + b.y2 BETWEEN 2 * r.y1 AND 2 * r.y2) OR 2 * {SHARED} >= (b.x2 - b.x1) * (b.y2 - b.y1) GROUP BY 1, 2, 3, 4, 5) t) z
        WHERE value <> '' AND (above = '{clause}' OR (above IS NULL AND {" AND ".join(f"contains(lower(text), '{w}')" for w in words)}))"""


_EXECUTED, _WORKING = ("1.2", ("executed", "value"), False), ("2.3", ("working", "capital"), True)


@query("x17_part_amounts", _parts(*_EXECUTED) + " UNION ALL " + _parts(*_WORKING))
def _(get):
    return C.clause_part_amounts(get("part_blocks"), get("part_tables"), [_EXECUTED, _WORKING])


@query("e4_keyword_udtf", "SELECT doc_id, strpos(text, 'BOQ') AS place, substr(text, strpos(text, 'BOQ') + 3, 5) AS \"right\" FROM {clause_docs}")
def _(get):
    return C.keyword_udtf(get("clause_docs"), "BOQ", 5)


_FOLD = "l AS (SELECT doc_id, page_no, ord, y1, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y1, ord) AS k FROM {blocks})"


@query("e4_line_cluster", f"""WITH RECURSIVE {_FOLD}, f AS (SELECT doc_id, page_no, ord, k, y1 AS total, CAST(1 AS BIGINT) AS n, 1 AS line FROM l WHERE k = 1
    UNION ALL SELECT l.doc_id, l.page_no, l.ord, l.k, CASE WHEN abs(l.y1 * f.n - f.total) > 12 * f.n THEN l.y1 ELSE f.total + l.y1 END, CASE WHEN abs(l.y1 * f.n - f.total) > 12 * f.n THEN 1 ELSE f.n + 1 END, CASE WHEN abs(l.y1 * f.n - f.total) > 12 * f.n THEN f.line + 1 ELSE f.line END FROM f JOIN l ON l.doc_id = f.doc_id AND l.page_no = f.page_no AND l.k = f.k + 1)
    SELECT doc_id, page_no, ord, line FROM f""")
def _(get):
    return C.line_udtf(get("blocks"))
