"""Queries over fields, occurrences and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import resolve as R
from docfields.operators import status as St
from docfields.plans.fixtures import LABELS
from docfields.plans.registry import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles

MONEY_SQL = """CASE WHEN {c} IS NULL OR trim({c}) IN ('','NA','Not Found','None','Out of Scope (Stage 1)') THEN NULL ELSE
    CAST(TRY_CAST(nullif(regexp_extract({c}, '([0-9]+(\\.[0-9]+)?)', 1), '') AS DECIMAL(28,4)) *
    CASE WHEN lower({c}) LIKE '%crore%' THEN 10000000 WHEN lower({c}) LIKE '%lakh%' THEN 100000 ELSE 1 END AS DECIMAL(18,2)) END"""


def money(c: str) -> str:
    return MONEY_SQL.replace("{c}", c)


def missing(c: str, *more: str) -> str:
    spelled = ", ".join(f"'{x}'" for x in ("", "NA", "Not Found", "None", "Out of Scope (Stage 1)", *more))
    return f"({c} IS NULL OR trim({c}) IN ({spelled}))"


MERGE = ("0", "0.0", "0.00")
ZONE = "CASE WHEN page <= 2 THEN 'COVER' WHEN page >= greatest(3, total_pages - 2) THEN 'END' ELSE 'BODY' END"
SCORE = f"""CASE field_name WHEN 'tender_value' THEN CASE {ZONE} WHEN 'COVER' THEN 3 WHEN 'BODY' THEN 2 ELSE 1 END
    WHEN 'pbg_percentage' THEN CASE {ZONE} WHEN 'BODY' THEN 3 WHEN 'COVER' THEN 2 ELSE 1 END
    ELSE CASE {ZONE} WHEN 'END' THEN 3 WHEN 'BODY' THEN 2 ELSE 1 END END * conf_pct"""
RESOLVED = f"""
    SELECT b.tender_id, b.field_name, CASE WHEN t.vals > 1 AND t.most < 80 THEN NULL ELSE b.value_raw END AS value, b.page, b.score, t.vals > 1 AND t.most < 80 AS conflict
    FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, field_name ORDER BY score DESC, ord) AS rn FROM s) b
    JOIN (SELECT s.tender_id, s.field_name, count(DISTINCT lower(trim(s.value_raw))) AS vals, max(s.conf_pct) AS most
          FROM s JOIN (SELECT tender_id, field_name, max(score) AS top FROM s GROUP BY 1, 2) m ON s.tender_id = m.tender_id AND s.field_name = m.field_name AND s.score = m.top
          GROUP BY 1, 2) t ON b.tender_id = t.tender_id AND b.field_name = t.field_name
    WHERE b.rn = 1"""


@query("w1_resolve_best", f"WITH s AS (SELECT *, {SCORE} AS score FROM {{occurrences}} WHERE trim(value_raw) NOT IN ('', 'Not Found')) {RESOLVED}")
def _(get):
    return R.resolve_best(get("occurrences"))


@query("p4_page_zone", f"SELECT tender_id, ord, {ZONE} AS zone FROM {{occurrences}}")
def _(get):
    return get("occurrences").select("tender_id", "ord", R.page_zone(F.col("page"), F.col("total_pages")).alias("zone"))


@query("p5_is_missing", f"SELECT doc_id, ord, {missing('value')} AS missing_record, {missing('value', *MERGE)} AS missing_merge, (value IS NULL OR trim(value) IN ('', 'Not Found')) AS missing_basic FROM {{annexure_fields}}")
def _(get):
    return get("annexure_fields").select("doc_id", "ord", *[S.missing(F.col("value"), p).alias(f"missing_{p}") for p in ("record", "merge", "basic")])


@query("c1_parse_money", f"SELECT tender_id, ord, {money('value_raw')} AS amount FROM {{occurrences}} WHERE field_name = 'tender_value'")
def _(get):
    return get("occurrences").where("field_name = 'tender_value'").select("tender_id", "ord", S.parse_money(F.col("value_raw")).alias("amount"))


@query("c2_currency_text", f"SELECT tender_id, ord, CAST(CAST(floor({money('value_raw')}) AS BIGINT) AS VARCHAR) AS digits FROM {{occurrences}} WHERE field_name = 'tender_value'")
def _(get):
    return get("occurrences").where("field_name = 'tender_value'").select("tender_id", "ord", S.currency_text(F.col("value_raw")).alias("digits"))


@query("c3_order_value", f"SELECT tender_id, ord, CASE WHEN value_raw LIKE '%Lakh%' THEN CAST(floor({money('value_raw')}) AS BIGINT) END AS order_value FROM {{occurrences}}")
def _(get):
    return get("occurrences").select("tender_id", "ord", S.order_value(F.col("value_raw")).alias("order_value"))


@query("c5_parse_numbers", r"SELECT tender_id, ord, TRY_CAST(nullif(regexp_extract(value_raw, '([0-9]+)', 1), '') AS BIGINT) AS whole, CAST(TRY_CAST(nullif(regexp_extract(value_raw, '([0-9]+(\.[0-9]+)?)', 1), '') AS DECIMAL(28,4)) AS DECIMAL(18,2)) AS number FROM {occurrences}")
def _(get):
    return get("occurrences").select("tender_id", "ord", S.parse_int(F.col("value_raw")).alias("whole"), S.parse_decimal(F.col("value_raw")).alias("number"))


@query("c6_flags", f"SELECT doc_id, ord, CASE value WHEN '0' THEN false END AS yes, CASE WHEN {missing('value')} THEN 'No' ELSE 'Yes' END AS present FROM {{annexure_fields}}")
def _(get):
    return get("annexure_fields").select("doc_id", "ord", S.parse_bool(F.col("value")).alias("yes"), S.presence_flag(F.col("value")).alias("present"))


@query("c12_format_grouped", r"""
    SELECT tender_id, ord, CASE WHEN length(t) <= 3 THEN t WHEN length(t) <= 5 THEN substr(t, 1, length(t) - 3) || ',' || right(t, 3)
        WHEN length(t) <= 7 THEN substr(t, 1, length(t) - 5) || ',' || substr(t, length(t) - 4, 2) || ',' || right(t, 3)
        ELSE substr(t, 1, length(t) - 7) || ',' || substr(t, length(t) - 6, 2) || ',' || substr(t, length(t) - 4, 2) || ',' || right(t, 3) END AS grouped
    FROM (SELECT tender_id, ord, CAST(conf_pct * conf_pct * tender_id % 1000000000 AS VARCHAR) AS t FROM {occurrences})""")
def _(get):
    return get("occurrences").select("tender_id", "ord", S.format_grouped(F.expr("conf_pct * conf_pct * tender_id % 1000000000")).alias("grouped"))


@query("c13_format_values", "SELECT tender_id, ord, CAST(conf_pct AS VARCHAR) || '%' AS pct, CAST(conf_pct AS VARCHAR) || '.00' AS amount, CAST(conf_pct AS VARCHAR) AS whole FROM {occurrences}")
def _(get):
    c = F.col("conf_pct")
    return get("occurrences").select("tender_id", "ord", S.format_value(c, "pct").alias("pct"), S.format_value(c, "decimal").alias("amount"), S.format_value(c, "int").alias("whole"))


@query("c18_canonical_key", "SELECT DISTINCT field_name, trim(regexp_replace(lower(field_name), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM {annexure_fields}")
def _(get):
    return get("annexure_fields").select("field_name", S.canonical_key(F.col("field_name")).alias("key")).distinct()


@query("n1_normalize_fields", rf"""
    SELECT tender_id, ord, CASE field_name WHEN 'tender_value' THEN {money('value_raw')} WHEN 'pbg_percentage' THEN CAST(TRY_CAST(nullif(regexp_extract(value_raw, '([0-9]+(\.[0-9]+)?)', 1), '') AS DECIMAL(28,4)) AS DECIMAL(18,2)) END AS value_num,
        CASE field_name WHEN 'courier_address' THEN NOT {missing('value_raw')} ELSE regexp_matches(value_raw, '[0-9]') END AS parse_ok
    FROM {{occurrences}}""")
def _(get):
    occurrences = get("occurrences")
    rules = occurrences.sparkSession.createDataFrame([("tender_value", "money"), ("pbg_percentage", "decimal"), ("courier_address", "raw")], "field_name string, type string")
    return R.normalize_fields(occurrences, rules).select("tender_id", "ord", "value_num", "parse_ok")


@query("p12_plausible", f"SELECT tender_id, ord, CASE field_name WHEN 'tender_value' THEN coalesce({money('value_raw')} BETWEEN 100 AND 500000000, false) WHEN 'pbg_percentage' THEN TRY_CAST(replace(value_raw, '%', '') AS DECIMAL(18,2)) BETWEEN 0 AND 100 ELSE true END AS plausible FROM {{occurrences}}")
def _(get):
    bounds = [("tender_value", 100, 500_000_000), ("pbg_percentage", 0, 100)]
    occurrences = get("occurrences")
    rules = occurrences.sparkSession.createDataFrame(bounds, "field_name string, low long, high long")
    value = S.parse_money(F.col("value_raw"))
    ok = F.when(F.col("low").isNull(), True).otherwise(F.coalesce(value.between(F.col("low"), F.col("high")), F.lit(False)))
    return occurrences.join(rules, "field_name", "left").select("tender_id", "ord", ok.alias("plausible"))


@query("p7_validate", r"SELECT tender_id, ord, CASE WHEN ok THEN value_raw END AS value, NOT ok AS needs_review FROM (SELECT *, CASE field_name WHEN 'tender_value' THEN regexp_matches(value_raw, '^[0-9]+$') WHEN 'pbg_percentage' THEN regexp_matches(value_raw, '^[0-9]+(\.[0-9]+)?%$') ELSE true END AS ok FROM {occurrences})")
def _(get):
    occurrences = get("occurrences")
    rules = occurrences.sparkSession.createDataFrame([("tender_value", r"^\d+$"), ("pbg_percentage", r"^\d+(\.\d+)?%$")], "field_name string, pattern string")
    ok = F.coalesce(F.regexp_like("value_raw", F.col("pattern")), F.lit(True))
    return occurrences.join(rules, "field_name", "left").select("tender_id", "ord", F.when(ok, F.col("value_raw")).alias("value"), (~ok).alias("needs_review"))


@query("p14_lift_top_level", "SELECT doc_id, max(CASE field_name WHEN 'Bid Validity (Days)' THEN value END) AS bid_validity, max(CASE field_name WHEN 'Payment Terms' THEN value END) AS payment_terms FROM {main_fields} WHERE value <> 'Not Found' AND field_name IN ('Bid Validity (Days)', 'Payment Terms') GROUP BY doc_id")
def _(get):
    labels = F.create_map(F.lit("Bid Validity (Days)"), F.lit("bid_validity"), F.lit("Payment Terms"), F.lit("payment_terms"))
    known = get("main_fields").withColumn("key", F.try_element_at(labels, F.col("field_name"))).where(F.col("key").isNotNull() & ~S.missing(F.col("value")))
    return known.groupBy("doc_id").pivot("key", ["bid_validity", "payment_terms"]).agg(F.max_by("value", "ord"))


_LABELS = [*R.RENAMES, "Warranty", "tender value"]
_TAGS = ["gem_parent_pdf", "atc", "derived", "ambiguous_preserved", "main_tender", "unheard of", "not_available_stage1"]


def _in(table: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in table.items())


def _pick(values: list[str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


@query("p15_canonical_label", f"SELECT doc_id, ord, {_in(R.RENAMES, 'trim(raw)')} ELSE raw END AS label, CASE WHEN tag = 'atc' OR tag = 'derived' OR tag = 'ambiguous_preserved' THEN tag ELSE 'main_tender' END AS source FROM (SELECT doc_id, ord, {_pick(_LABELS, f'(doc_id * 4 + ord) % {len(_LABELS)}')} AS raw, {_pick(_TAGS, 'source_page % 7')} AS tag FROM {{main_fields}})")
def _(get):
    raw = F.element_at(F.array(*map(F.lit, _LABELS)), ((F.col("doc_id") * 4 + F.col("ord")) % len(_LABELS) + 1).cast("int"))
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("source_page") % 7 + 1).cast("int"))
    return get("main_fields").select("doc_id", "ord", R.canonical_label(raw).alias("label"), R.canonical_source(tag).alias("source"))


@query("j2_lookup_fields", "SELECT doc_id, CASE field_name WHEN 'Payment Terms' THEN 'terms' ELSE 'validity' END AS request, value FROM {main_fields} WHERE field_name IN ('Payment Terms', 'Bid Validity (Days)')")
def _(get):
    fields = get("main_fields")
    keys = fields.sparkSession.createDataFrame([("terms", "terms of payment", 0), ("terms", "payment terms", 1), ("validity", "bid validity (days)", 0), ("validity", "contract period", 1)], "request string, key string, key_ord int")
    return R.lookup(fields, keys)


_SIDES = f"""s AS (SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, coalesce(m.field_name, a.field_name) AS field_name, m.value AS m, a.value AS a, m.conf_pct AS mc, a.conf_pct AS ac, m.doc_id IS NOT NULL AS in_main,
    CASE coalesce(m.field_name, a.field_name) WHEN 'Bid Validity (Days)' THEN 'main' WHEN 'Payment Terms' THEN 'annexure' WHEN 'Custom Rules' THEN 'both' ELSE 'fill' END AS policy,
    NOT {missing('m.value', *MERGE)} AS mv, NOT {missing('a.value', *MERGE)} AS av
    FROM {{main_fields}} m FULL JOIN {{annexure_fields}} a ON m.doc_id = a.doc_id AND m.field_name = a.field_name)"""


@query("j13_merge_by_name", f"WITH {_SIDES}, t AS (SELECT *, CASE WHEN policy = 'main' AND mv THEN 'main_tender' WHEN policy = 'both' AND mv AND av THEN 'ambiguous_preserved' WHEN av THEN 'atc' ELSE 'main_tender' END AS source FROM s) SELECT doc_id, field_name, CASE source WHEN 'atc' THEN a WHEN 'ambiguous_preserved' THEN m || ' | ' || a ELSE m END AS value, CASE source WHEN 'atc' THEN ac WHEN 'ambiguous_preserved' THEN least(mc, ac) ELSE mc END AS conf_pct, source FROM t")
def _(get):
    return R.merge_by_name(get("main_fields"), get("annexure_fields"))


@query("j14_merge_by_label", f"WITH {_SIDES}, t AS (SELECT *, CASE WHEN NOT av THEN 'no_annexure_value' WHEN NOT in_main THEN 'new_label' WHEN policy = 'main' THEN 'main_locked' WHEN policy = 'both' AND mv THEN 'both_kept' WHEN policy = 'annexure' THEN 'annexure_owned' WHEN NOT mv THEN 'filled' ELSE 'main_kept' END AS reason FROM s) SELECT doc_id, field_name, CASE WHEN reason IN ('new_label', 'annexure_owned', 'filled') THEN a WHEN reason = 'both_kept' THEN m || ' | ' || a ELSE m END AS value, reason FROM t")
def _(get):
    return R.merge_by_label(get("main_fields"), get("annexure_fields"))


@query("w2_best_candidate", "SELECT tender_id, field_name, ord, value_raw, valid FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, field_name ORDER BY valid DESC, conf_pct DESC, ord) AS rn FROM (SELECT *, regexp_matches(value_raw, '[0-9]') AS valid FROM {occurrences})) WHERE rn = 1")
def _(get):
    return R.best_candidate(get("occurrences"), ("tender_id", "field_name"), F.col("value_raw").rlike("[0-9]")).select("tender_id", "field_name", "ord", "value_raw", "valid")


@query("w3_dedupe_by_label", f"SELECT doc_id, field_name, value, conf_pct, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY CASE WHEN {missing('value')} THEN 1 ELSE 0 END, conf_pct DESC, ord) AS rn FROM (SELECT doc_id, field_name, value, conf_pct, ord, 'main' AS source FROM {{main_fields}} UNION ALL SELECT doc_id, field_name, value, conf_pct, ord + 10, 'annexure' FROM {{annexure_fields}})) WHERE rn = 1")
def _(get):
    columns = ["doc_id", "field_name", "value", "conf_pct"]
    both = get("main_fields").select(*columns, "ord", F.lit("main").alias("source")).unionByName(get("annexure_fields").select(*columns, (F.col("ord") + 10).alias("ord"), F.lit("annexure").alias("source")))
    return R.dedupe_by_label(both, ("doc_id", "field_name")).select(*columns, "source")


@query("a5_coverage_confidence", "SELECT tender_id, count(CASE WHEN trim(value_raw) NOT IN ('', 'Not Found') THEN 1 END) AS found, count(*) AS total, CAST(floor(coalesce(sum(CASE WHEN trim(value_raw) NOT IN ('', 'Not Found') THEN conf_pct END), 0) * 10000 / count(*)) AS BIGINT) AS coverage FROM {occurrences} GROUP BY tender_id")
def _(get):
    return St.coverage_confidence(get("occurrences"))


@query("a6_weighted_confidence", "SELECT tender_id, CAST(least(1000, floor(coalesce(sum(conf_pct) * 6 / count(*), 300) + count(CASE WHEN value_raw <> 'Not Found' THEN 1 END) * 400 / count(*))) AS BIGINT) AS weighted FROM {occurrences} GROUP BY tender_id")
def _(get):
    hits = F.count_if(F.col("value_raw") != "Not Found")
    score = F.coalesce(F.sum("conf_pct") * 6 / F.count("*"), F.lit(300)) + hits * 400 / F.count("*")
    return get("occurrences").groupBy("tender_id").agg(F.least(F.lit(1000), F.floor(score)).cast("long").alias("weighted"))


@query("a9_sum_by_schedule", f"SELECT tender_id, schedule_number, sum({money('value_raw')}) AS amount, grouping(schedule_number) AS total_row FROM {{occurrences}} WHERE field_name = 'tender_value' GROUP BY GROUPING SETS ((tender_id, schedule_number), (tender_id))")
def _(get):
    amounts = get("occurrences").where("field_name = 'tender_value'").select("tender_id", "schedule_number", S.parse_money(F.col("value_raw")).alias("amount"))
    return amounts.groupingSets([["tender_id", "schedule_number"], ["tender_id"]], "tender_id", "schedule_number").agg(F.sum("amount").alias("amount"), F.grouping("schedule_number").alias("total_row"))


@query("a10_reconcile_total", "SELECT o_orderkey AS doc_id, total, parts, total - parts AS shortfall FROM (SELECT o_orderkey, p + o_custkey % 2 AS total, p AS parts FROM {orders} JOIN (SELECT l_orderkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS p FROM {lineitem} GROUP BY 1) ON o_orderkey = l_orderkey) WHERE total <> parts")
def _(get):
    parts = get("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.floor("l_quantity").cast("long").alias("part"))
    sums = parts.groupBy("doc_id").agg(F.sum("part").alias("p"))
    headers = get("orders").join(sums, F.col("o_orderkey") == F.col("doc_id")).select("doc_id", (F.col("p") + F.col("o_custkey") % 2).alias("total"))
    return R.reconcile_total(parts, headers)


@query("a11_evidence_summary", "SELECT tender_id, string_agg(field_name || ':p' || CAST(page AS VARCHAR), '|' ORDER BY ord) AS evidence FROM {occurrences} GROUP BY tender_id")
def _(get):
    return R.evidence_summary(get("occurrences"), "tender_id")


_STATUS = f"""st AS (SELECT d.doc_id, e.field_name, f.value, CASE WHEN e.field_name = 'Custom Rules' AND d.doc_id % 2 = 0 THEN 'NOT_APPLICABLE' WHEN {missing('f.value')} THEN 'MISSING' WHEN f.conf_pct < 80 THEN 'OK_FALLBACK' ELSE 'OK' END AS status
    FROM (SELECT o_orderkey AS doc_id FROM {{orders}}) d CROSS JOIN {{labels4}} e LEFT JOIN {{main_fields}} f ON f.doc_id = d.doc_id AND f.field_name = e.field_name)"""


def _statuses(get):
    values = get("main_fields").withColumn("source", F.when(F.col("conf_pct") < 80, "fallback").otherwise("rule")).select("doc_id", "field_name", "value", "source")
    rule = (F.col("field_name") == "Custom Rules") & (F.col("doc_id") % 2 == 0)
    return St.classify_status(values, get("orders").select(F.col("o_orderkey").alias("doc_id")), LABELS, rule)


@query("r1_classify_status", f"WITH {_STATUS} SELECT doc_id, field_name, value, status FROM st")
def _(get):
    return _statuses(get)


@query("a7_status_rollup", f"WITH {_STATUS} SELECT doc_id, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'OK_FALLBACK') AS ok_fallback, count(*) FILTER (status = 'NOT_APPLICABLE') AS not_applicable, count(*) FILTER (status = 'MISSING') AS missing, coalesce(string_agg(field_name, ', ' ORDER BY field_name) FILTER (status = 'MISSING'), '') AS missing_fields FROM st GROUP BY doc_id")
def _(get):
    return St.status_rollup(_statuses(get))


@query("a15_batch_audit", f"WITH {_STATUS}, d AS (SELECT doc_id, count(*) FILTER (status = 'MISSING') AS m, count(*) FILTER (status = 'OK_FALLBACK') AS f FROM st GROUP BY 1) SELECT count(*) AS documents, count(*) FILTER (m = 0 AND f = 0) AS clean, count(*) FILTER (m > 0) AS any_missing, count(*) FILTER (f > 0) AS any_fallback FROM d")
def _(get):
    return St.batch_audit(_statuses(get))


@query("a8_issue_count", f"SELECT doc_id, count(*) FILTER (((ord % 2 = 0) AND {missing('value')}) OR (NOT {missing('value')} AND conf_pct < 70)) AS issues FROM {{main_fields}} GROUP BY doc_id")
def _(get):
    return St.issue_count(get("main_fields").withColumn("critical", F.col("ord") % 2 == 0))


@query("r2_derive_flags", f"SELECT tender_id, ord, CASE WHEN {money('value_raw')} > 0 THEN 'Yes' WHEN {missing('value_raw')} THEN 'No' ELSE 'Yes' END AS required FROM {{occurrences}} WHERE field_name <> 'courier_address'")
def _(get):
    raw = F.col("value_raw")
    return get("occurrences").where("field_name <> 'courier_address'").select("tender_id", "ord", F.when(S.parse_money(raw) > 0, "Yes").otherwise(S.presence_flag(raw)).alias("required"))


_NAMES = LABELS


@query("r3_to_wide", "SELECT doc_id, " + ", ".join(f"min(CASE WHEN field_name = '{n}' THEN value END) AS \"{n}\"" for n in _NAMES) + " FROM {main_fields} GROUP BY doc_id")
def _(get):
    return St.to_wide(get("main_fields"), "doc_id", _NAMES)


@query("r4_sync_back", "SELECT coalesce(m.doc_id, w.doc_id) AS doc_id, coalesce(m.field_name, w.field_name) AS field_name, CASE WHEN coalesce(m.status, '') = 'verified' OR w.value IS NULL THEN m.value ELSE w.value END AS value, CASE WHEN coalesce(m.status, '') = 'verified' OR w.value IS NULL THEN m.status WHEN w.value IN ('N/A', 'NA') THEN 'NOT_APPLICABLE' WHEN m.status IS NULL THEN 'added' ELSE 'synced' END AS status FROM (SELECT doc_id, field_name, value, CASE WHEN source_page % 2 = 0 THEN 'verified' ELSE 'extracted' END AS status FROM {main_fields}) m FULL JOIN (SELECT doc_id, field_name, value FROM {annexure_fields}) w ON m.doc_id = w.doc_id AND m.field_name = w.field_name")
def _(get):
    rows = get("main_fields").select("doc_id", "field_name", "value", F.when(F.col("source_page") % 2 == 0, "verified").otherwise("extracted").alias("status"))
    return St.sync_back(St.to_wide(get("annexure_fields"), "doc_id", _NAMES), rows, _NAMES)


@query("r5_attach_provenance", "SELECT doc_id, field_name, min(source_page) AS page, arg_min(src, pr) AS source FROM (SELECT doc_id, field_name, source_page, 'main' AS src, 0 AS pr FROM {main_fields} UNION ALL SELECT doc_id, field_name, source_page, 'annexure', 1 FROM {annexure_fields}) GROUP BY 1, 2")
def _(get):
    columns = ["doc_id", "field_name", "source_page"]
    both = get("main_fields").select(*columns, F.lit("main").alias("src"), F.lit(0).alias("pr")).unionByName(get("annexure_fields").select(*columns, F.lit("annexure").alias("src"), F.lit(1).alias("pr")))
    return both.groupBy("doc_id", "field_name").agg(F.min("source_page").alias("page"), F.min_by("src", "pr").alias("source"))


@query("r7_flat_sheet", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS number, field_name, value, CASE WHEN conf_pct >= 80 THEN 'rule' ELSE 'fallback' END AS source FROM {main_fields}")
def _(get):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return get("main_fields").select("doc_id", number.alias("number"), "field_name", "value", F.when(F.col("conf_pct") >= 80, "rule").otherwise("fallback").alias("source"))


@query("r10_missing_for_model", f"SELECT m.doc_id, m.field_name FROM {{main_fields}} m WHERE {missing('m.value')} AND m.doc_id IN (SELECT l_orderkey FROM {{lineitem}} WHERE l_returnflag = 'A')")
def _(get):
    text = get("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("doc_id"))
    return get("main_fields").where(S.missing(F.col("value"))).join(text, "doc_id", "left_semi").select("doc_id", "field_name")


@query("r11_merge_predictions", f"SELECT m.doc_id, m.field_name, CASE WHEN {missing('m.value')} AND NOT {missing('a.value', *MERGE)} THEN a.value ELSE m.value END AS value, CASE WHEN NOT {missing('m.value')} THEN 'OK' WHEN NOT {missing('a.value', *MERGE)} THEN 'OK_FALLBACK' ELSE 'MISSING' END AS status FROM {{main_fields}} m LEFT JOIN {{annexure_fields}} a ON m.doc_id = a.doc_id AND m.field_name = a.field_name")
def _(get):
    predicted = get("annexure_fields").select("doc_id", "field_name", F.col("value").alias("p"))
    joined = get("main_fields").join(predicted, ["doc_id", "field_name"], "left")
    own, new = ~S.missing(F.col("value")), ~S.missing(F.col("p"), "merge")
    return joined.select("doc_id", "field_name", F.when(~own & new, F.col("p")).otherwise(F.col("value")).alias("value"), F.when(own, "OK").when(new, "OK_FALLBACK").otherwise("MISSING").alias("status"))


@query("u2_schema_difference", "SELECT d.doc_id, e.field_name, coalesce(f.value, '') AS value, f.doc_id IS NULL AS added FROM (SELECT DISTINCT doc_id FROM {main_fields}) d CROSS JOIN (SELECT field_name FROM {labels4} WHERE k < 3 UNION ALL SELECT 'Warranty') e LEFT JOIN {main_fields} f ON f.doc_id = d.doc_id AND f.field_name = e.field_name")
def _(get):
    fields = get("main_fields")
    grid = St.every(fields.select("doc_id").distinct(), [*LABELS[:3], "Warranty"])
    joined = grid.join(fields.select("doc_id", "field_name", "value", F.lit(False).alias("absent")), ["doc_id", "field_name"], "left")
    return joined.select("doc_id", "field_name", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("absent", F.lit(True)).alias("added"))


@query("u3_out_of_scope", "SELECT d.o_orderkey AS doc_id, e.field_name, 'Out of Scope (Stage 1)' AS value, 'annexure' AS likely_source FROM {orders} d CROSS JOIN {labels4} e WHERE NOT EXISTS (SELECT 1 FROM {main_fields} f WHERE f.doc_id = d.o_orderkey AND f.field_name = e.field_name)")
def _(get):
    grid = St.every(get("orders").select(F.col("o_orderkey").alias("doc_id")), LABELS)
    return grid.join(get("main_fields").select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti").select("doc_id", "field_name", F.lit("Out of Scope (Stage 1)").alias("value"), F.lit("annexure").alias("likely_source"))


@query("s9_upsert", "SELECT coalesce(t.o_orderkey, u.k) AS o_orderkey, CASE WHEN u.k IS NOT NULL THEN u.s ELSE t.o_orderstatus END AS o_orderstatus, t.o_custkey AS o_custkey, u.k IS NOT NULL AS updated FROM {orders} t FULL JOIN (SELECT o_orderkey + 5 AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'U' END AS s FROM {orders} WHERE o_orderkey % 2 = 0) u ON t.o_orderkey = u.k")
def _(get):
    orders = get("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    updates = get("orders").where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 5).alias("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.lit("U")).alias("o_orderstatus"))
    return St.upsert(orders, updates, "o_orderkey", ["o_orderstatus"])


@query("s10_update_columns", "SELECT t.o_orderkey, CASE WHEN t.o_orderkey % 2 = 0 THEN 'high' ELSE t.o_orderpriority END AS o_orderpriority, t.o_orderstatus AS o_orderstatus, t.o_orderkey % 2 = 0 AS updated FROM {orders} t")
def _(get):
    orders = get("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    updates = get("orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("high").alias("o_orderpriority"))
    return St.upsert(orders, updates, "o_orderkey", ["o_orderpriority"])


@query("s5_summary_rows", "SELECT doc_id, coalesce(string_agg(CASE WHEN value <> 'Not Found' THEN value END, '|' ORDER BY ord), '') AS values_list, count(*) AS n FROM {main_fields} GROUP BY doc_id")
def _(get):
    listed = F.sort_array(F.collect_list(F.struct("ord", "value")))
    kept = F.filter(F.transform(listed, lambda x: x["value"]), lambda v: v != "Not Found")
    return get("main_fields").groupBy("doc_id").agg(F.array_join(kept, "|").alias("values_list"), F.count("*").alias("n"))


@query("s6_evidence_rows", f"SELECT tender_id, field_name, value_raw AS value, page, {ZONE} AS zone, conf_pct, {SCORE} AS score, ord FROM {{occurrences}}")
def _(get):
    score = R.zone_score(F.col("field_name"), F.col("page"), F.col("total_pages"), F.col("conf_pct"))
    return get("occurrences").select("tender_id", "field_name", F.col("value_raw").alias("value"), "page", R.page_zone(F.col("page"), F.col("total_pages")).alias("zone"), "conf_pct", score.alias("score"), "ord")
