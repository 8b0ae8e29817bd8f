"""Queries over page and clause texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import extract as X
from docfields.operators import rules as Ru
from docfields.operators import status as St
from docfields.plans.fixtures import LABELS
from docfields.plans.registry import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles

WORDS = "CASE w WHEN 'seven' THEN 7 WHEN 'five' THEN 5 ELSE TRY_CAST(w AS BIGINT) END"


def found(pattern: str, group: int = 1, c: str = "text") -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


def days(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '([0-9]+) (day|week|month)', 1) AS BIGINT) * CASE regexp_extract({c}, '([0-9]+) (day|week|month)', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 ELSE 30 END"


MODE = found("Mode: ([^\\n]*)")
CODES = f"concat_ws(',', CASE WHEN regexp_matches(lower(m), 'neft|rtgs|bank transfer|online') THEN 'BT' END, CASE WHEN lower(m) LIKE '%demand draft%' THEN 'DD' END, CASE WHEN lower(m) LIKE '%surety bond%' THEN 'SB' END, CASE WHEN lower(m) LIKE '%fdr%' OR lower(m) LIKE '%fixed deposit%' THEN 'FDR' END, CASE WHEN lower(m) LIKE '%bank guarantee%' AND NOT regexp_matches(lower(m), 'neft|rtgs|bank transfer|online') THEN 'BG' END)"


@query("p1_text_quality", r"SELECT doc_id, CAST(floor(length(regexp_replace(text, '[^\p{L}\p{N} \n\r\t]', '', 'g')) * 1000 / greatest(length(text), 1)) AS BIGINT) AS ratio, text IS NULL OR text = '' OR CAST(floor(length(regexp_replace(text, '[^\p{L}\p{N} \n\r\t]', '', 'g')) * 1000 / greatest(length(text), 1)) AS BIGINT) < 600 AS garbage FROM {documents}")
def _(get):
    ratio = S.quality_ratio(F.col("text"))
    return get("documents").select("doc_id", ratio.alias("ratio"), (F.col("text").isNull() | (F.col("text") == "") | (F.size(F.split("text", r"\(cid:")) > 4) | (ratio < 600)).alias("garbage"))


@query("p2_classify_doc_type", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'explicit' WHEN max(CASE WHEN page = 1 AND (text LIKE '%?%' OR regexp_matches(text, '[0-9]{3}')) THEN 1 ELSE 0 END) = 1 THEN 'structured' ELSE 'generic' END AS doc_type FROM {threads} GROUP BY doc_id")
def _(get):
    sniffed = F.bool_or((F.col("page") == 1) & (F.contains("text", F.lit("?")) | F.col("text").rlike("[0-9]{3}")))
    explicit = F.when(F.col("doc_id") % 10 == 0, "explicit")
    return get("threads").groupBy("doc_id").agg(sniffed.alias("s")).select("doc_id", F.coalesce(explicit, F.when(F.col("s"), "structured").otherwise("generic")).alias("doc_type"))


@query("p3_classify_by_keywords", "SELECT doc_id, CASE WHEN text LIKE '%installation%' AND text LIKE '%NEFT%' THEN 'SITC' WHEN text LIKE '%Demand Draft%' THEN 'Goods' WHEN text LIKE '%surety%' THEN 'Service' ELSE 'Unknown' END AS kind FROM {clause_docs}")
def _(get):
    rules = (("SITC", ("installation", "NEFT")), ("Goods", ("Demand Draft",)), ("Service", ("surety",)))
    return get("clause_docs").select("doc_id", Ru.first_class(F.col("text"), rules, "Unknown").alias("kind"))


def _amount(value: str) -> str:
    return f"CASE WHEN regexp_matches(t, '{Ru.MONEY_SIGNS}') OR TRY_CAST(regexp_replace({value}, '[^0-9.]', '', 'g') AS DOUBLE) >= 100 THEN {value} END"


TYPED = {k: found(p, 0, "t") for k, p in Ru.TYPES.items()} | {
    "percentage": f"CASE WHEN TRY_CAST(regexp_replace({found(Ru.TYPES['percentage'], 0, 't')}, '[^0-9.]', '', 'g') AS DOUBLE) <= 100 THEN {found(Ru.TYPES['percentage'], 0, 't')} END",
    "currency": _amount(f"coalesce({found(Ru.MONEY, 0, 't')}, {found(Ru.NUMBER, 0, 't')})"),
    "fee": f"CASE WHEN regexp_matches(t, '{Ru.NO_FEE}') THEN 'Nil / Exempted' ELSE {_amount(found(Ru.MONEY, 0, 't'))} END",
    "nit": f"coalesce({found(Ru.NIT, 1, 't')}, {found(Ru.NIT, 0, 't')})",
    "org": f"CASE WHEN length(t) > 3 AND length(t) < 150 AND NOT regexp_matches(t, '{Ru.NOT_TEXT}') THEN t END",
    "text": f"CASE WHEN length(t) > 2 AND length(t) < 150 AND NOT regexp_matches(t, '{Ru.NOT_TEXT}') THEN t END",
}


@query("p6_match_typed", "SELECT doc_id, page_no, ord, " + ", ".join(f'{TYPED[k]} AS "{k}_"' for k in Ru.KINDS) + " FROM (SELECT *, trim(text) AS t FROM {tender_lines})")
def _(get):
    return get("tender_lines").select("doc_id", "page_no", "ord", *[Ru.typed(F.col("text"), k).alias(f"{k}_") for k in Ru.KINDS])


@query("p8_paragraph_filter", "SELECT doc_id, page, length(text) > 100 OR regexp_matches(text, '[.] (the|and|of|to) ') AS paragraph FROM {threads}")
def _(get):
    return get("threads").select("doc_id", "page", Ru.looks_like_paragraph(F.col("text")).alias("paragraph"))


@query("p9_anchor_match", "SELECT doc_id, regexp_matches(t, '(^| )total( [^ ]+)? quantity( |$)') AS total_quantity, regexp_matches(t, '(^| )delivery( [^ ]+)? period( |$)') AS delivery_period, regexp_matches(t, '(^| )past( [^ ]+)? years( |$)') AS past_years FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[/\\\\_.:\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {clause_docs})")
def _(get):
    text = S.match_normalize(F.col("text"))
    return get("clause_docs").select("doc_id", *[text.rlike(Ru.anchor_pattern(a)).alias(a.replace(" ", "_")) for a in ("total quantity", "delivery period", "past years")])


@query("p13_reject_terms", "SELECT doc_id, mode FROM (SELECT doc_id, nullif(regexp_extract(text, 'Mode: ([^\\n]*)', 1), '') AS mode FROM {clause_docs}) WHERE lower(mode) NOT LIKE '%cash%' AND lower(mode) NOT LIKE '%surety%'")
def _(get):
    docs = get("clause_docs").select("doc_id", F.nullif(F.regexp_extract("text", r"Mode: ([^\n]*)", 1), F.lit("")).alias("mode"))
    return Ru.reject_terms(docs, "mode", ("cash", "surety"), 100)


@query("j12_fuzzy_label_join", r"""WITH l AS (SELECT doc_id, CAST(k AS INTEGER) AS line_no, trim(regexp_replace(lower(line), '[\x{0900}-\x{097F}]+', ' ', 'g'), ' ') AS t FROM (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {clause_docs}))),
    a AS (SELECT field_name, lower(field_name) AS anchor, length(field_name) AS n FROM (SELECT field_name FROM {labels4} UNION ALL SELECT unnest(['Total Quantities', 'Delivery Peroid', 'Refer Anexure']))),
    s AS (SELECT doc_id, line_no, field_name, CAST(floor(100 - 100 * list_min(list_transform(range(1, greatest(1, length(t) - n + 1) + 1), lambda k: levenshtein(substr(t, k, n), anchor))) / n) AS BIGINT) AS score FROM l CROSS JOIN a)
    SELECT doc_id, line_no, field_name, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, field_name) AS rn FROM s WHERE score >= 80) WHERE rn = 1""")
def _(get):
    labels = get("labels4").select("field_name")
    labels = labels.unionByName(labels.sparkSession.createDataFrame([("Total Quantities",), ("Delivery Peroid",), ("Refer Anexure",)], "field_name string"))
    return Ru.fuzzy_labels(get("clause_docs"), labels)


@query("j19_deferral", "SELECT doc_id, CASE WHEN d <> '' THEN 'REFER_TO_' || d END AS target, CASE WHEN d <> '' THEN w ELSE r END AS value FROM (SELECT doc_id, regexp_extract(text, 'PRICE REDUCTION SCHEDULE as per (SECTION-[IVX]+)', 1) AS d, nullif(regexp_extract(text, 'PRICE REDUCTION SCHEDULE ([0-9/.]+%)', 1), '') AS r, nullif(regexp_extract(text, 'experience in past ([a-z0-9]+ years)', 1), '') AS w FROM {clause_docs})")
def _(get):
    text = F.col("text")
    target = F.nullif(F.regexp_extract(text, r"PRICE REDUCTION SCHEDULE as per (SECTION-[IVX]+)", 1), F.lit(""))
    clauses = get("clause_docs").select("doc_id", F.concat(F.lit("REFER_TO_"), target).alias("target"), F.nullif(F.regexp_extract(text, r"PRICE REDUCTION SCHEDULE ([0-9/.]+%)", 1), F.lit("")).alias("own"))
    sections = get("clause_docs").select("doc_id", F.lit("REFER_TO_SECTION-III").alias("target"), F.nullif(F.regexp_extract(text, r"experience in past ([a-z0-9]+ years)", 1), F.lit("")).alias("other"))
    return clauses.join(sections, ["doc_id", "target"], "left").select("doc_id", "target", F.coalesce("own", "other").alias("value"))


@query("c8_normalize_text", r"SELECT doc_id, page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM {threads}")
def _(get):
    return get("threads").select("doc_id", "page", S.normalize_text(F.col("text")).alias("clean"))


@query("c9_split_modes", f"SELECT doc_id, CASE WHEN k = '' THEN m ELSE k END AS modes FROM (SELECT doc_id, m, concat_ws('|', CASE WHEN m LIKE '%Demand Draft%' THEN 'DD' END, CASE WHEN m LIKE '%Bank Guarantee%' THEN 'BG' END, CASE WHEN m LIKE '%FDR%' THEN 'FDR' END, CASE WHEN m LIKE '%NEFT%' THEN 'NEFT' END, CASE WHEN m LIKE '%surety bond%' THEN 'SB' END) AS k FROM (SELECT doc_id, {MODE} AS m FROM {{clause_docs}}))")
def _(get):
    mode = F.nullif(F.regexp_extract("text", r"Mode: ([^\n]*)", 1), F.lit(""))
    return get("clause_docs").select("doc_id", F.array_join(S.split_modes(mode), "|").alias("modes"))


@query("c10_instrument_codes", f"SELECT doc_id, {CODES} AS codes FROM (SELECT doc_id, {MODE} AS m FROM {{clause_docs}})")
def _(get):
    return get("clause_docs").select("doc_id", S.instrument_codes(F.nullif(F.regexp_extract("text", r"Mode: ([^\n]*)", 1), F.lit(""))).alias("codes"))


@query("c11_address_parts", "SELECT tender_id, ord, trim(split_part(value_raw, ',', 1)) AS line1, trim(split_part(value_raw, ',', 2)) || ', ' || trim(split_part(value_raw, ',', 3)) AS line2, trim(split_part(value_raw, ',', 4)) AS pin FROM {occurrences} WHERE field_name = 'courier_address'")
def _(get):
    return get("occurrences").where("field_name = 'courier_address'").select("tender_id", "ord", S.address_parts(F.col("value_raw")).alias("a")).select("tender_id", "ord", "a.*")


@query("c14_duration_days", f"SELECT doc_id, {days('text')} AS days FROM {{clause_docs}}")
def _(get):
    return get("clause_docs").select("doc_id", S.duration_days(F.regexp_extract("text", r"Delivery Period: ([^\n]*)", 1)).alias("days"))


@query("c15_fraction_rate", "SELECT doc_id, CASE r WHEN '1/2' THEN 0.5 ELSE TRY_CAST(nullif(r, '') AS DECIMAL(9,4)) END AS rate FROM (SELECT doc_id, regexp_extract(text, 'SCHEDULE ([0-9/.]+)%', 1) AS r FROM {clause_docs})")
def _(get):
    return get("clause_docs").select("doc_id", S.fraction_rate(F.regexp_extract("text", r"SCHEDULE ([0-9/.]+)%", 1)).alias("rate"))


@query("c17_match_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[/\\_.:\-]', ' ', 'g'), '\s+', ' ', 'g')) AS plain, nullif(trim(regexp_extract(lower(text), 'total\s+quantity\s*[:\-]?\s*([^\n]*)', 1)), '') AS after_anchor FROM {clause_docs}")
def _(get):
    return get("clause_docs").select("doc_id", S.match_normalize(F.col("text")).alias("plain"), S.suffix_after(F.col("text"), "Total Quantity").alias("after_anchor"))


@query("c19_clean_name", "SELECT doc_id, 'Officer ' || regexp_extract(text, 'Officer ([A-Z])', 1) AS name FROM {clause_docs}")
def _(get):
    return get("clause_docs").select("doc_id", S.clean_name(F.concat(F.lit("Shri "), F.regexp_extract("text", r"Contact Person: ([^\n]*)", 1))).alias("name"))


@query("c21_sandwich", "SELECT doc_id, page, CASE WHEN length(text) <= 90 THEN text ELSE substr(text, 1, 30) || ' ... ' || substr(text, greatest(1, strpos(text, 'the') - 15), 30) || ' ... ' || right(text, 30) END AS cut FROM {threads}")
def _(get):
    return get("threads").select("doc_id", "page", S.sandwich(F.col("text"), "the", 90).alias("cut"))


@query("a12_distinct_emails", r"SELECT doc_id, string_agg(e, ';' ORDER BY n) AS emails FROM (SELECT doc_id, lower(e) AS e, min(n) AS n FROM (SELECT doc_id, unnest(l) AS e, unnest(range(len(l))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})', 1) AS l FROM {documents})) WHERE NOT regexp_matches(lower(e), '\.(png|jpg|pdf)$') GROUP BY 1, 2) GROUP BY doc_id")
def _(get):
    return X.distinct_emails(get("documents"))


@query("x1_keyword_windows", "SELECT doc_id, CAST(n AS BIGINT) AS n, place, substr(text, greatest(1, place - 20), least(20, place - 1)) AS \"left\", substr(text, place + 4, 20) AS \"right\" FROM (SELECT doc_id, text, n, 1 + 4 * (n + 1) + len(array_to_string(list_slice(p, 1, n + 1), '')) - 4 AS place FROM (SELECT doc_id, text, p, unnest(range(len(p) - 1)) AS n FROM (SELECT doc_id, text, string_split(text, ' the') AS p FROM {documents} WHERE contains(text, ' the'))))")
def _(get):
    return X.keyword_windows(get("documents"), " the", 20, 20).select("doc_id", "n", "place", "left", "right")


@query("x2_slice_section", "SELECT doc_id, substr(text, strpos(text, 'TERMS OF PAYMENT'), strpos(text, chr(10) || 'PRICE REDUCTION') - strpos(text, 'TERMS OF PAYMENT')) AS section FROM {clause_docs}")
def _(get):
    return get("clause_docs").select("doc_id", X.slice_section(F.col("text"), "TERMS OF PAYMENT", "PRICE REDUCTION|SECTION-").alias("section"))


@query("x3_bounded_search", "SELECT doc_id, nullif(regexp_extract(substr(text, strpos(text, 'PRICE REDUCTION SCHEDULE') + 24, 60), 'maximum of ([0-9]+)%', 1), '') AS cap FROM {clause_docs}")
def _(get):
    return get("clause_docs").select("doc_id", X.bounded_search(F.col("text"), "PRICE REDUCTION SCHEDULE", r"maximum of ([0-9]+)%", 60).alias("cap"))


@query("x4_label_value", f"SELECT doc_id, {found('Total Quantity: ([^\\n]*)')} AS quantity, {found('TERMS OF PAYMENT\\n([^\\n]{1,60})')} AS payment FROM {{clause_docs}}")
def _(get):
    return get("clause_docs").select("doc_id", X.label_value(F.col("text"), "Total Quantity").alias("quantity"), X.label_value(F.col("text"), "TERMS OF PAYMENT").alias("payment"))


@query("x5_resolve_staged", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN q WHEN regexp_matches(text, 'financial criteria not applicable') THEN 'Exempt' ELSE n END AS value, CASE WHEN doc_id % 3 = 0 THEN 'grid' WHEN regexp_matches(text, 'financial criteria not applicable') THEN 'exemption' ELSE 'label' END AS stage, CASE WHEN doc_id % 3 = 0 THEN 95 WHEN regexp_matches(text, 'financial criteria not applicable') THEN 90 ELSE 85 END AS conf_pct FROM (SELECT doc_id, text, nullif(regexp_extract(text, 'Total Quantity: ([0-9]+)', 1), '') AS q, nullif(regexp_extract(text, 'Net Worth: (Rs[^\\n]*)', 1), '') AS n FROM {clause_docs})")
def _(get):
    text = F.col("text")
    stage = lambda value, name, k, conf: get("clause_docs").select("doc_id", value.alias("value"), F.lit(name).alias("stage"), F.lit(k).alias("priority"), F.lit(conf).alias("conf_pct"))
    grid = F.when(F.col("doc_id") % 3 == 0, F.nullif(F.regexp_extract(text, "Total Quantity: ([0-9]+)", 1), F.lit("")))
    label = F.nullif(F.regexp_extract(text, r"Net Worth: (Rs[^\n]*)", 1), F.lit(""))
    exempt = F.when(text.rlike("financial criteria not applicable"), F.lit("Exempt"))
    stages = stage(grid, "grid", 0, 95).unionByName(stage(label, "label", 1, 85)).unionByName(stage(exempt, "exemption", 2, 90))
    return X.resolve_staged(stages, ["doc_id"])


_STRICT = found("Delivery Period: ([0-9]+) days")


@query("x6_bounded_fallback", f"""SELECT doc_id, CASE WHEN ok THEN v ELSE regexp_extract(q, '([0-9]+ (day|week|month)s?)', 1) END AS value, q AS quote, CASE WHEN ok THEN 'OK' WHEN q IS NOT NULL THEN 'OK_FALLBACK' ELSE 'MISSING' END AS status, NOT ok AND q IS NOT NULL AS needs_review, CASE WHEN ok THEN 85 WHEN q IS NOT NULL THEN 60 ELSE 0 END AS conf_pct
    FROM (SELECT *, CASE WHEN NOT ok THEN nullif(regexp_extract(substr(text, strpos(text, 'Delivery Period') + 15, 14), '([0-9]+ (day|week|month)s?)', 1), '') END AS q FROM (SELECT doc_id, text, {_STRICT} AS v, coalesce(TRY_CAST({_STRICT} AS INTEGER) BETWEEN 5 AND 730, false) AS ok FROM {{clause_docs}}))""")
def _(get):
    days = F.nullif(F.regexp_extract("text", r"Delivery Period: (\d+) days", 1), F.lit(""))
    out = X.bounded_fallback(days, days.try_cast("int").between(5, 730), F.col("text"), "Delivery Period", r"(\d+ (?:day|week|month)s?)", 14)
    return get("clause_docs").select("doc_id", out.alias("r")).select("doc_id", "r.*")


@query("x7_clause_terms", f"""SELECT doc_id, TRY_CAST({found('([0-9]+)% of supply value')} AS BIGINT) AS on_receipt, TRY_CAST({found('balance ([0-9]+)%')} AS BIGINT) AS balance,
    CASE {found('SCHEDULE ([0-9/.]+)%')} WHEN '1/2' THEN 0.5 ELSE TRY_CAST({found('SCHEDULE ([0-9/.]+)%')} AS DECIMAL(9,4)) END AS rate, TRY_CAST({found('maximum of ([0-9]+)%')} AS BIGINT) AS cap, {WORDS} AS years,
    CASE WHEN {found('Net Worth: Rs[.] ([0-9]+)')} IS NOT NULL THEN CAST({found('Net Worth: Rs[.] ([0-9]+)')} AS BIGINT) * CASE WHEN text LIKE '% Lakh%' THEN 100000 ELSE 10000000 END END AS net_worth,
    {days('text')} AS delivery_days, {CODES} AS instruments, 'REFER_TO_' || {found('SCHEDULE as per (SECTION-[IVX]+)')} AS deferred_to
    FROM (SELECT *, {MODE} AS m, regexp_extract(text, 'past ([a-z0-9]+) years', 1) AS w FROM {{clause_docs}})""")
def _(get):
    return X.clause_terms(get("clause_docs"))


def _read(family: str, *patterns: str, group: int = 0) -> str:
    return "coalesce(" + ", ".join(found(p, group, family) for p in patterns) + ")"


def _party(f: str) -> str:
    return f"CASE WHEN {f} = '' THEN NULL WHEN regexp_matches({f}, '\\bOEM\\b') AND regexp_matches({f}, '(?i)bidder') THEN 'Both' WHEN regexp_matches({f}, '\\bOEM\\b') THEN 'OEM' ELSE 'Bidder' END"


_INSTEAD = r"regexp_matches(guarantee, '(?i)(in\s+lieu\s+of|in\s+place\s+of|instead\s+of|substituted\s+for)\s+(performance\s+)?(security\s+deposit|performance\s+security|SD)')"


# families' words and reaches, as the survey lists them
_SAID = {
    "payment": (r"payment\s+terms?|payment\s+shall\s+be|released\s+on|against\s+(?:delivery|supply)|\bpayments?\b", 30, 400),
    "damages": (r"liquidated\s+damages|\bLD\b", 30, 350),
    "eligibility": (r"experience|similar\s+(?:nature\s+of\s+)?work", 30, 350),
    "turnover": (r"annual\s+turnover|\bAATO\b", 30, 300),
    "capital": (r"working\s+capital", 30, 250),
    "solvency": (r"solvency\s+certificate", 30, 250),
    "worth": (r"net\s*worth", 30, 250),
    "deposit": (r"security\s+deposit|\bSD\b", 30, 300),
    "guarantee": (r"e?PBG", 30, 300),
    "papers": (r"hard\s*cop(?:y|ies)|physical\s+(?:submission|copy|document)|original\s+documents?\s+[\w\s]{0,30}?(?:sent|submitted|received|postal)|postal\s+address|\bcourier\b|address\s+for\s+submission", 30, 400),
}


def _stretches(f: str) -> str:
    """Islands of meeting intervals around a family's words, cut from the text by their bounds; words are placed by the lengths of what lies between them."""
    words, before, after = _SAID[f]
    word = f"(?i)(?:{words})"
    return f"""(SELECT doc_id, string_agg(substr(text, CAST(low AS INTEGER) + 1, CAST(high - low AS INTEGER)), ' ' ORDER BY low) AS {f} FROM (SELECT doc_id, any_value(text) AS text, min(low) AS low, max(high) AS high FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
        SELECT doc_id, text, k, greatest(b - length(word) - {before}, 0) AS low, least(b + {after}, length(text)) AS high FROM (SELECT *, sum(length(part) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM (
        SELECT doc_id, text, unnest(w) AS word, unnest(p[1:len(w)]) AS part, unnest(range(len(w))) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w, string_split_regex(text, '{word}') AS p FROM {{narratives}})))))) GROUP BY doc_id, island) GROUP BY doc_id)"""


@query("x7_clause_windows", rf"""SELECT doc_id, coalesce(regexp_extract({_read('payment', X.ON_SUPPLY)}, '^\d{{1,3}}\s*%'), CASE WHEN {_read('payment', X.ON_INSTALLATION)} IS NULL AND regexp_matches(payment, '(?i)100\s*%\s*payment') THEN '100% (single milestone)' END) AS supply_pct,
    regexp_extract({_read('payment', X.ON_INSTALLATION)}, '^\d{{1,3}}\s*%') AS installation_pct, CASE WHEN damages <> '' THEN 'Yes' END AS ld_applicable, {_read('damages', *X.PER_WEEK)} AS ld_per_week, {_read('damages', X.AT_MOST, group=1)} AS ld_max,
    {_read('damages', '(?i)' + chr(92) + 'bclause' + chr(92) + 's*(?:no[.]?' + chr(92) + 's*)?([0-9]+([.][0-9]+)*)', group=1)} AS ld_clause, {_read('eligibility', '(?i)([0-9]{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)' + chr(92) + 's*years?')} AS years,
    {_read('eligibility', X.WORKS.format('one|1|single'), group=1)} AS work_1, {_read('eligibility', X.WORKS.format('two|2|double'), group=1)} AS work_2, {_read('eligibility', X.WORKS.format('three|3|triple'), group=1)} AS work_3,
    nullif(concat_ws('; ', CASE WHEN regexp_matches(eligibility, '(?i)psu experience|only from (government|psu)') THEN 'Requires PSU/Govt-specific experience' END, CASE WHEN regexp_matches(eligibility, '(?i)(export|foreign) experience') THEN 'References foreign/export experience' END), '') AS notes,
    {_party('turnover')} AS turnover_type, {_read('turnover', X.PERCENT_OF, X.RUPEES)} AS turnover, {_party('capital')} AS capital_type, {_read('capital', X.PERCENT_OF, X.RUPEES)} AS capital, CASE WHEN solvency <> '' THEN 'Bank Solvency Certificate' END AS solvency_type, {_read('solvency', X.RUPEES)} AS solvency,
    CASE WHEN regexp_matches(worth, '(?i)positive net ?worth') THEN 'Positive Net Worth Required' END AS worth_type, {_read('worth', X.RUPEES)} AS worth,
    CASE WHEN {_INSTEAD} THEN 'Not Applicable - ePBG in lieu' WHEN deposit = '' THEN NULL WHEN regexp_matches(deposit, '(?i)exempt|not required|no security deposit|not applicable') THEN 'No' ELSE 'Yes' END AS deposit_required,
    CASE WHEN NOT {_INSTEAD} THEN {_read('deposit', '[0-9]{1,2}([.][0-9]+)? *%')} END AS deposit_pct, CASE WHEN NOT {_INSTEAD} THEN {_read('deposit', '(?i)[0-9]{1,3} *months?')} END AS deposit_months,
    CASE WHEN papers = '' THEN 'No' ELSE 'Yes' END AS papers_required, {_read('papers', '(?i)within +[0-9]{1,2} *days|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}')} AS papers_deadline, {_read('papers', '(?i)original +[A-Za-z ]+?(instrument|certificate|affidavit|document)')} AS papers_type
    FROM (SELECT doc_id, {", ".join(f"coalesce({f}, '') AS {f}" for f in _SAID)} FROM {{narratives}} {" ".join(f"LEFT JOIN {_stretches(f)} USING (doc_id)" for f in _SAID)})""")
def _(get):
    return X.clause_windows(get("narratives"))


@query("x8_annexure_terms", f"SELECT doc_id, text LIKE '%PRICE REDUCTION SCHEDULE%' AS has_reduction, text LIKE '%Net Worth: Rs%' AS worth_required, TRY_CAST({found('maximum of ([0-9]+)%')} AS BIGINT) AS cap FROM {{clause_docs}}")
def _(get):
    text = F.col("text")
    return get("clause_docs").select("doc_id", F.contains(text, F.lit("PRICE REDUCTION SCHEDULE")).alias("has_reduction"), F.contains(text, F.lit("Net Worth: Rs")).alias("worth_required"), X.bounded_search(text, "PRICE REDUCTION SCHEDULE", r"maximum of (\d+)%", 100).try_cast("long").alias("cap"))


_REFERENCE = r"(?i)(?:cl(?:ause)?[.]?\s*no[.]?\s*\d+(?:[.]\d+)*\s*(?:of\s*)?(?:sec(?:tion)?[\s-]*[ivx0-9]+(?:\s*[(][A-Za-z]+[)])?)?)|(?:cl(?:ause)?[.]?\s*\d+(?:[.]\d+)*)|(?:sec(?:tion)?[\s-]*[ivx0-9]+(?:\s*[(][A-Za-z]+[)])?)|(?:para(?:graph)?[.]?\s*\d+(?:[.]\d+)*)|(?:GCC\s*\d+(?:[.]\d+)*)|(?:SCC\s*\d+(?:[.]\d+)*)"


def _references(f: str) -> str:
    words, before, after = _SAID[f]
    word = f"(?i)(?:{words})"
    near = f"nullif(trim(regexp_extract(substr(text, CAST(b AS INTEGER) + 1, {after}), '{_REFERENCE}', 0)), '')"
    left = f"regexp_extract_all(substr(text, CAST(greatest(b - length(word) - {before}, 0) AS INTEGER) + 1, CAST(least({before}, b - length(word)) AS INTEGER)), '{_REFERENCE}')"
    return f"""SELECT doc_id, '{f}' AS family, arg_min(ref, k) AS reference FROM (SELECT doc_id, k, coalesce({near}, nullif(trim({left}[-1]), '')) AS ref FROM (SELECT *, sum(length(part) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM (
        SELECT doc_id, text, unnest(w) AS word, unnest(p[1:len(w)]) AS part, unnest(range(len(w))) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w, string_split_regex(text, '{word}') AS p FROM {{narratives}})))) WHERE ref IS NOT NULL GROUP BY doc_id"""


@query("x7_clause_references", " UNION ALL ".join(map(_references, ("payment", "damages", "eligibility", "turnover", "capital", "solvency", "worth", "deposit", "papers"))))
def _(get):
    return X.clause_references(get("narratives"), ("payment", "damages", "eligibility", "turnover", "capital", "solvency", "worth", "deposit", "papers"))


@query("x9_contacts")
def _(get):
    return X.contacts(get("narratives"))


def _mentioned(view: str) -> str:
    word = r"trim(regexp_replace(word, '\s+', ' ', 'g'))"
    return rf"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS n, name, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY s, k) AS rn FROM (
        SELECT doc_id, s, k, CASE WHEN contains(w, '.') THEN w WHEN lower(w) LIKE '%boq%' THEN w || '.xlsx' ELSE w || '.pdf' END AS name, regexp_replace(trim(sentence, ' '), '
', ' ', 'g') AS sentence FROM (SELECT doc_id, s, k, sentence, {word} AS w FROM (
            SELECT doc_id, s, sentence, unnest(l) AS word, unnest(range(len(l))) AS k FROM (SELECT doc_id, s, sentence, regexp_extract_all(sentence, '{X.MENTIONS}', 1) AS l FROM (
                SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM {{{view}}}))))) WHERE length(w) > 3)) WHERE rn = 1)"""


@query("x10_mentions", f"SELECT * FROM {_mentioned('narratives')}")
def _(get):
    return X.mentions(get("narratives"))


@query("j16_unresolved_mentions", f"SELECT doc_id, name FROM {_mentioned('narratives')} m WHERE NOT (doc_id % 2 = 0 AND (strpos('annexure-ii.pdf', lower(name)) > 0 OR strpos(lower(name), 'annexure-ii.pdf') > 0))")
def _(get):
    linked = get("narratives").where("doc_id % 2 = 0").select("doc_id", F.lit("Annexure-II.pdf").alias("link_name"))
    return X.unresolved(X.mentions(get("narratives")).select("doc_id", "name"), linked).select("doc_id", "name")


@query("x11_links", "SELECT page_id, n, CASE WHEN h[1] = '/' THEN regexp_extract(url, '^(https?://[^/]+)', 1) ELSE '' END || regexp_replace(h, '[.,;:)]+$', '') AS link FROM (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS n FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM {pages}))")
def _(get):
    return X.links(get("pages"))


_URLS = """CASE page_id % 8 WHEN 0 THEN lower(url) WHEN 1 THEN 'https://mkp.gem.gov.in/' WHEN 2 THEN 'https://bidplus.gem.gov.in/resources/upload/x?id=1' WHEN 3 THEN 'https://a.org/files/b.xlsx?v=2'
    WHEN 4 THEN 'https://gem.gov.in/gtc/v1.pdf' WHEN 5 THEN 'https://b.org/corrigendum.html' WHEN 6 THEN 'https://c.org/logo.png' ELSE 'https://d.org/tenders/x' END"""


@query("p11_classify_url", f"""SELECT page_id, kind, CASE WHEN kind IN ('annexure', 'document') THEN sure ELSE least(70, sure) END AS conf_pct FROM (SELECT *, CASE WHEN regexp_matches(u, '^https?://[^/]+/?$') THEN 'homepage' WHEN regexp_matches(u, '/(gtc|terms|privacy)') THEN 'terms' WHEN regexp_matches(u, '[.](png|jpg|gif|css|js)$') THEN 'excluded'
    WHEN regexp_matches(u, '(annex|atc|corrigendum)') THEN 'annexure' WHEN regexp_matches(u, '{X.DOCUMENT_PARTS}') OR (regexp_matches(split_part(u, '/', 3), '{X.TENDER_HOSTS}') AND regexp_matches(u, '{X.TENDER_PATHS}')) THEN 'document' ELSE 'other' END AS kind,
    CASE page_id % 4 WHEN 0 THEN 98 WHEN 1 THEN CASE page_id % 3 WHEN 0 THEN 96 ELSE 92 END WHEN 2 THEN 90 ELSE 85 END AS sure FROM (SELECT page_id, {_URLS} AS u FROM {{pages}}))""")
def _(get):
    how = F.element_at(F.array(*map(F.lit, ("embedded", "annotation", "local", "text"))), (F.col("page_id") % 4 + 1).cast("int"))
    anchor = F.when(F.col("page_id") % 3 == 0, "see Annexure II").otherwise("click here")
    found = get("pages").select("page_id", how.alias("how"), anchor.alias("anchor"), X.classify_url(F.expr(_URLS)).alias("kind"))
    return found.select("page_id", "kind", X.link_confidence(F.col("kind"), F.col("how"), F.col("anchor")).alias("conf_pct"))


@query("u4_link_dedupe", "SELECT page_id, n, link FROM (SELECT *, row_number() OVER (PARTITION BY lower(link) ORDER BY page_id, n) AS rn FROM (SELECT page_id, n, CASE WHEN h[1] = '/' THEN regexp_extract(url, '^(https?://[^/]+)', 1) ELSE '' END || regexp_replace(h, '[.,;:)]+$', '') AS link FROM (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS n FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM {pages})))) WHERE rn = 1")
def _(get):
    first = F.struct("page_id", "n", "link")
    return X.links(get("pages")).groupBy(F.lower("link").alias("k")).agg(F.min(first).alias("f")).select("f.*")


@query("a18_link_summary", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN h[1] = '/' THEN 'relative' ELSE 'absolute' END AS kind FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM {pages})) GROUP BY 1")
def _(get):
    hrefs = get("pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("h"))
    return hrefs.groupBy(F.when(F.substring("h", 1, 1) == "/", "relative").otherwise("absolute").alias("kind")).agg(F.count("*").alias("n"))


def _has(word: str) -> str:
    return "CAST(regexp_matches(lower(text), '(^|\\W)" + word.replace(".", "[.]") + "(\\W|$)') AS INTEGER)"


_HITS = {name: " + ".join(map(_has, words)) for name, words in Ru.PRODUCTS.items()}


@query("x12_products", "SELECT doc_id, page_no, ord, text, category, " + f"""{found(f'(?i)\\b([0-9]+([.][0-9]+)?)\\s*({Ru.UNITS})\\b')} AS quantity, lower({found(f'(?i)\\b([0-9]+([.][0-9]+)?)\\s*({Ru.UNITS})\\b', 3)}) AS unit,
    trim({found('(?i)\\b(oem|make|brand|mfg|manufacturer)[:\\s]+([A-Za-z][A-Za-z0-9\\s&-]{2,30})', 2)}) AS brand, CAST(least(95, 60 + 5 * hits) AS INTEGER) AS conf_pct FROM (SELECT *, CASE """
       + " ".join(f"WHEN {h} > 0 THEN '{name}'" for name, h in _HITS.items()) + " END AS category, CASE " + " ".join(f"WHEN {h} > 0 THEN {h}" for h in _HITS.values())
       + " END AS hits FROM {tender_lines} WHERE length(trim(text)) >= 4) WHERE category IS NOT NULL")
def _(get):
    return Ru.products(get("tender_lines"), "text")


@query("u5_product_dedupe", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM {part} GROUP BY p_brand, p_type")
def _(get):
    return get("part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))


@query("x18_delivery_days", f"SELECT doc_id, CASE WHEN {days('text')} BETWEEN 30 AND 730 THEN {days('text')} END AS days FROM {{clause_docs}}")
def _(get):
    days = S.duration_days(F.regexp_replace(F.regexp_extract("text", r"Delivery Period: ([^\n]*)", 1), r"[1-9]\d{5}|Phone: \d+", " "))
    return get("clause_docs").select("doc_id", F.when(days.between(30, 730), days).alias("days"))


@query("x19_anchor_check", "SELECT item_id, doc_id FROM (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS v FROM {benchmark}) b JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM {documents}) d ON contains(d.t, b.v)")
def _(get):
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    items = get("benchmark").select("item_id", fold(F.col("text")).alias("v"))
    return Ru.contained(items, get("documents").select("doc_id", fold(F.col("text")).alias("t")))


_VALUES = {"pct": "CASE k % 4 WHEN 0 THEN '80%' WHEN 1 THEN '99.5' WHEN 2 THEN '1,00,0' ELSE NULL END", "name": "CASE k % 5 WHEN 0 THEN 'arun  RAO' WHEN 1 THEN 'remarks General work' WHEN 2 THEN 'Nobody Known' WHEN 3 THEN 'no' ELSE 'Not Found' END",
           "custom_eligibility_criteria": "CASE k % 3 WHEN 0 THEN '80 and 50 of 77' WHEN 1 THEN '12345 or 67890' ELSE 'similar work only' END", "flag": "'true'"}


@query("x19_supported_values", r"""SELECT doc_id, field_name, value, is_flag, is_flag OR coalesce(p > 0, false) AS supported, CASE WHEN p > 0 THEN substr(t, greatest(1, p - 100), p + 150 - greatest(1, p - 100) + length(v)) END AS snippet FROM (
    SELECT *, CASE WHEN is_flag OR value IS NULL OR trim(value) IN ('', 'NA', 'Not Found', 'None', 'Out of Scope (Stage 1)', 'null') THEN NULL
        WHEN field_name = 'custom_eligibility_criteria' AND len(nums) > 0 THEN CASE WHEN len(hit) * 10 >= len(nums) * 6 THEN instr(low, hit[1]) END
        WHEN regexp_matches(num, '^[0-9][0-9.]*$') AND instr(low, substr(num, 1, 8)) > 0 THEN instr(low, substr(num, 1, 8))
        WHEN length(v) > 2 AND instr(low, lower(v)) > 0 THEN instr(low, lower(v)) WHEN len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(low, w))) = 0 THEN instr(low, words[1]) END AS p
    FROM (SELECT *, list_filter(nums, lambda n: contains(t, n)) AS hit, list_filter(regexp_extract_all(lower(v), '\w+'), lambda w: length(w) > 2)[:4] AS words FROM (
        SELECT *, lower(t) AS low, regexp_replace(v, '[%₹,]', '', 'g') AS num, list_filter(regexp_extract_all(v, '[0-9]+([.,][0-9]+)?'), lambda x, i: list_position(regexp_extract_all(v, '[0-9]+([.,][0-9]+)?'), x) = i) AS nums FROM (
            SELECT q.*, trim(regexp_replace(trim(n.text, ' '), '\s+', ' ', 'g')) AS t, trim(regexp_replace(value, '\s+', ' ', 'g')) AS v FROM (""" + " UNION ALL ".join(f"SELECT k AS doc_id, '{name}' AS field_name, {value} AS value, {'true' if name == 'flag' else 'false'} AS is_flag FROM (SELECT o_orderkey AS k FROM {{orders}})" for name, value in _VALUES.items()) + r""") q JOIN {narratives} n ON n.doc_id = q.doc_id))))""")
def _(get):
    asked = get("orders").select(F.col("o_orderkey").alias("k"))
    rows = F.array(*[F.struct(F.lit(name).alias("field_name"), F.expr(value).alias("value"), F.lit(name == "flag").alias("is_flag")) for name, value in _VALUES.items()])
    predictions = asked.select(F.col("k").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")
    return St.anchor_check(predictions, get("narratives"))


@query("x20_heuristic_fill", f"SELECT doc_id, 'cap' AS field_name, {found('maximum of ([0-9]+)%')} AS value FROM {{clause_docs}} WHERE doc_id % 2 = 0 AND {found('maximum of ([0-9]+)%')} IS NOT NULL UNION ALL SELECT doc_id, 'quantity', {found('Total Quantity: ([0-9]+)')} FROM {{clause_docs}} WHERE doc_id % 3 = 0")
def _(get):
    docs = get("clause_docs")
    wanted = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("cap").alias("field_name")).unionByName(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("quantity").alias("field_name")))
    return Ru.heuristic_fill(docs, wanted, {"cap": r"maximum of ([0-9]+)%", "quantity": "Total Quantity: ([0-9]+)"})


@query("x21_exempt_financial", "SELECT c.doc_id, l.field_name, CASE WHEN c.text LIKE '%financial criteria not applicable%' THEN 'Exempt' END AS value FROM {clause_docs} c CROSS JOIN {labels4} l")
def _(get):
    exempt = F.when(F.col("text").rlike(r"(?s)financial criteria.{0,150}?not applicable"), F.lit("Exempt"))
    return St.every(get("clause_docs").select("doc_id", exempt.alias("value")), LABELS).select("doc_id", "field_name", "value")


_ON_RECORD = "pbg_percentage pbg_required pbg_duration sd_percentage sd_mode sd_duration sd_required avg_annual_turnover_type avg_annual_turnover_value net_worth_type net_worth_value delivery_time_installation delivery_time_supply te_recommendation te_rejection_reason pre_bid_meeting physical_docs_required physical_docs_deadline client_name_1 client_name_2 client_email_2 schedule_2_details doc_1 doc_2 doc_3 doc_4 emd_amount".split()


def _na(key: str) -> str:
    none = lambda k, *more: f"coalesce(trim({k}) IN ('', 'NA', 'N/A'{''.join(f", '{m}'" for m in more)}), true)" if k in _ON_RECORD else "true"
    pbg = f"(CASE WHEN NOT {none('pbg_percentage')} THEN NOT {none('pbg_percentage', 'Not Found', 'No')} ELSE NOT {none('pbg_required', 'Not Found', 'No')} END)"
    deposit = f"{pbg} AND {none('sd_percentage', 'Not Found', '₹0.00', '0.0', '0', '0%', '0.00%')}"
    low = lambda k: f"lower(coalesce({k}, ''))"
    exempt = " OR ".join(f"{low(k)} LIKE '%{word}%'" for k in ("avg_annual_turnover_type", "net_worth_type") for word in ("not applicable", "exempt"))
    rules = {"sd_percentage": deposit, "sd_duration": deposit, "sd_mode": f"{deposit} AND {none('sd_mode')}", "delivery_time_installation": none("delivery_time_installation", "Not Applicable"), "te_rejection_reason": f"{low('te_recommendation')} NOT LIKE '%reject%'",
             "pre_bid_meeting": f"{low('pre_bid_meeting')} IN ('', 'na', 'n/a') OR {low('pre_bid_meeting')} LIKE '%no pre-bid%'", **{k: exempt for f in St.FINANCIAL for k in (f"{f}_type", f"{f}_value")}, **{k: f"{low('physical_docs_required')} IN ('no', 'na', 'n/a', 'not required')" for k in St.PHYSICAL}}
    rules |= {f"client_{part}_{k}": none(f"client_name_{k}") for k in (2, 3) for part in ("name", "email", "phone")} | {k: none(k) for k in ("schedule_2_details", "schedule_3_details", *St.DOCUMENTS)}
    return rules.get(key, "false")


def _status_of(key: str) -> str:
    value = key if key in _ON_RECORD else "CAST(NULL AS VARCHAR)"
    return f"SELECT doc_id, '{key}' AS field_name, {value} AS value, CASE WHEN {_na(key)} THEN 'NOT_APPLICABLE' WHEN {value} IS NULL OR trim({value}) IN ('', 'NA', 'Not Found', 'None', 'Out of Scope (Stage 1)', '⚠️ MISSING') THEN 'MISSING' WHEN doc_id % 5 = 0 AND '{key}' IN ('delivery_time_supply', 'client_name_2') THEN 'OK_FALLBACK' ELSE 'OK' END AS status FROM {{info_records}}"


@query("r1_record_status", " UNION ALL ".join(map(_status_of, St.RECORD)))
def _(get):
    found = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("delivery_time_supply"), F.lit("client_name_2")))
    return St.record_status(get("info_records").withColumn("fallback", found))


_PRE = "CASE WHEN coalesce(pre_bid_meeting, 'NA') NOT IN ('', 'NA', '⚠️ MISSING') THEN pre_bid_meeting END"
_DOCS = ", ".join(f"CASE WHEN coalesce({k}, '') NOT IN ('', 'NA', 'None', '⚠️ MISSING') AND regexp_matches(lower({k}), 'oem|iso|approval|experience|turnover|pan|gst') THEN {k} END" for k in ("doc_1", "doc_2", "doc_3", "doc_4"))


@query("r8_readiness_summary", f"""SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(t, '{p}') THEN '{said}'" for p, said in St.SITE_VISITS)} ELSE 'Not specified' END AS site_visit,
    coalesce(pre || ' | Written queries accepted as per tender timeline', 'None specified / No pre-bid meeting scheduled') AS pre_bid,
    'Pre-Bid: ' || coalesce(pre, 'None') || '  →  Bid Due: ' || coalesce(bid_due, 'NA') || '  →  Physical Docs: ' || coalesce(physical_docs_deadline, 'NA') || '  →  Clarifications: ' || CASE WHEN t LIKE '%2 days%' OR t LIKE '%two packet%' THEN '2 Days' ELSE 'Standard' END AS timeline,
    'EMD: ' || coalesce(emd_amount, '₹0.00') || ' (via ' || coalesce(emd_mode, 'NA') || ')  |  PBG: ' || coalesce(pbg_percentage, 'NA') || ' for ' || coalesce(pbg_duration, 'NA') AS capital,
    CASE WHEN coalesce(experience_years, 'NA') <> 'NA' THEN 'Exp: ' || experience_years || ' Yrs' ELSE 'Technical BEC defined in ATC' END || CASE WHEN coalesce(order_value_1, 'NA') NOT IN ('NA', '⚠️ MISSING', '₹0.00') THEN ' (Min PO Value: ' || order_value_1 || ')' ELSE '' END || '  |  '
      || CASE WHEN lower(coalesce(avg_annual_turnover_value, 'NA')) LIKE '%not applicable%' OR avg_annual_turnover_value IN ('₹0.00', '0') THEN 'Financial BEC: Not Applicable (Exempted)' ELSE 'Turnover: ' || coalesce(avg_annual_turnover_value, 'NA') || ' (' || coalesce(avg_annual_turnover_type, 'Bidder') || ')' END AS bec,
    CASE WHEN len(docs) = 0 THEN 'Standard GeM Seller profile & declarations' ELSE array_to_string(docs[:4], ', ') END AS certifications,
    'Supply Delivery: ' || coalesce(delivery_time_supply, 'NA') || '  |  Installation/Completion: ' || coalesce(delivery_time_installation, 'NA') AS delivery,
    CASE WHEN t LIKE '%buyback%' OR t LIKE '%buy back%' THEN 'Yes — Existing equipment buyback & site removal required' ELSE 'No buyback scope' END AS buyback,
    CASE WHEN lower(coalesce(reverse_auction_applicable, 'No')) IN ('yes', 'true') THEN 'Yes (Bid to Reverse Auction enabled — dynamic pricing exposure)' ELSE 'No (Direct item-wise / schedule-wise evaluation without Reverse Auction)' END AS reverse_auction,
    'Standard GeM/GAIL Terms (Zero deviation allowed on EMD, PBG, BEC, Delivery)' AS disqualifiers, 'LD / PRS: ' || coalesce(ld_percentage, '0.5% per week') || '  |  Max Penalty Cap: ' || coalesce(max_ld_percentage, '5%') AS penalty_risk
    FROM (SELECT *, list_filter(raw, lambda x, i: x IS NOT NULL AND list_position(raw, x) = i) AS docs FROM (SELECT *, lower(coalesce(text, '')) AS t, {_PRE} AS pre, [CASE WHEN maf_required LIKE 'Yes%' THEN 'OEM Authorization Certificate' END, CASE WHEN lower(coalesce(text, '')) LIKE '%local content%' OR mii_preference = 'Yes' THEN 'Class 1/2 Local Content Certificate' END, {_DOCS}] AS raw FROM {{info_records}}))""")
def _(get):
    records = get("info_records")
    return St.readiness(records.select("*", *[F.lit(None).cast("string").alias(k) for k in St.DOCUMENTS if k not in records.columns]))


@query("r9_conflict_flag", "SELECT doc_id, doc_id % 2 = 0 AND text LIKE '%maximum of%' AS conflict FROM {clause_docs}")
def _(get):
    flags = get("clause_docs").select("doc_id", (F.col("doc_id") % 2 == 0).alias("said_no"))
    texts = get("clause_docs").select("doc_id", F.contains(F.col("text"), F.lit("maximum of")).alias("present"))
    return flags.join(texts, "doc_id").select("doc_id", (F.col("said_no") & F.col("present")).alias("conflict"))


@query("w9_number_documents", f"SELECT doc_id, trim(split_part(m, ',', 1)) AS doc_1, nullif(trim(split_part(m, ',', 2)), '') AS doc_2 FROM (SELECT doc_id, {MODE} AS m FROM {{clause_docs}})")
def _(get):
    return Ru.number_items(get("clause_docs").select("doc_id", F.regexp_extract("text", r"Mode: ([^\n]*)", 1).alias("items")), 2)


@query("w12_allocate_slots")
def _(get):
    emails = get("narratives").select("doc_id", F.posexplode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?:\G|(?<![\w.-]))([\w.-]++@[\w.-]+\.\w+)"), 1))).alias("n", "email"))
    return X.contact_slots(X.contacts(get("narratives")), emails)


@query("j15_gold_comparison", "SELECT g.doc_id, g.field_name, g.expected, p.value, CASE WHEN p.value IS NULL THEN 'MISSING' WHEN trim(p.value) = trim(g.expected) THEN 'MATCH' ELSE 'MISMATCH' END AS outcome FROM {gold} g LEFT JOIN {predictions} p ON g.doc_id = p.doc_id AND g.field_name = p.field_name")
def _(get):
    return St.gold_comparison(get("gold"), get("predictions"))


@query("a14_accuracy", "SELECT field_name, outcome, count(*) AS n FROM (SELECT g.field_name, CASE WHEN p.value IS NULL THEN 'MISSING' WHEN trim(p.value) = trim(g.expected) THEN 'MATCH' ELSE 'MISMATCH' END AS outcome FROM {gold} g LEFT JOIN {predictions} p ON g.doc_id = p.doc_id AND g.field_name = p.field_name) GROUP BY CUBE (field_name, outcome)")
def _(get):
    return St.gold_comparison(get("gold"), get("predictions")).cube("field_name", "outcome").agg(F.count("*").alias("n"))
