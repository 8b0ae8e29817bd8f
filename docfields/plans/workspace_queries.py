"""Queries over the workspace, jobs and corrections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import status as St
from docfields.operators import workspace as Wk
from docfields.plans.registry import Registry
from docfields.streaming import streams

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles

AS_OF = date(1998, 1, 1)
LATEST = "row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC)"


@query("p10_search", "SELECT id, title, city, tender_value FROM {workspace} WHERE contains(lower(title || ' ' || authority || ' ' || department), 'building') AND NOT contains(lower(title || ' ' || authority || ' ' || department), 'low') AND deadline >= DATE '1998-01-01' AND tender_value >= 1000 AND emd <= 100000")
def _(get):
    return Wk.search(get("workspace"), Wk.Filters(text="BUILDING", must_not=("low",), live_on=AS_OF, value=(1000, None), emd=(None, 100000))).select("id", "title", "city", "tender_value")


@query("t1_sort_workspace", "SELECT id, tender_value, deadline FROM {workspace} ORDER BY tender_value DESC NULLS LAST, id")
def _(get):
    return Wk.ordered(get("workspace"), "value").select("id", "tender_value", "deadline")


@query("a13_workspace_kpis", "SELECT count(*) FILTER (deadline >= DATE '1998-01-01') AS live, count(*) FILTER (parse_status = 'processing') AS ingesting, count(*) FILTER (deadline BETWEEN DATE '1998-01-01' AND DATE '1998-01-08') AS closing_soon, count(*) FILTER (parse_confidence >= 85) AS high_match FROM {workspace}")
def _(get):
    return Wk.kpis(get("workspace"), F.lit(AS_OF))


@query("c25_days_left", "SELECT id, deadline - DATE '1998-01-01' AS days_left, CASE WHEN parse_confidence < 70 THEN 'low' WHEN parse_confidence < 85 THEN 'medium' ELSE 'high' END AS band FROM {workspace}")
def _(get):
    return get("workspace").select("id", S.days_left(F.col("deadline"), F.lit(AS_OF)).alias("days_left"), S.confidence_band(F.col("parse_confidence")).alias("band"))


@query("c26_split_location", "SELECT id, city, state FROM {workspace}")
def _(get):
    place = F.concat("city", F.lit(", "), "state")
    return get("workspace").select("id", F.trim(F.split_part(place, F.lit(","), F.lit(1))).alias("city"), F.trim(F.split_part(place, F.lit(","), F.lit(2))).alias("state"))


@query("c4_ui_numeric", "SELECT id, emd * 100000 AS amount FROM {workspace}")
def _(get):
    return get("workspace").select("id", S.ui_numeric(F.concat(F.col("emd").cast("string"), F.lit(" Lakh"))).alias("amount"))


@query("c7_parse_datetime", "SELECT id, CAST(deadline AS TIMESTAMP) AS parsed FROM {workspace}")
def _(get):
    forms = [F.date_format("deadline", f) for f in ("dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")] + [F.concat(F.lit("due on "), F.date_format("deadline", "dd.MM.yyyy"), F.lit(" at noon"))]
    spelled = F.element_at(F.array(*forms), (F.col("id") % 4 + 1).cast("int"))
    return get("workspace").select("id", S.parse_datetime(spelled).cast("timestamp").alias("parsed"))


@query("c16_eval_method", "SELECT id, CASE WHEN regexp_matches(lower(department), 'item|schedule') THEN 'Item Wise' WHEN regexp_matches(lower(department), 'total|overall|l1') THEN 'Total Value' ELSE 'Other' END AS method, CASE WHEN regexp_matches(lower(trim(department)), '^(no|not|nil)') THEN 'No' ELSE 'Yes' END AS state FROM {workspace}")
def _(get):
    return get("workspace").select("id", S.eval_method(F.col("department")).alias("method"), S.tri_state(F.col("department")).alias("state"))


@query("j17_merge_lists", "SELECT id, title, 'first' AS origin FROM {workspace} WHERE id % 2 = 0 UNION ALL SELECT id, title, 'second' FROM {workspace} WHERE id % 3 = 0 AND id % 2 <> 0")
def _(get):
    w = get("workspace")
    return Wk.merge_lists(w.where("id % 2 = 0").select("id", "title", F.lit("first").alias("origin")), w.where("id % 3 = 0").select("id", "title", F.lit("second").alias("origin")))


@query("j18_parent_child", "SELECT c_custkey AS id, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS children, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
def _(get):
    children = get("orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").cast("string").alias("name"))
    return Wk.with_children(get("customer").select(F.col("c_custkey").alias("id")), children)


@query("j21_select_child", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1")
def _(get):
    priority = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = F.struct(priority.alias("p"), (-F.col("o_totalprice")).alias("s"), F.col("o_orderkey"))
    return get("orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), best).alias("b")).select("o_custkey", "b.*")


@query("t4_largest_child", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1")
def _(get):
    return get("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("s"), F.col("o_orderkey"))).alias("o_orderkey"))


@query("t2_newest_jobs", f"SELECT job_id, ts, state FROM (SELECT *, {LATEST} AS rn FROM {{job_events}}) WHERE rn = 1 ORDER BY ts DESC, job_id LIMIT 20")
def _(get):
    latest = get("job_events").groupBy("job_id").agg(F.max_by(F.struct("ts", "state"), F.struct("ts", "event_id")).alias("b"))
    return latest.select("job_id", "b.*").orderBy(F.desc("ts"), "job_id").limit(20)


@query("st2_job_state", f"SELECT l.job_id, l.state, s.started, s.completed, s.failures FROM (SELECT job_id, state FROM (SELECT *, {LATEST} AS rn FROM {{job_events}} WHERE state <> 'edited') WHERE rn = 1) l JOIN (SELECT job_id, min(ts) FILTER (state = 'processing') AS started, max(ts) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failures FROM {{job_events}} WHERE state <> 'edited' GROUP BY 1) s ON l.job_id = s.job_id")
def _(get):
    return streams.job_state(get("job_events"))


_FOLLOWS = "(before IS NULL AND state = 'pending') OR (before = 'pending' AND state IN ('processing', 'failed')) OR (before = 'processing' AND state IN ('completed', 'failed')) OR (before = 'failed' AND state IN ('pending', 'processing'))"


@query("st2_transitions", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM {{job_events}} WHERE state <> 'edited'),
    f AS (SELECT job_id, event_id, ts, k, CAST(NULL AS VARCHAR) AS before, state, CASE WHEN state = 'pending' THEN state END AS at FROM e WHERE k = 1
          UNION ALL SELECT e.job_id, e.event_id, e.ts, e.k, f.at AS before, e.state, CASE WHEN {_FOLLOWS.replace('before', 'f.at').replace('state', 'e.state')} THEN e.state ELSE f.at END AS at FROM f JOIN e ON e.job_id = f.job_id AND e.k = f.k + 1)
    SELECT job_id, event_id, ts, before, state, coalesce({_FOLLOWS}, false) AS legal, CASE WHEN coalesce({_FOLLOWS}, false) THEN NULL WHEN state = before THEN 'repeated' WHEN before IS NULL THEN 'a job does not begin ' || state ELSE before || ' does not become ' || state END AS reason FROM f""")
def _(get):
    return streams.transitions(get("job_events"))


@query("st3_idempotent_ingest", "SELECT job_id, state, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, state ORDER BY ts, event_id) AS rn FROM {job_events}) WHERE rn = 1 AND job_id % 2 = 1")
def _(get):
    done = get("job_events").where("job_id % 2 = 0").select("job_id").distinct()
    return streams.fresh_events(get("job_events"), done).select("job_id", "state", "ts", "event_id")


@query("st4_stuck_jobs", f"SELECT job_id, state, ts FROM (SELECT *, {LATEST} AS rn FROM {{job_events}}) WHERE rn = 1 AND state IN ('pending', 'processing') AND ts < (SELECT max(ts) FROM {{job_events}}) - INTERVAL 1 HOUR")
def _(get):
    return streams.stuck_jobs(get("job_events"), "1 hour")


@query("st5_kpi_windows", "SELECT state, date_trunc('hour', ts) AS start, count(*) AS n FROM {job_events} GROUP BY 1, 2")
def _(get):
    return streams.kpi_windows(get("job_events"), "1 hour").select("state", "start", "n")


@query("st5_kpi_sliding", "SELECT state, start, count(*) AS n FROM (SELECT state, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM {job_events} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY 1, 2")
def _(get):
    return streams.kpi_windows(get("job_events"), "1 hour", "15 minutes").select("state", "start", "n")


@query("st5_kpi_sessions", "SELECT job_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(isnew) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS isnew FROM {job_events})) GROUP BY job_id, s")
def _(get):
    return streams.sessions(get("job_events"), "30 minutes").select("job_id", "start", "n")


@query("st1_ingest_stream", r"""SELECT doc_id, 'title' AS field_name, regexp_extract(text, '^\s*([^.\n]{1,80})', 1) AS value, CAST(floor(length(regexp_replace(text, '[^\p{L}\p{N} \n\r\t]', '', 'g')) * 1000 / greatest(length(text), 1)) AS BIGINT) AS quality FROM {documents} WHERE n_chars > 0 AND regexp_extract(text, '^\s*([^.\n]{1,80})', 1) <> ''""")
def _(get):
    return streams.ingest(get("documents").where("n_chars > 0"))


@query("st7_stream_upsert", f"SELECT job_id, state, ts FROM (SELECT *, {LATEST} AS rn FROM {{job_events}}) WHERE rn = 1")
def _(get):
    return streams.run_upsert(get("job_events"))


@query("r6_review_log", f"SELECT l.job_id, l.state, s.edits, coalesce(s.c IS NOT NULL AND (s.e IS NULL OR s.c > s.e), false) AS verified FROM (SELECT job_id, state FROM (SELECT *, {LATEST} AS rn FROM {{job_events}}) WHERE rn = 1) l JOIN (SELECT job_id, count(*) FILTER (state = 'edited') AS edits, max((epoch_us(ts), event_id)) FILTER (state = 'completed') AS c, max((epoch_us(ts), event_id)) FILTER (state = 'edited') AS e FROM {{job_events}} GROUP BY 1) s ON l.job_id = s.job_id")
def _(get):
    return St.review_log(get("job_events"))


@query("r6_apply_review_log", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY ts DESC, event_id DESC) AS rn, row_number() OVER (PARTITION BY doc_id, field_name, action ORDER BY ts DESC, event_id DESC) AS ra FROM {review_events}),
    j AS (SELECT m.doc_id, m.field_name, m.value AS v0, m.conf_pct AS c0, CASE m.source_page % 3 WHEN 0 THEN 'missing' ELSE 'extracted' END AS s0, d.doc_id IS NOT NULL AS edited, d.value AS v1, l.action, l.reviewer AS r1, l.ts AS t1, l.event_id AS i1, c.reviewer AS r2, c.ts AS t2, c.event_id AS i2, c.doc_id IS NOT NULL AS completed
        FROM {main_fields} m LEFT JOIN (SELECT * FROM e WHERE action = 'edit' AND ra = 1) d ON d.doc_id = m.doc_id AND d.field_name = m.field_name LEFT JOIN (SELECT * FROM e WHERE action <> 'complete' AND rn = 1) l ON l.doc_id = m.doc_id AND l.field_name = m.field_name LEFT JOIN (SELECT * FROM e WHERE action = 'complete' AND ra = 1) c ON c.doc_id = m.doc_id),
    k AS (SELECT *, CASE action WHEN 'edit' THEN 'edited' WHEN 'verify' THEN 'verified' ELSE s0 END AS st FROM j), f AS (SELECT *, completed AND (action IS NULL OR t2 > t1 OR (t2 = t1 AND i2 > i1)) AND st IN ('extracted', 'edited') AS closed FROM k)
    SELECT doc_id, field_name, CASE WHEN edited THEN v1 ELSE v0 END AS value, CASE WHEN closed THEN 'verified' ELSE st END AS status, CASE WHEN edited THEN 100 ELSE c0 END AS conf_pct, CASE WHEN closed THEN r2 ELSE r1 END AS reviewer FROM f""")
def _(get):
    fields = get("main_fields").select("doc_id", "field_name", "value", F.when(F.col("source_page") % 3 == 0, "missing").otherwise("extracted").alias("status"), "conf_pct")
    return St.apply_review_log(fields, get("review_events"))


@query("c23_json_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {job_events}")
def _(get):
    return get("job_events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_MEMORY = "(SELECT *, row_number() OVER (PARTITION BY field_key ORDER BY conf_pct DESC, ts DESC, conv_id DESC, anchor) AS rank FROM (SELECT *, substr(anchor_text, 1, 100) AS anchor, row_number() OVER (PARTITION BY field_key, substr(anchor_text, 1, 100) ORDER BY ts DESC, conv_id DESC) AS rn FROM {corrections}) WHERE rn = 1)"


@query("w11_correction_memory", f"SELECT field_key, rank, anchor, value, conf_pct, ts FROM {_MEMORY} WHERE rank <= 5")
def _(get):
    return St.correction_memory(get("corrections"))


@query("st6_correction_stream", f"SELECT field_key, rank, anchor, value, conf_pct, ts FROM {_MEMORY} WHERE rank <= 5")
def _(get):
    return streams.run_correction_stream(get("corrections"))


@query("t3_few_shot", f"SELECT field_key, rank, anchor FROM {_MEMORY} WHERE rank <= 2")
def _(get):
    return St.correction_memory(get("corrections"), 2).select("field_key", "rank", "anchor")


@query("r12_few_shot_examples", f"SELECT field_key, string_agg(CASE WHEN field_key = 'user' THEN 'NAME' ELSE value END || ' <- ' || substr(anchor, 1, 120), chr(10) ORDER BY rank) AS prompt FROM {_MEMORY} WHERE rank <= 2 GROUP BY field_key")
def _(get):
    rows = St.correction_memory(get("corrections"), 2).withColumn("text", F.concat(S.anonymize(F.col("value"), F.col("field_key")), F.lit(" <- "), F.substring("anchor", 1, 120)))
    return rows.groupBy("field_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("prompt"))


@query("c22_anonymize", "SELECT doc_id, page, k, CASE k WHEN 'email' THEN 'user@example.com' WHEN 'phone' THEN '0000000000' ELSE substr(text, 1, 10) END AS value FROM {threads} CROSS JOIN (SELECT unnest(['email', 'phone', 'value']) AS k)")
def _(get):
    keyed = get("threads").select("doc_id", "page", "text", F.explode(F.array(F.lit("email"), F.lit("phone"), F.lit("value"))).alias("k"))
    return keyed.select("doc_id", "page", "k", S.anonymize(F.substring("text", 1, 10), F.col("k")).alias("value"))


@query("u1_union_pages", "SELECT doc_id, page, 'parent' AS source, length(text) AS n FROM {threads} WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, page, 'annexure', length(text) FROM {threads} WHERE doc_id % 2 <> 0")
def _(get):
    t = get("threads").select("doc_id", "page", F.length("text").alias("n"))
    return t.where("doc_id % 2 = 0").withColumn("source", F.lit("parent")).unionByName(t.where("doc_id % 2 <> 0").withColumn("source", F.lit("annexure")))


@query("t5_bounded_previews", "SELECT doc_id, page, substr(text, 1, 200) AS snippet, substr(text, 1, 120) AS anchor FROM {threads}")
def _(get):
    return get("threads").select("doc_id", "page", F.substring("text", 1, 200).alias("snippet"), F.substring("text", 1, 120).alias("anchor"))
