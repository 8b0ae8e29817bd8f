"""Queries over sources, sinks, registers and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import models as M
from docfields.operators import rules as Ru
from docfields.plans.registry import Registry
from docfields.sources import io

_r = Registry()
query, QUERIES, ORACLES = _r.add, _r.queries, _r.oracles


@query("s1_read_pages", "SELECT doc_id, page, length(text) AS n FROM {threads}")
def _(get):
    return get("threads").select("doc_id", "page", F.length("text").alias("n"))


@query("s2_read_blocks", "SELECT doc_id, page_no, ord - 1 AS ord, text, x1, y1, x2, y2 FROM {blocks}")
def _(get):
    return io.flatten_blocks(io.nest_blocks(get("blocks"))).select("doc_id", "page_no", "ord", "text", "x1", "y1", "x2", "y2")


@query("s3_load_rules", "SELECT DISTINCT p_brand AS field_name, lower(p_type) AS alias, 0 AS later FROM {part} UNION ALL SELECT DISTINCT p_brand, p_brand || ' item', 1 FROM {part}")
def _(get):
    rules = get("part").select(F.col("p_brand").alias("field_name"), F.lower("p_type").alias("alias"), F.lit(0).alias("precedence"))
    synonyms = get("part").select(F.col("p_brand").alias("field_name"), F.concat("p_brand", F.lit(" item")).alias("alias")).distinct()
    return Ru.expand_aliases(rules, synonyms.unionByName(rules.select("field_name", F.upper("alias").alias("alias")).distinct()))


@query("j1_expand_aliases", "SELECT DISTINCT field_name, CASE k WHEN 0 THEN field_name ELSE lower(field_name) || ' value' END AS alias, k AS later FROM {main_fields} CROSS JOIN (SELECT unnest([0, 1]) AS k)")
def _(get):
    rules = get("main_fields").select("field_name", F.col("field_name").alias("alias"), F.lit(0).alias("precedence")).distinct()
    more = rules.select("field_name", F.concat(F.lower("field_name"), F.lit(" value")).alias("alias")).unionByName(rules.select("field_name", F.upper("field_name").alias("alias")))
    return Ru.expand_aliases(rules, more)


@query("s4_read_gold", "SELECT CAST(doc_id AS VARCHAR) AS tender_id, field_name, expected FROM {gold}")
def _(get):
    fields = F.map_from_entries(F.collect_list(F.struct("field_name", "expected")))
    nested = get("gold").groupBy("doc_id").agg(fields.alias("f")).select(F.to_json(F.create_map(F.col("doc_id").cast("string"), F.col("f"))).alias("payload"))
    return io.flatten_gold(nested)


@query("s7_detail_json", "SELECT doc_id, '{{\"found\":' || count(*) FILTER (value <> 'Not Found') || ',\"fields\":[' || string_agg('{{\"label\":\"' || field_name || '\",\"value\":\"' || value || '\"}}', ',' ORDER BY ord) || ']}}' AS payload FROM {main_fields} GROUP BY doc_id".replace("{{", "{").replace("}}", "}"))
def _(get):
    return io.detail_json(get("main_fields"))


@query("s11_content_key_cache", "SELECT page_id, substr(sha256(url), 1, 16) AS key FROM {pages} WHERE url NOT IN (SELECT url FROM {pages} WHERE page_id % 2 = 0)")
def _(get):
    pages = get("pages").select("page_id", "url")
    manifest = pages.where("page_id % 2 = 0").select(io.content_key(F.col("url")).alias("key"), F.lit(10).alias("size"))
    return io.not_cached(pages, manifest).select("page_id", "key")


@query("s12_register_documents", "SELECT page_id AS id, CAST(NULL AS BIGINT) AS parent_id FROM {pages} WHERE page_id % 2 = 0 UNION ALL SELECT page_id, NULL FROM {pages} WHERE page_id % 2 <> 0 UNION ALL SELECT page_id + 10000000, page_id FROM {pages}")
def _(get):
    pages = get("pages")
    existing = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), F.lit(None).cast("long").alias("parent_id"))
    return io.register(existing, pages.select(F.col("page_id").alias("id")), pages.select((F.col("page_id") + 10_000_000).alias("id"), F.col("page_id").alias("parent_id")))


@query("s13_validate_files", "SELECT page_id, CASE WHEN lower(substr(html, 1, 5)) = '<!doc' THEN 'html' END AS kind, CASE WHEN html IS NULL THEN 'bad_magic' WHEN length(html) = 0 THEN 'empty' WHEN lower(substr(html, 1, 5)) <> '<!doc' THEN 'bad_magic' ELSE 'ok' END AS reason FROM {pages}")
def _(get):
    return io.validate_files(get("pages").select("page_id", F.encode("html", "UTF-8").alias("content"))).select("page_id", "kind", "reason")


_FILES = "SELECT page_id, url AS path, CASE page_id % 5 WHEN 0 THEN '%PDF-1.4 ' WHEN 1 THEN 'PK' || chr(3) || chr(4) WHEN 2 THEN '%PD' WHEN 3 THEN '' ELSE ' %PDF' END || CASE WHEN page_id % 10 = 3 THEN '' ELSE coalesce(html, '') END AS body, CASE page_id % 7 WHEN 0 THEN 'application/PDF' WHEN 1 THEN 'application/vnd.ms-Excel' WHEN 2 THEN 'text/html' END AS content_type FROM {pages}"


@query("s13_check_documents", f"SELECT page_id, path, strlen(body) AS length, CASE WHEN starts_with(body, '%PDF') THEN 'pdf' WHEN starts_with(body, 'PK' || chr(3) || chr(4)) THEN 'excel' WHEN contains(lower(content_type), 'pdf') THEN 'pdf' WHEN contains(lower(content_type), 'excel') THEN 'excel' END AS kind, CASE WHEN body = '' THEN 'empty' WHEN strlen(body) > 4000 THEN 'too_large' WHEN starts_with(body, '%PDF') OR starts_with(body, 'PK' || chr(3) || chr(4)) OR regexp_matches(content_type, '(?i)pdf|excel') THEN 'ok' ELSE 'not_document' END AS reason FROM ({_FILES})")
def _(get):
    pages = get("pages")
    files = pages.sparkSession.sql(_FILES, pages=pages).select("page_id", "path", "content_type", F.encode("body", "UTF-8").alias("content"))
    return io.check_documents(files.withColumn("length", F.length("content")), 4000).select("page_id", "path", "length", "kind", "reason")


@query("c24_title_from_filename", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)/?$', 1), '[.][A-Za-z0-9]+$', ''), '[-_+.]+', ' ', 'g')) AS title FROM {pages}")
def _(get):
    return get("pages").select("page_id", S.title_from_filename(F.col("url")).alias("title"))


@query("e2_predict", "SELECT doc_id, field_name, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS value FROM (SELECT doc_id, text FROM {clause_docs}) JOIN (SELECT doc_id AS d, field_name FROM {main_fields} WHERE value = 'Not Found') ON d = doc_id")
def _(get):
    wanted = get("main_fields").where("value = 'Not Found'").select("doc_id", "field_name")
    return M.predict(wanted, get("clause_docs"), lambda key, text: "even" if len(text) % 2 == 0 else "odd")


@query("e3_fuzzy_score")
def _(get):
    return get("part").select("p_partkey", M.fuzzy_score(F.lower("p_name"), F.lower("p_type")).alias("score"))


@query("e1_register_rule", "SELECT doc_id, 'cap' AS field_name, nullif(regexp_extract(text, 'maximum of ([0-9]+)%', 1), '') AS value FROM {clause_docs} UNION ALL SELECT doc_id, 'quantity', nullif(regexp_extract(text, 'Total Quantity: ([0-9]+)', 1), '') FROM {clause_docs}")
def _(get):
    docs = get("clause_docs")
    rules = [("cap", "maximum of ([0-9]+)%"), ("quantity", "Total Quantity: ([0-9]+)")]
    return Ru.apply_rules(docs, rules)
