"""Readers, writers and registers of pages, blocks, gold and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<block_id: string, text: string, confidence: double, bounding_box: struct<x1: int, y1: int, x2: int, y2: int>>"


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Page rows (doc_id, page, text, source, confidence) that were extracted before; the schema is given, not inferred."""
    return spark.read.schema("doc_id long, page long, text string, source string, confidence double").format(form).load(path)


def flatten_blocks(docs: DataFrame) -> DataFrame:
    """Nested JSON {"pages": {"1": [block, ...]}} in payload -> one row a block with its ordinal."""
    parsed = docs.select("doc_id", F.from_json("payload", f"pages map<string, array<{BLOCK}>>").alias("p"))
    pages = parsed.select("doc_id", F.explode("p.pages").alias("page", "blocks"))
    return pages.select("doc_id", F.col("page").cast("long").alias("page_no"), F.posexplode("blocks").alias("ord", "b")).select("doc_id", "page_no", "ord", "b.block_id", "b.text", "b.confidence", "b.bounding_box.*")


def nest_blocks(blocks: DataFrame) -> DataFrame:
    """One JSON payload a document from rows of blocks: what ``flatten_blocks`` reads."""
    box = F.struct("x1", "y1", "x2", "y2").alias("bounding_box")
    block = F.struct(F.col("ord").cast("string").alias("block_id"), "text", (F.col("conf_pct") / 100).alias("confidence"), box)
    pages = blocks.groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return pages.groupBy("doc_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("page_no").cast("string"), "blocks"))).alias("pages"))).alias("payload"))


def flatten_gold(docs: DataFrame) -> DataFrame:
    """Nested JSON {id: {field: value}} in payload -> (tender_id, field_name, expected)."""
    outer = docs.select(F.explode(F.from_json("payload", "map<string, map<string, string>>")).alias("tender_id", "fields"))
    return outer.select("tender_id", F.explode("fields").alias("field_name", "expected"))


def detail_json(fields: DataFrame) -> DataFrame:
    """One JSON a document with its fields in order and its count of found ones."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "field_name", "value"))), lambda x: F.struct(x["field_name"].alias("label"), x["value"].alias("value")))
    return fields.groupBy("doc_id").agg(F.to_json(F.struct(F.count_if(F.col("value") != "Not Found").alias("found"), listed.alias("fields"))).alias("payload"))


def content_key(url: Column) -> Column:
    """The first 16 hex digits of the URL's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def not_cached(urls: DataFrame, manifest: DataFrame) -> DataFrame:
    """URLs whose key is not in the manifest (key, size) with a size."""
    keyed = urls.withColumn("key", content_key(F.col("url")))
    return keyed.join(manifest.where("size > 0").select("key"), "key", "left_anti")


def register(existing: DataFrame, parents: DataFrame, links: DataFrame) -> DataFrame:
    """Parent and child rows (id, parent_id); known parents are not added again."""
    new = parents.select("id", F.lit(None).cast("long").alias("parent_id")).unionByName(links.select("id", "parent_id"))
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti"))


def validate_files(files: DataFrame, least: int = 1, most: int = 20 << 20) -> DataFrame:
    """A reason for each file (content binary): ok, empty, too_large or bad_magic."""
    magic = F.substring("content", 1, 4)
    kind = F.when(magic == F.lit(b"%PDF"), "pdf").when(magic == F.lit(b"PK\x03\x04"), "zip").when(F.lower(F.substring("content", 1, 5).cast("string")).startswith("<!doc"), "html")
    reason = F.when(F.length("content") < least, "empty").when(F.length("content") > most, "too_large").when(kind.isNull(), "bad_magic").otherwise("ok")
    return files.withColumn("kind", kind).withColumn("reason", reason)


# fixed values: what content types of documents contain
TYPES = {"pdf": r"pdf", "excel": r"spreadsheet|excel|officedocument"}


def read_files(spark: SparkSession, path: str, most: int = 20 << 20) -> DataFrame:
    """Files below a path: path, length and content. The content of files of more than ``most`` bytes is never read; it is null.

    Spark's binary files leave out those of no bytes; a caller that lists them itself adds them as rows of length 0, and ``check_documents`` rejects them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= most).select("path", "length", "content")
    return small.unionByName(files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content")))


def check_documents(files: DataFrame, most: int = 20 << 20) -> DataFrame:
    """Files (path, length, content, perhaps content_type) with kind and reason. A document begins as PDF or ZIP files do, or its content type says so: pdf or excel.

    Reasons: empty (no bytes, or an unknown length), too_large, not_document, ok. The start of the content is looked at before the content type."""
    magic = F.substring("content", 1, 4)
    said = F.lower("content_type") if "content_type" in files.columns else F.lit(None).cast("string")
    kind = F.when(magic == F.lit(b"%PDF"), "pdf").when(magic == F.lit(b"PK\x03\x04"), "excel").when(said.rlike(TYPES["pdf"]), "pdf").when(said.rlike(TYPES["excel"]), "excel")
    reason = F.when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("length") > most, "too_large").when(kind.isNull(), "not_document").otherwise("ok")
    return files.withColumn("kind", kind).withColumn("reason", reason)


def route_files(checked: DataFrame, folder: str) -> None:
    """Checked files in two tables of one write: outcome=valid with their content, outcome=rejected with their reason and without it."""
    valid = F.col("reason") == "ok"
    rows = checked.withColumn("content", F.when(valid, F.col("content"))).withColumn("outcome", F.when(valid, "valid").otherwise("rejected"))
    rows.write.partitionBy("outcome").parquet(folder)


def _flat(c: str, kind: str) -> Column:
    """An array, or a text that spells a list, as its entries joined by |; empty entries go."""
    if kind.startswith("array"):
        return F.array_join(F.filter(c, lambda x: x != ""), "|")
    if kind != "string":
        return F.col(c)
    entries = F.regexp_extract_all(c, F.lit(r"(?:'([^']*)'|\"([^\"]*)\")"), 0)
    spelled = F.col(c).rlike(r"^\[\s*(?:(?:'[^']*'|\"[^\"]*\")\s*,?\s*)*\]$")
    return F.when(spelled, F.array_join(F.filter(F.transform(entries, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: x != ""), "|")).otherwise(F.col(c))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in the order given; nulls as empty fields, lists joined by |, also those that a text spells."""
    kinds = dict(df.dtypes)
    df.select(*[_flat(c, kinds[c]).alias(c) for c in columns]).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


EVIDENCE = {"tender_id": "tender_id", "field_name": "field_name", "value_raw": "value", "page": "page", "zone": "zone", "conf_pct": "confidence", "score": "score", "ord": "ord"}


def write_evidence(occurrences: DataFrame, path: str, buckets: int = 64) -> None:
    """The eight columns of an audit row, in files by bucket of the tender."""
    rows = occurrences.select(*[F.col(c).alias(name) for c, name in EVIDENCE.items()]).withColumn("bucket", F.pmod(F.xxhash64("tender_id"), F.lit(buckets)))
    rows.write.partitionBy("bucket").option("header", True).option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
