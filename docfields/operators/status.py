"""Statuses, roll-ups, review and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import scalars as S

STATUSES = ("OK", "OK_FALLBACK", "NOT_APPLICABLE", "MISSING")


def every(docs: DataFrame, names: list[str]) -> DataFrame:
    """A row for each document and name: the names are a list of the program's, so no join makes the grid."""
    return docs.select("*", F.explode(F.array(*map(F.lit, names))).alias("field_name"))


def classify_status(values: DataFrame, docs: DataFrame, expected: list[str], not_applicable: Column) -> DataFrame:
    """A status for every expected key (field_name) of every document: not applicable, missing, found by fallback or found."""
    grid = every(docs, expected)
    joined = grid.join(values, ["doc_id", "field_name"], "left")
    status = F.when(F.coalesce(not_applicable, F.lit(False)), "NOT_APPLICABLE").when(S.missing(F.col("value")), "MISSING").when(F.col("source") == "fallback", "OK_FALLBACK").otherwise("OK")
    return joined.select("doc_id", "field_name", "value", status.alias("status"))


# fixed values: spellings of nothing in a record, keys that depend on others
NOTHING = ("", "NA", "N/A")
FINANCIAL = ("avg_annual_turnover", "working_capital", "solvency_certificate", "net_worth")
PHYSICAL = ("physical_docs_deadline", "docket_slip_upload", "physical_docs_uploaded", "courier_provider", "courier_docket_no", "courier_delivery_time")
DOCUMENTS = tuple(f"doc_{k}" for k in range(1, 10))
RECORD = (
    "pbg_percentage", "pbg_required", "pbg_duration", "sd_percentage", "sd_mode", "sd_duration", "sd_required", *(f"{f}_{part}" for f in FINANCIAL for part in ("type", "value")),
    "delivery_time_supply", "delivery_time_installation", "te_recommendation", "te_rejection_reason", "pre_bid_meeting", "physical_docs_required", *PHYSICAL,
    *(f"client_{part}_{k}" for k in (1, 2, 3) for part in ("name", "email", "phone")), "schedule_1_details", "schedule_2_details", "schedule_3_details", *DOCUMENTS, "emd_amount", "payment_terms_supply",
)


def dependencies(has: dict[str, Column]) -> list[tuple[Column, tuple[str, ...]]]:
    """Rules (when, keys that do not apply then) over a record's columns."""
    none = lambda k, *more: F.coalesce(F.trim(has[k]).isin(*NOTHING, *more), F.lit(True))
    low = lambda k: F.lower(F.coalesce(has[k], F.lit("")))
    guaranteed = F.when(~none("pbg_percentage"), ~none("pbg_percentage", "Not Found", "No")).otherwise(~none("pbg_required", "Not Found", "No"))
    no_deposit = guaranteed & none("sd_percentage", "Not Found", "₹0.00", "0.0", "0", "0%", "0.00%")
    exempt = F.lit(False)
    for f in FINANCIAL:
        exempt = exempt | low(f"{f}_type").rlike("not applicable|exempt")
    rules = [
        (no_deposit, ("sd_percentage", "sd_duration")),
        (no_deposit & none("sd_mode"), ("sd_mode",)),
        (exempt, tuple(f"{f}_{part}" for f in FINANCIAL for part in ("type", "value"))),
        (none("delivery_time_installation", "Not Applicable"), ("delivery_time_installation",)),
        (~F.contains(low("te_recommendation"), F.lit("reject")), ("te_rejection_reason",)),
        (low("pre_bid_meeting").isin("", "na", "n/a") | F.contains(low("pre_bid_meeting"), F.lit("no pre-bid")), ("pre_bid_meeting",)),
        (low("physical_docs_required").isin("no", "na", "n/a", "not required"), PHYSICAL),
    ]
    rules += [(none(f"client_name_{k}"), tuple(f"client_{part}_{k}" for part in ("name", "email", "phone"))) for k in (2, 3)]
    return rules + [(none(k), (k,)) for k in ("schedule_2_details", "schedule_3_details", *DOCUMENTS)]


def record_status(records: DataFrame, keys: tuple[str, ...] = RECORD) -> DataFrame:
    """doc_id, field_name, value and status of each key of wide records: not applicable by the rules above, missing, found by fallback or found.

    Columns that records lack count as null; ``fallback`` (array of keys) names values that a fallback found. No join: the grid is an array."""
    has = {k: F.col(k) if k in records.columns else F.lit(None).cast("string") for k in RECORD}
    rules = dependencies(has)
    fallback = F.coalesce("fallback", F.array().cast("array<string>")) if "fallback" in records.columns else F.array().cast("array<string>")

    def status(k: str) -> Column:
        out = F.lit(False)
        for when, of in rules:
            out = out | F.coalesce(when, F.lit(False)) if k in of else out
        return F.when(out, "NOT_APPLICABLE").when(S.missing(has[k]) | (has[k] == "⚠️ MISSING"), "MISSING").when(F.array_contains(fallback, F.lit(k)), "OK_FALLBACK").otherwise("OK")

    rows = F.array(*[F.struct(F.lit(k).alias("field_name"), has[k].alias("value"), status(k).alias("status")) for k in keys])
    return records.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


# fixed values: phrases that decide, and what the summary says
SITE_VISITS = (
    (r"(?i)mandatory\s+site\s+visit|site\s+visit\s+is\s+mandatory|must\s+visit\s+site\s+and\s+obtain\s+certificate|site\s+visit\s+certificate\s+mandatory", "Yes (Mandatory site inspection and certificate required prior to bidding)"),
    (r"(?i)(?:vendor|bidder|contractor)\s+(?:has\s+visited|shall\s+be\s+deemed\s+to\s+have\s+visited|is\s+advised\s+to\s+visit)\s+(?:the\s+)?(?:work\s+sites?|site)", "No / Self-Certification (Deemed site visit acknowledgment in SCC; no mandatory scheduled visit)"),
    (r"(?i)site visit", "Not mandatory / Self-acquaintance (Bidder advised to inspect site before bidding)"),
)
CERTIFYING = "oem|iso|approval|experience|turnover|pan|gst"


def readiness(records: DataFrame) -> DataFrame:
    """The eleven decisions of a bidder's summary from wide records with their text; records hold nulls or NA where nothing was found."""
    text = F.lower(F.coalesce("text", F.lit("")))
    or_na = lambda k, other="NA": F.coalesce(F.col(k), F.lit(other))
    meeting = F.when(~or_na("pre_bid_meeting").isin("", "NA", "⚠️ MISSING"), F.col("pre_bid_meeting"))
    order = F.when(~or_na("order_value_1").isin("NA", "⚠️ MISSING", "₹0.00"), F.col("order_value_1"))
    years = F.when(or_na("experience_years") != "NA", F.concat(F.lit("Exp: "), "experience_years", F.lit(" Yrs"))).otherwise("Technical BEC defined in ATC")
    turnover = or_na("avg_annual_turnover_value")
    no_finance = F.contains(F.lower(turnover), F.lit("not applicable")) | turnover.isin("₹0.00", "0")
    asked = F.array(
        F.when(F.col("maf_required").isin("Yes", "Yes — Project Specific"), "OEM Authorization Certificate"),
        F.when(F.contains(text, F.lit("local content")) | (or_na("mii_preference") == "Yes"), "Class 1/2 Local Content Certificate"),
        *[F.when(~or_na(k, "").isin("", "NA", "None", "⚠️ MISSING") & F.lower(k).rlike(CERTIFYING), F.col(k)) for k in DOCUMENTS],
    )
    certificates = F.array_join(F.slice(F.array_distinct(F.array_compact(asked)), 1, 4), ", ")
    auction = F.lower(or_na("reverse_auction_applicable", "No")).rlike("yes|true")
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return records.select(
        "doc_id",
        F.coalesce(*[F.when(text.rlike(p), said) for p, said in SITE_VISITS], F.lit("Not specified")).alias("site_visit"),
        F.coalesce(F.concat(meeting, F.lit(" | Written queries accepted as per tender timeline")), F.lit("None specified / No pre-bid meeting scheduled")).alias("pre_bid"),
        join("Pre-Bid: ", F.coalesce(meeting, F.lit("None")), "  →  Bid Due: ", or_na("bid_due"), "  →  Physical Docs: ", or_na("physical_docs_deadline"), "  →  Clarifications: ", F.when(text.rlike("2 days|two packet"), "2 Days").otherwise("Standard")).alias("timeline"),
        join("EMD: ", or_na("emd_amount", "₹0.00"), " (via ", or_na("emd_mode"), ")  |  PBG: ", or_na("pbg_percentage"), " for ", or_na("pbg_duration")).alias("capital"),
        join(years, F.coalesce(F.concat(F.lit(" (Min PO Value: "), order, F.lit(")")), F.lit("")), "  |  ", F.when(no_finance, "Financial BEC: Not Applicable (Exempted)").otherwise(join("Turnover: ", turnover, " (", or_na("avg_annual_turnover_type", "Bidder"), ")"))).alias("bec"),
        F.when(certificates != "", certificates).otherwise("Standard GeM Seller profile & declarations").alias("certifications"),
        join("Supply Delivery: ", or_na("delivery_time_supply"), "  |  Installation/Completion: ", or_na("delivery_time_installation")).alias("delivery"),
        F.when(text.rlike("buyback|buy back"), "Yes — Existing equipment buyback & site removal required").otherwise("No buyback scope").alias("buyback"),
        F.when(auction, "Yes (Bid to Reverse Auction enabled — dynamic pricing exposure)").otherwise("No (Direct item-wise / schedule-wise evaluation without Reverse Auction)").alias("reverse_auction"),
        F.lit("Standard GeM/GAIL Terms (Zero deviation allowed on EMD, PBG, BEC, Delivery)").alias("disqualifiers"),
        join("LD / PRS: ", or_na("ld_percentage", "0.5% per week"), "  |  Max Penalty Cap: ", or_na("max_ld_percentage", "5%")).alias("penalty_risk"),
    )


def status_rollup(statuses: DataFrame) -> DataFrame:
    """Counts of each status by document, and the missing fields in order."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    absent = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "MISSING", F.col("field_name")))), ", ")
    return statuses.groupBy("doc_id").agg(*counts, absent.alias("missing_fields"))


def to_wide(fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A column for each name; the list is given, so no pass over the data finds it."""
    return fields.groupBy(key).pivot("field_name", names).agg(F.min("value"))


def sync_back(wide: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """Wide values back in rows, but for verified ones; N/A becomes NOT_APPLICABLE; absent rows are added."""
    long = wide.unpivot("doc_id", names, "field_name", "new_value")
    both = rows.join(long, ["doc_id", "field_name"], "full_outer")
    keep = (F.coalesce(F.col("status"), F.lit("")) == "verified") | F.col("new_value").isNull()
    value = F.when(keep, F.col("value")).otherwise(F.col("new_value"))
    status = F.when(keep, F.col("status")).when(F.col("new_value").isin("N/A", "NA"), "NOT_APPLICABLE").when(F.col("status").isNull(), "added").otherwise("synced")
    return both.select("doc_id", "field_name", value.alias("value"), status.alias("status"))


def issue_count(fields: DataFrame, mentions: DataFrame | None = None, least: int = 70) -> DataFrame:
    """Critical missing fields and found ones below the confidence, plus unresolved mentions (doc_id), by document."""
    issue = (F.col("critical") & S.missing(F.col("value"))) | (~S.missing(F.col("value")) & (F.col("conf_pct") < least))
    out = fields.groupBy("doc_id").agg(F.count_if(issue).alias("n"))
    if mentions is None:
        return out.select("doc_id", F.col("n").alias("issues"))
    more = mentions.groupBy("doc_id").agg(F.count("*").alias("m"))
    return out.join(more, "doc_id", "left").select("doc_id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("issues"))


def coverage_confidence(fields: DataFrame) -> DataFrame:
    """Mean confidence of found fields times the share found, in millionths so that it is exact."""
    found = F.count_if(~S.missing(F.col("value_raw"), "basic"))
    total = F.sum(F.when(~S.missing(F.col("value_raw"), "basic"), F.col("conf_pct")))
    # mean * found / total = sum / total
    return fields.groupBy("tender_id").agg(found.alias("found"), F.count("*").alias("total"), F.floor(F.coalesce(total, F.lit(0)) * 10_000 / F.count("*")).alias("coverage"))


def review_log(events: DataFrame) -> DataFrame:
    """State of each job from its log: the last state, edits, and whether a completion came after the last edit."""
    last = lambda state: F.max(F.when(F.col("state") == state, F.struct("ts", "event_id")))
    out = events.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("state") == "edited").alias("edits"), last("completed").alias("c"), last("edited").alias("e"))
    done = F.col("c").isNotNull() & (F.col("e").isNull() | (F.col("c") > F.col("e")))
    return out.select("job_id", "state", "edits", F.coalesce(done, F.lit(False)).alias("verified"))


def apply_review_log(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Fields (doc_id, field_name, value, status, conf_pct) after a log (doc_id, field_name, action, value, reviewer, ts, event_id) in the order of (ts, event_id).

    An edit sets the value and the status edited, a verify the status verified; a later complete (field_name null) of the document verifies what is
    extracted or edited by then. reviewer is who acted last on the field or completed it. Fields without events stay; events of unknown fields
    and documents do nothing. A null value of an edit empties the field."""
    at = F.struct("ts", "event_id")
    own = events.where("field_name is not null and action in ('edit', 'verify')").groupBy("doc_id", "field_name").agg(
        F.max_by(F.struct("value"), F.when(F.col("action") == "edit", at)).alias("edit"), F.max_by(F.struct("action", "reviewer", at.alias("at")), at).alias("last")
    )
    done = events.where("action = 'complete'").groupBy("doc_id").agg(F.max_by(F.struct("reviewer", at.alias("at")), at).alias("done"))
    joined = fields.join(own, ["doc_id", "field_name"], "left").join(done, "doc_id", "left")
    state = F.when(F.col("last.action") == "edit", "edited").when(F.col("last.action") == "verify", "verified").otherwise(F.col("status"))
    closed = F.col("done").isNotNull() & (F.col("last").isNull() | (F.col("done.at") > F.col("last.at"))) & state.isin("extracted", "edited")
    return joined.select(
        "doc_id", "field_name", F.when(F.col("edit").isNotNull(), F.col("edit.value")).otherwise(F.col("value")).alias("value"), F.when(closed, "verified").otherwise(state).alias("status"),
        F.when(F.col("edit").isNotNull(), 100).otherwise(F.col("conf_pct")).cast("long").alias("conf_pct"), F.when(closed, F.col("done.reviewer")).otherwise(F.col("last.reviewer")).alias("reviewer"),
    )


def correction_memory(corrections: DataFrame, k: int = 5) -> DataFrame:
    """The latest correction of each field and anchor, then each field's k surest, later ones first."""
    anchor = F.substring("anchor_text", 1, 100)
    latest = Window.partitionBy("field_key", "anchor").orderBy(F.desc("ts"), F.desc("conv_id"))
    best = Window.partitionBy("field_key").orderBy(F.desc("conf_pct"), F.desc("ts"), F.desc("conv_id"), "anchor")
    # a field's ranking keeps k rows in each task before rows move (group limit)
    one = corrections.withColumn("anchor", anchor).withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("field_key", "rank", "anchor", "value", "conf_pct", "ts")


def upsert(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of updates replace or add to target's; nulls in an update overwrite; columns that are not listed stay."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("updated"))
    both = target.join(u, key, "full_outer")
    return both.select(key, *[F.when(F.col("updated"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns if c != key], F.coalesce("updated", F.lit(False)).alias("updated"))


def gold_comparison(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """MATCH, MISMATCH or MISSING of each expected value, on trimmed text."""
    joined = gold.join(predictions, ["doc_id", "field_name"], "left")
    outcome = F.when(F.col("value").isNull(), "MISSING").when(F.trim("value") == F.trim("expected"), "MATCH").otherwise("MISMATCH")
    return joined.select("doc_id", "field_name", "expected", "value", outcome.alias("outcome"))


CRITERIA = "custom_eligibility_criteria"


def anchor_check(predictions: DataFrame, sources: DataFrame, before: int = 100, after: int = 150) -> DataFrame:
    """Predictions (doc_id, field_name, value, is_flag) with supported and snippet: whether their document's text (doc_id, text) bears them out.

    Flags need no support. A number must occur, by its first eight characters. Text must occur whatever the case and white space, or else all
    of its first four words over two letters. Criteria with numbers need 60 % of the different ones. Snippet: the text around the
    place; null if unsupported or a flag. Missing values, and those of documents without a text, are not supported.

    Texts are folded before the join, once a document and not once a mention in the rules. They are long and of unknown size, so they
    are merged and never broadcast."""
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    folded = sources.select("doc_id", fold(F.col("text")).alias("_text")).hint("merge")
    value, text, low = F.col("_value"), F.coalesce("_text", F.lit("")), F.lower(F.coalesce("_text", F.lit("")))
    number = F.regexp_replace(value, "[%₹,]", "")
    place = lambda part: F.call_function("instr", low, F.lower(part))
    numbers = F.array_distinct(F.regexp_extract_all(value, F.lit(r"(\d+(?:[.,]\d+)?)"), 1))
    occurring = F.filter(numbers, lambda n: F.contains(text, n))
    words = F.slice(F.filter(F.regexp_extract_all(F.lower(value), F.lit(r"([\w]+)"), 1), lambda w: F.length(w) > 2), 1, 4)
    by_words = F.when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w)), place(F.get(words, F.lit(0))))
    whole = F.when((F.length(value) > 2) & (place(value) > 0), place(value))
    share = F.when(F.size(occurring) * 10 >= F.size(numbers) * 6, place(F.get(occurring, F.lit(0))))
    at = (
        F.when(S.missing(F.col("value")) | (value == "null"), None)
        .when(F.col("field_name").eqNullSafe(CRITERIA) & (F.size(numbers) > 0), share)
        .when(number.rlike(r"^\d[\d.]*$") & (place(F.substring(number, 1, 8)) > 0), place(F.substring(number, 1, 8)))
        .otherwise(F.coalesce(whole, by_words))
    )
    flag = F.coalesce("is_flag", F.lit(False))
    joined = predictions.withColumn("_value", fold(F.col("value"))).join(folded, "doc_id", "left").withColumn("at", F.when(~flag, at))
    start = F.greatest(F.lit(1), F.col("at") - before)
    snippet = F.when(F.col("at") > 0, F.substring(text, start, F.col("at") + after - start + F.length(value)))
    return joined.select(*predictions.columns, (flag | F.coalesce(F.col("at") > 0, F.lit(False))).alias("supported"), snippet.alias("snippet"))


def batch_audit(statuses: DataFrame) -> DataFrame:
    """Documents in all, with no failure, with any missing and with any fallback."""
    by_doc = statuses.groupBy("doc_id").agg(F.count_if(F.col("status") == "MISSING").alias("m"), F.count_if(F.col("status") == "OK_FALLBACK").alias("f"))
    return by_doc.agg(F.count("*").alias("documents"), F.count_if((F.col("m") == 0) & (F.col("f") == 0)).alias("clean"), F.count_if(F.col("m") > 0).alias("any_missing"), F.count_if(F.col("f") > 0).alias("any_fallback"))
