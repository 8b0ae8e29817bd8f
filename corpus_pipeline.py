"""A corpus from documents to tokens: language ID, near copies, repeated passages, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a stage's rows to the shared folder and reads them
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import bpe, language, mixing, ngram_join, substring_dedup
from docfields.llm.registry import MIX, table
from docfields.llm.tables import with_hot, written
from docfields.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is further off than this is in none of the learned ones.
LEAST_SCORE = 0.25
#: Rows of document ids that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), or like none of the languages, go.

    Each row is judged by its text alone, so repeated rows and rows without a doc_id stay or go like others. An empty table, or one
    without a language to learn from, gives an empty one. Further columns go."""
    profiles = language.learn(language.learned_from(docs))
    found = language.predict(docs, profiles, *COLUMNS[1:])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that with the smallest doc_id, rows without one last.

    Rows are told apart by all their columns, not by doc_id: rows that share a doc_id but not a group both stay, and of rows alike in
    everything one stays. Null and empty texts are linked with nothing and stay. An empty table gives an empty one. Further columns go."""
    keyed = docs.select(*COLUMNS).withColumn("own", F.xxhash64(*COLUMNS))
    found = written(ngram_join.near_copies(keyed, keep=("own",)).where("component is not null").groupBy("component", "own").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times")))
    first = written(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("first"), F.count("*").alias("n")))
    told = written(with_hot(found, first, "component", found.count()).select("own", (F.col("own") == F.col("first.own")).alias("stays"), "times").where("not stays or times > 1"))
    gone, repeated = (_small(told.where(c).select("own")) for c in ("not stays", "stays"))
    kept = keyed.join(gone, "own", "left_anti")
    once = kept.join(repeated, "own", "left_semi").dropDuplicates(["own"])
    return kept.join(repeated, "own", "left_anti").unionByName(once).select(*COLUMNS)


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if so few that it may be."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur more than once go; documents of which nothing stays, null and empty texts among them, go too.

    A row's passages also count as repeated by rows of the same doc_id or of none. An empty table gives an empty one. Further columns go."""
    cut = substring_dedup.drop_repeats(docs, with_text=True, keep=("lang", "source"))
    return cut.where("kept != ''").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say: a row comes back as often as its rate, rounded by a hash of its row.

    Null and empty texts, repeated rows and rows without a doc_id have rates like others. An empty table gives an empty one, and without labels
    all rows stay. Further columns go."""
    return mixing.resample(docs.select(*COLUMNS), mixing.label_domains(table(spark, sf_dir, "labels")), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the text that the ids decode to, row for row: null and empty texts have no ids."""
    found = bpe.encode_and_decode(docs, vocabulary(), keep=("lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language ID", language_id), ("near copies", near_copies), ("repeated passages", repeated_passages), ("mixing", mixed), ("BPE", tokens)]

#: Trained models and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
