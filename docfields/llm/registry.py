"""Queries of this subpackage over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.oracles import ORACLES  # noqa: F401  the entry module takes it from here
from docfields.packaging import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.ngram_join import near_copies

    return near_copies(table(spark, folder, "documents"))


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.top_k import integers, top_k

    vectors = integers(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.near_vectors import near_copies

    return near_copies(table(spark, folder, "embeddings"))


#: What the mixing query and stage aim at: half the tokens of poor documents and a tenth of toxic ones, all of the others. A target of 0 cannot be met
#: while every document has a posterior above 0, and takes most good documents with it.
MIX = {"poor": 0.5, "toxic": 0.1}


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.mixing import label_domains, mix

    rates, domains = mix(table(spark, folder, "documents"), label_domains(table(spark, folder, "labels")), MIX)
    return rates.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.language import identify

    return identify(table(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.substring_dedup import drop_repeats

    return drop_repeats(table(spark, folder, "documents"))


def op7_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.dac import read_documents, write_ids
    from docfields.llm.tokens import vocabulary

    return read_documents(write_ids(table(spark, folder, "documents"), vocabulary()))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.html_main import main_text

    return main_text(table(spark, folder, "pages"))


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.bpe import encode_and_decode
    from docfields.llm.tokens import vocabulary

    found = encode_and_decode(table(spark, folder, "documents"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.quality import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.resample import draw

    return draw(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_top_k, op3_embedding_near_dedup, op4_mixing, op5_language_id, op6_substring_dedup, op7_token_binary, op8_toxicity, op9_html_extraction,
        op10_bpe_round_trip, op11_quality, op12_prefix_trie, op13_importance_resampling,
    )
}
