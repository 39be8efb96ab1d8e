"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import ann, chat, codes, jaccard, langid, licenses, packing, pii, quality, repair, spm, topk, toxicity
from changelens.llm.common import held_out


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each whole text's canonical form, and the licence that it is, if any."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("digest", licenses.digest(F.col("text")))
    return licenses.lookup(docs, licenses.catalogue(spark)).select("doc_id", "digest", "license")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole text, learned from documents that aren't held out; ``und``
    for null and empty texts and those without a letter. Rows that repeat an id have a row each."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit_on(docs, ~held_out(F.col("doc_id")))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.identify(model, F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), "x.score", "x.margin", "x.reliable")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text, how many they are, and whether decoding restores it."""
    docs = spm.round_trip(_read(spark, sf_dir, "documents"), spm.model_file())
    return docs.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "restored")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of each vector whose id is divisible by 20; see
    ``ann.search`` for null, repeated and other odd vectors, and ties."""
    return ann.search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected side of pair n; see
    ``chat.preference_turns`` for nulls and repeated turns."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.preference_turns(turns, pair=F.floor(F.col("conv_id") / 2), chosen=F.col("conv_id") % 2 == 0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are ids of the SentencePiece encoder. Null and empty texts have no piece; rows
    that repeat an id are packed each."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, length=spm.count(spm.model_file(), F.col("text"))).withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for each whole text; null and empty texts have no word and fail."""
    return quality.measure(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each whole text, null and empty ones too, learned from labels that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, _read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document by links of 90 percent of three-word shingles; empty texts link with nothing."""
    return jaccard.linked(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each whole text: counts and digest of the base ones, and all; null texts have none."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.tag(pii.fit_on(docs), F.col("text")).alias("x"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("x.base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(line(F.col("x.base")), 256).alias("base_sha256"), line(F.col("x.spans")).alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of each damaged conversation; see ``repair`` for null and repeated rows."""
    rows, copies = repair.damaged(_read(spark, sf_dir, "conversations"))
    return repair.repaired(rows, copies=copies)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each finite vector, what it loses, and the digest of the codebooks."""
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of each vector whose id is divisible by 50."""
    return topk.largest_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_sentencepiece, op4_nearest_neighbours, op5_chat_format, op6_best_fit_packing, op7_quality_rules, op8_toxicity, op9_ngram_jaccard, op10_pii, op11_conversation_repair, op12_vector_codes, op13_exact_top_k)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle_sql(), "op5_chat_format": chat.ORACLE_SQL, "op7_quality_rules": quality.ORACLE_SQL, "op11_conversation_repair": repair.ORACLE_SQL, "op12_vector_codes": codes.ORACLE_SQL, "op13_exact_top_k": topk.ORACLE_SQL}
