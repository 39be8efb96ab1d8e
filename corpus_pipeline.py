"""A training-corpus pipeline: from raw documents to packed sequences.

Each stage applies one operator to all documents that the stage before kept; its
result is written as Parquet and read again as the next one's documents.  All stages
but the last give the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import jaccard, packing, pii, quality, spm, toxicity
from changelens.llm.common import WRITTEN, materialize, release, sieve

#: Near copies share 80 percent of their five-word shingles at least.
NEAR = jaccard.Join(ngram=5, percent=80)
#: A column that holds a verdict, or a row, for a while.
VERDICT = "quality verdict of the stage"


def _columns(df: DataFrame, **new: Column) -> list[Column]:
    """All columns of a table, whatever their names, some with new values."""
    return [new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take as toxic (operator 8).

    Null and empty texts have the bias's score, which is low where toxic texts are rare.
    Each row is judged alone; an empty table gives an empty one.
    """
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model, F.col("text")) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing and repeated lines
    (operator 7); a document that has none of these keeps its text as it is.

    Null and empty texts have no word and go. Each row is judged alone.
    """
    judged = quality.measure(docs, into=VERDICT, clean=True).where(F.col(VERDICT)["kept"]).drop(VERDICT)
    return judged.select(*_columns(judged, n_chars=F.length("text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (operator 9).

    Empty texts are in no group. Rows that repeat an id are one document: of those with
    equal texts one row stays, if the document does, the one whose other columns come
    first as JSON. Rows without an id stay as they are. Which ids go, and which repeat,
    is found from ids alone, and so is which other ids a sieve takes for one of these; only
    rows whose id may be of the latter, or is repeated and stays, are shuffled, to be
    joined with ids, so copies that go are not, however many there are.
    """
    groups = jaccard.linked(docs.select("doc_id", "text"), join=NEAR)
    copies = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    again = materialize(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "repeated")
    ids = copies.unionByName(again)
    may_go = sieve(ids, "doc_id")(F.col("doc_id"))
    stay = again.join(copies, "doc_id", "left_anti").unionByName(docs.select("doc_id").where(may_go).join(ids, "doc_id", "left_anti"))
    some = docs.where(may_go).where(sieve(stay, "doc_id")(F.col("doc_id")))
    kept = docs.where(~may_go).select(*_columns(docs)).union(some.join(ids, "doc_id", "left_anti").select(*_columns(docs)))
    if again.isEmpty():
        return kept
    repeated = some.join(again.join(copies, "doc_id", "left_anti"), "doc_id", "left_semi")
    others = F.to_json(F.struct(*_columns(docs)))
    once = repeated.groupBy("doc_id", "text").agg(F.min_by(F.struct(*_columns(docs)), others).alias(VERDICT))
    return kept.unionByName(once.select(f"`{VERDICT}`.*").select(*_columns(docs)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind (operator 10).

    Null and empty texts stay as they are; equal texts are masked alike.
    """
    model = pii.fit_on(docs)
    tagged = docs.select(*_columns(docs, text=pii.mask(model, F.col("text"))))
    return tagged.select(*_columns(tagged, n_chars=F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a training sequence (operator 6).

    Lengths are ids of the SentencePiece encoder. Null and empty texts have no piece;
    rows that repeat an id are packed each.
    """
    return packing.packed(docs, length=spm.count(spm.model_file(), F.col("text"))).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Learned stages can't be stated in SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the last result stands in the shared folder.

    What a stage wrote on its way goes once its result is written, and so does the
    result of the stage before.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(WRITTEN)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=[docs])
    return docs
