"""A corpus from quality filtering to packed sequences.

Each stage reads what the one before it wrote.  Rejected rows are taken out by
their row key: a bitmap of the rejected keys lets most rows pass without a
shuffle, only those that hit it are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup
from gridloom.llm.common import read_table, row_key, written
from gridloom.llm.keyfilter import key_split


def _keyed(docs: DataFrame) -> DataFrame:
    """(uid, row): rows whole in one column, so that no name of theirs meets one of ours."""
    return docs.select(row_key().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose key (uid) and id are in ``rejected`` (doc_id, uid)."""
    rejected = written(rejected.select(F.col("doc_id").cast("long").alias("gone_id"), "uid").distinct(), "pipeline-rejected")
    hit, rest = key_split(_keyed(docs), rejected.select("uid"))
    gone = rejected.withColumnRenamed("uid", "gone_uid")
    same = (F.col("uid") == F.col("gone_uid")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id"))
    return rest.union(hit.join(gone, same, "left_anti")).select("row.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; rows of equal id and text share their fate."""
    scores = quality_classifier.quality_scores(docs, read_table(spark, sf_dir, "labels"))
    return _without(docs, scores.filter("predicted = 0").select("doc_id", F.col("row_key").alias("uid")))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the base rules and to their group's thresholds."""
    return _without(docs, quality_rules.quality_rules(docs).filter("NOT kept").select("doc_id", F.col("row_key").alias("uid")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group; rows with a null id stay.

    Repeated rows, equal in id and text, are one document: one of them stays.
    """
    groups = jaccard_join.near_duplicate_groups(docs)
    out = _without(docs, groups.filter("doc_id <> component_id").select("doc_id", F.col("row_key").alias("uid")))
    again = written(docs.filter("doc_id IS NOT NULL").select(row_key().alias("uid")).groupBy("uid").count().filter("count > 1").select("uid"), "pipeline-repeated")
    if again.isEmpty():
        return out
    hit, rest = key_split(_keyed(out), again)
    return rest.union(hit.dropDuplicates(["uid"])).select("row.*")


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that a smaller id has too.

    Cuts are by byte; what a cut leaves of a character is dropped.  A document
    of which nothing is left stays, with an empty text.
    """
    base, cut = suffix_dedup.repeated_passages(docs, texts=True)
    cut = cut.select("row_key", "kept_text").union(base.filter("is_copy").select("row_key", F.lit("")))
    cut = written(cut.groupBy(F.col("row_key").alias("uid")).agg(F.first("kept_text").alias("kept_text")), "pipeline-cut")
    hit, rest = key_split(_keyed(docs), cut.select("uid"))
    whole = F.coalesce("kept_text", "row.text")
    row = F.col("row").withField("text", whole)
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        row = row.withField("n_chars", F.length(whole).cast(docs.schema["n_chars"].dataType))
    changed = hit.join(cut, "uid", "left").select("uid", row.alias("row"))
    return rest.union(changed).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of bounded length."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("best-fit packing", packing_stage),
]

#: Not expressible in SQL: trained scores and tokenizer ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
