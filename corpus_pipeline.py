"""Corpus pipeline: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. What a stage decides takes effect: documents without a
language, toxic documents and all but one of each near-duplicate group are gone for the stages after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, ngram, packing, toxicity
from quillspark.llm.common import discard, scratch, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null texts and texts without a letter, and all if docs has no
    text with a lang to learn from. Repeated rows are judged alike; an empty table stays empty."""
    found = langid.identify(docs, keep=True)
    return found.filter(found[found.columns[-2]] != langid.UNKNOWN).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from the labelled ones among docs. Null and empty texts stay, as does
    every document if there are not labels of both kinds. Repeated rows are judged alike; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, labels, keep=True)
    return scored.filter(scored[scored.columns[-1]] == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of similarity >= 0.8 connect, the one with the smallest id. Where an
    id has several texts each is judged for itself. Of several rows with a group's smallest id, those of one shingle set
    stand for it (the first hash), and of these the first in order of text and of all columns as JSON. Of rows without words,
    which link with nothing, one per id and text stays. Rows without id stay."""
    numbered = docs.filter("doc_id IS NOT NULL")
    again = numbered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        kept = ngram.near_duplicates(docs).filter("kept").select("doc_id")
        return numbered.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id IS NULL"))
    same, lead, text = (unused(n, docs.columns) for n in ("same", "lead", "whole_text"))
    kept = ngram.decided(docs).filter("kept AND same IS NOT NULL")
    kept = kept.groupBy("component").agg(F.min("same").alias(same), F.min("doc_id").alias(lead)).drop("component")
    keyed = ngram.hashed(numbered.withColumn(text, F.col("text").cast("string")), text, adds=f"{same} binary")
    stands = [keyed["doc_id"].cast("long") == kept[lead], keyed[same] == kept[same]]
    worded = keyed.filter(F.col(same).isNotNull()).join(kept, stands, "left_semi")
    whole = F.struct(*docs.columns)  # columns of any type: only their JSON is compared
    order = F.struct(text, F.to_json(whole))
    one = lambda rows, *keys: rows.groupBy(*keys).agg(F.min_by(whole, order).alias("row")).select("row.*")
    return one(worded, "doc_id", same).union(one(keyed.filter(F.col(same).isNull()), "doc_id", text)).union(docs.filter("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 ids: one row per piece. A null or empty text is its end id alone,
    repeated rows are packed each, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", packed)]

#: No SQL: no stage but the filters around them can be said in SQL. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
