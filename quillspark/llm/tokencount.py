"""Exact histogram of encoded lengths and its suffix sums, which answer totals, quantiles and truncated totals for
every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import token_counts
from .common import scratch

LIMITS = tuple(1 << k for k in range(6, 18))
_BLOCK = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. Null and empty texts have length 0; repeated
    rows count each. Documents are counted before the shuffle, so it moves a row per length and task at most."""
    return token_counts(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def answers(hist: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """For every length that occurs and every limit given, as context_limit:

    n_docs (of exactly that length), docs_above (longer ones), tokens_above (their ids), truncated_docs (= docs_above),
    kept_tokens (ids left when every document is cut at the limit), lost_tokens, share_within (documents of at most
    that length; the q-quantile is the least context_limit with share_within >= q), total_docs and total_tokens.
    An empty histogram gives rows of zeros for the limits, with share_within null.

    Suffix sums run in blocks of 1,024 lengths: sums within a block, plus the sums of the blocks above."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "n_tokens long").select("n_tokens", F.lit(0).cast("long").alias("n_docs"))
    h = hist.select("n_tokens", "n_docs").union(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = h.withColumn("block", F.expr(f"n_tokens div {_BLOCK}"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    down = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_up"),
        F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_up"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    x = h.join(blocks, "block")
    above_d = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_up")
    above_t = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)) + F.col("t_up")
    x = x.withColumns({"docs_above": above_d, "tokens_above": above_t})
    lost = F.col("tokens_above") - F.col("docs_above") * F.col("n_tokens")
    return x.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_above",
        "tokens_above",
        (F.col("total_tokens") - lost).alias("kept_tokens"),
        lost.alias("lost_tokens"),
        F.try_divide(F.col("total_docs") - F.col("docs_above"), F.col("total_docs")).alias("share_within"),
        "total_docs",
        "total_tokens",
    )


def quantiles(table: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The least context limit that holds each share of the documents: share, context_limit."""
    asked = table.sparkSession.createDataFrame([(x,) for x in shares], "share double")
    return asked.join(table, F.col("share_within") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("context_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    # written once: the suffix sums read it more than once
    return answers(scratch(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lengths"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
