"""BM25 scorers. All take term rows and give (keys, score), for many queries at once where query_id is a key.

tf: (key, term, tf, dl); df: (term, df); query: (term, qtf[, query_id, weight]); stats: one row (n, avgdl).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import bounded

K1, B, EPSILON, DELTA_L, DELTA_PLUS = 1.5, 0.75, 0.25, 0.5, 1.0
#: Weights of the signals of the composite score.
WEIGHTS = {"stem": 1.0, "direct": 0.85, "concept": 0.60, "cooc": 0.45, "cosine": 0.30, "structure": 0.30, "proximity": 0.20, "header": 0.15}


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.when(avgdl > 0, avgdl).otherwise(1.0)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / norm))


def bm25(tf: DataFrame, df: DataFrame, query: DataFrame, stats: DataFrame, keys: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """Okapi with the smoothed idf that is never negative. A term repeated in the query counts again; unknown terms and
    texts without tokens score nothing. With a weight column, terms count by it. The query terms are broadcast if they are
    few (bounded); the statistics are one row."""
    weight = F.col("weight") if "weight" in query.columns else F.lit(1.0)
    small = F.broadcast if bounded(query) else lambda d: d
    known = small(query.join(small(df.join(small(query.select("term").distinct()), "term", "left_semi")), "term"))
    x = tf.join(known, "term").crossJoin(F.broadcast(stats))
    x = x.filter("tf > 0 AND df > 0 AND dl > 0")
    part = weight * F.col("qtf") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return x.groupBy(*keys).agg(F.sum(part).alias("score"))


def rank_family(docs: DataFrame, tf: DataFrame, df: DataFrame, query: DataFrame, stats: DataFrame, kind: str, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """Every document's score in the in-memory BM25 family: okapi (negative idf becomes EPSILON times the mean idf of
    the vocabulary), l and plus (terms that a document lacks count too). docs: (key, dl)."""
    known = df.crossJoin(F.broadcast(stats.select("n")))
    if kind == "okapi":
        raw = known.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        mean = raw.agg(F.avg("idf").alias("mean"))
        terms = raw.join(F.broadcast(query), "term").crossJoin(F.broadcast(mean))
        terms = terms.select("term", "qtf", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    else:
        half = 0.5 if kind == "l" else 0.0
        terms = known.join(F.broadcast(query), "term").select("term", "qtf", (F.log(F.col("n") + 1) - F.log(F.col("df") + half)).alias("idf"))
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)

    def part(t: Column) -> Column:
        spread = 1 - b + b * F.col("dl") / avgdl
        if kind == "l":
            ctd = t / spread + DELTA_L
            return (k1 + 1) * ctd / (k1 + ctd)
        return t * (k1 + 1) / (t + k1 * spread) + (DELTA_PLUS if kind == "plus" else 0.0)

    # a term that a document lacks adds the same to every document: only the hits are joined
    none = {"okapi": 0.0, "l": (k1 + 1) * DELTA_L / (k1 + DELTA_L), "plus": DELTA_PLUS}[kind]
    base = terms.agg(F.coalesce(F.sum(F.col("qtf") * F.col("idf")) * none, F.lit(0.0)).alias("base"))
    hits = tf.select(key, "term", "tf").join(F.broadcast(terms), "term").join(docs.select(key, "dl"), key).crossJoin(F.broadcast(stats.select("avgdl")))
    more = hits.groupBy(key).agg(F.sum(F.col("qtf") * F.col("idf") * (part(F.col("tf")) - none)).alias("more"))
    return docs.select(key).join(more, key, "left").crossJoin(F.broadcast(base)).select(key, (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("score"))


def composite(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """signals: key columns and any of the columns named in WEIGHTS (numbers or flags); adds score."""
    w = WEIGHTS | (weights or {})
    return signals.withColumn("score", sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w[c] for c in w if c in signals.columns), F.lit(0.0)))
