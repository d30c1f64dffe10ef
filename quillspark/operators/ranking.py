"""After scoring: top-k, normalising, near-duplicate removal, best per document, adjacency, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import token_set

#: jaccard_pairs: hash buckets that tokens are counted in, and sets up to which a bucket's tokens are keys by themselves.
BUCKETS, RARE = 1 << 16, 16


def top_k(scores: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return scores.orderBy(F.desc("score"), key).limit(k)


def top_k_each(scores: DataFrame, k: int, group: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The k best of every query."""
    w = W.partitionBy(group).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def normalised(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Min-max of score over the rows given (by group); all equal: 1 if above 0, else 0. The rows are a ranking's
    top-k, so one window is small."""
    w = W.partitionBy(*(group or []))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    flat = F.when(hi > 0, 1.0).otherwise(0.0)
    return scores.withColumn("norm", F.when(hi - lo < 1e-12, flat).otherwise((F.col("score") - lo) / F.when(hi - lo < 1e-12, 1.0).otherwise(hi - lo)))


def greedy_dedup(ranked: DataFrame, text: str, key: str = "doc_id", threshold: float = 0.70, limit: int = 300, head: int | None = None) -> DataFrame:
    """Walk the best `limit` rows down and drop each that resembles one kept: (key, position). The limit is the operator's
    own (a reranker's candidate list). Words are of the whole texts, or of their first `head` letters: they meet in a join,
    and only rows' numbers in one array."""
    best = ranked.orderBy(F.desc("score"), key).limit(limit).select(key, "score", token_set(F.col(text), head).alias("t"))
    row = F.struct(F.row_number().over(W.orderBy(F.desc("score"), key)).alias("i"), F.col(key).alias("k"), F.size("t").alias("n"))
    # every row has the empty word besides, so that it meets itself; few rows, but as many words as texts have: not broadcast
    each = best.select(row.alias("r"), "t").select("r", F.explode(F.concat("t", F.array(F.lit("")))).alias("token"))
    pairs = each.toDF("a", "token").hint("merge").join(each.toDF("b", "token"), "token").filter("a.i <= b.i").groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("both"))
    like = F.try_divide("both", F.col("a.n") + F.col("b.n") - F.col("both")) >= threshold
    before = pairs.groupBy("b").agg(F.collect_list(F.when(F.expr("a.i < b.i") & like, F.col("a.i"))).alias("before"))
    rows = before.agg(F.sort_array(F.collect_list(F.struct("b.i", "b.k", "before"))).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()
    kept = F.aggregate("rows", F.array().cast(kind), lambda acc, r: F.when(F.exists(acc, lambda o: F.array_contains(r["before"], o["i"])), acc).otherwise(F.concat(acc, F.array(r))))
    return rows.select(F.posexplode(kept).alias("position", "r")).select(F.col("r.k").alias(key), "position")


def jaccard_pairs(docs: DataFrame, text: str, key: str = "doc_id", threshold: float = 0.70, head: int | None = None) -> DataFrame:
    """(id_a < id_b, similarity) of all pairs of different token sets that resemble each other. Rows with one set are one
    class, named by the smallest key; empty sets resemble nothing. Candidates are verified on the sets."""
    sets = docs.select(key, F.array_sort(token_set(F.col(text), head)).alias("t")).filter(F.size("t") > 0)
    classes = sets.groupBy("t").agg(F.min(key).alias("id")).select("id", "t")
    pairs = jaccard_candidates(classes, threshold)
    x = pairs.join(classes.toDF("id_a", "t_a"), "id_a").join(classes.toDF("id_b", "t_b"), "id_b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    x = x.select("id_a", "id_b", both.alias("both"), (F.size("t_a") + F.size("t_b")).alias("sizes"))
    return x.filter(F.col("both") * (1 + threshold) >= threshold * F.col("sizes") - 1e-9).select("id_a", "id_b", F.round(F.col("both") / (F.col("sizes") - F.col("both")), 6).alias("similarity"))


def jaccard_candidates(classes: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(id_a < id_b) of all pairs of classes (id, t: set of tokens) that can resemble each other, and few others.

    Two sets of n and m tokens with similarity >= x share, in any one order of all tokens, their first common token within
    the first n - ceil(x n) + 1 of the one and likewise of the other, their second within one more. The order is by how
    frequent a token's hash bucket is (BUCKETS counts, broadcast), so it needs no table of tokens. A first common token
    whose bucket is rare is a key by itself; of others a key has two, so that few classes share one. What is left after a
    key's tokens bounds how many two sets can share."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")
    met = classes.select(F.explode("t").alias("token")).groupBy(bucket).agg(F.count(F.lit(1)).alias("c"))
    spark = classes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # dealt by id once: a class's tokens meet again without another shuffle
    each = classes.repartition(tasks, "id").select("id", F.size("t").alias("n"), F.explode("t").alias("token"))
    each = each.select("id", "n", F.xxhash64("token").alias("h"), bucket).join(F.broadcast(met), "bucket")
    order = each.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("p"))
    least = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    order = order.select("id", "n", least.alias("least"), F.slice("p", F.lit(1), F.col("n") - least + 2).alias("p"))
    left = lambda i, common: (F.col("n") - i + common - 1).alias("left")  # noqa: E731  i from 0: the key's tokens and all that follow
    alone = F.transform("p", lambda x, i: F.when((i <= F.col("n") - F.col("least")) & ((x["c"] <= RARE) | (F.col("least") <= 1)), F.struct(x["h"].alias("k"), left(i, 1))))
    two = F.transform("p", lambda x, i: F.transform("p", lambda y, j: F.when((i < j) & (x["c"] > RARE), F.struct(F.xxhash64(x["h"], y["h"]).alias("k"), left(j, 2)))))
    keyed = order.select("id", "n", F.explode(F.filter(F.concat(alone, F.flatten(two)), lambda x: x.isNotNull())).alias("x")).select("id", "n", "x.k", "x.left")
    a, b = keyed.toDF("id_a", "n_a", "k", "left_a"), keyed.toDF("id_b", "n_b", "k", "left_b")
    sized = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    enough = F.least("left_a", "left_b") * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9
    return a.join(b, "k").filter((F.col("id_a") < F.col("id_b")) & sized & enough).select("id_a", "id_b").distinct()


def best_per_document(scores: DataFrame, doc: str, key: str) -> DataFrame:
    w = W.partitionBy(doc).orderBy(F.desc("score"), key)
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def adjacency_boost(results: DataFrame, boost: float = 0.02) -> DataFrame:
    """results (chunk_id, prev_id, next_id, norm): a boost, to 1 at most, where a neighbour is among the results."""
    ids = results.select(F.col("chunk_id").alias("_n")).distinct()
    near = results.select("chunk_id", F.explode(F.array("prev_id", "next_id")).alias("_n")).join(ids, "_n", "left_semi").select("chunk_id").distinct().withColumn("_near", F.lit(True))
    return results.join(near, "chunk_id", "left").withColumn("norm", F.when(F.col("_near"), F.least(F.lit(1.0), F.col("norm") + boost)).otherwise(F.col("norm"))).drop("_near")


def facets(docs: DataFrame, columns: list[str], limit: int | None = 25) -> DataFrame:
    """(facet, value, n) of the columns' values, without null and empty ones, the most frequent of each facet."""
    x = docs.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "facet", "value").filter("value IS NOT NULL AND value <> ''")
    counts = x.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        return counts
    w = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def facets_by_grouping_sets(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two columns' values and of their pairs, in one pass."""
    return docs.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def keep_last(history: DataFrame, n: int, key: str, group: Column | None = None) -> DataFrame:
    """The last n entries of a log (of each group)."""
    if group is None:
        return history.orderBy(F.desc(key)).limit(n)
    return history.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(key)))).filter(F.col("_r") <= n).drop("_r")


def recent_distinct(history: DataFrame, n: int, key: str, query: str) -> DataFrame:
    return history.groupBy(query).agg(F.max(key).alias("last")).orderBy(F.desc("last")).limit(n)
