"""The inverted index as tables: term frequencies, document frequencies, co-occurrence, concepts, statistics; and
their upkeep when documents come and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.stemmer import replaced
from quillspark.functions.text import tokens, without_fillers


def term_frequencies(chunks: DataFrame, keys: list[str], text: str = "text", style: str = "words", fillers: bool = True, stem: DataFrame | None = None, only: list[str] | None = None, stems: bool = False) -> DataFrame:
    """(keys, term, tf). stems: Porter2 stems for terms, taken before they are counted. only: the postings of these terms alone; others never leave their row. stem: a table (term, stem) of distinct terms; its stems take the terms' place."""
    toks = tokens(F.col(text), style)
    if not fillers:
        toks = without_fillers(toks)
    if only is not None:
        toks = F.filter(toks, lambda t: t.isin(*only))
    x = chunks.select(*keys, F.explode(toks).alias("term"))
    x = replaced(x) if stems else x
    tf = x.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    if stem is not None:
        tf = tf.join(stem, "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return tf


def document_frequencies(tf: DataFrame, key: str, distinct: bool = False) -> DataFrame:
    """(term, df): in how many chunks (or, where a key recurs, distinct documents) a term occurs."""
    n = F.count_distinct(key) if distinct else F.count(F.lit(1))
    return tf.groupBy("term").agg(n.alias("df"))


def corpus_stats(chunks: DataFrame, length: Column) -> DataFrame:
    """One row: n, avgdl (0 without chunks)."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avgdl"))


def incremental_df(df: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Document frequencies after term rows (term) of one chunk each are added and removed; terms that fall to 0 go."""
    delta = added.select("term", F.lit(1).alias("df")).unionAll(removed.select("term", F.lit(-1).alias("df")))
    return df.select("term", "df").unionAll(delta).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def cooccurrence(chunks: DataFrame, text: str = "text", head: int = 50, reach: int = 5, by: list[str] | None = None) -> DataFrame:
    """(term_a < term_b, n): how often two of a chunk's first tokens stand within reach of each other. by: keep the
    counts apart by these columns, so that a deleted document's can be taken off. No join: pairs come from arrays."""
    by = by or []
    toks = F.slice(tokens(F.col(text)), 1, head)
    x = chunks.select(*by, toks.alias("t"))
    pairs = F.flatten(F.transform(F.col("t"), lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.lit(reach)), lambda b: F.struct(F.least(a, b).alias("term_a"), F.greatest(a, b).alias("term_b")))))
    x = x.select(*by, F.explode(pairs).alias("p")).select(*by, "p.term_a", "p.term_b").filter("term_a <> term_b")
    return x.groupBy(*by, "term_a", "term_b").agg(F.count(F.lit(1)).alias("n"))


def cooccurring(cooc: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """(term, n): the k strongest partners of terms; those that follow in order of pairs come first, then, if not
    among them, those that precede. Ties go by term."""
    ask = [F.lit(t) for t in terms]
    fwd = cooc.filter(F.col("term_a").isin(*terms)).groupBy(F.col("term_b").alias("term")).agg(F.sum("n").alias("n"), F.lit(0).alias("back"))
    bwd = cooc.filter(F.col("term_b").isin(*terms)).groupBy(F.col("term_a").alias("term")).agg(F.sum("n").alias("n"), F.lit(1).alias("back"))
    top = lambda d: d.filter(~F.array_contains(F.array(*ask), F.col("term"))).orderBy(F.desc("n"), "term").limit(k)
    fwd, bwd = top(fwd), top(bwd)
    both = fwd.unionByName(bwd.join(fwd.select("term"), "term", "left_anti").select("term", "n", "back"))
    return both.orderBy("back", F.desc("n"), "term").limit(k).select("term", "n")


def chunk_concepts(tf: DataFrame, thesaurus: DataFrame, key: str) -> DataFrame:
    """(key, concept, weight): thesaurus neighbours (word, concept, weight), such as Thesaurus.frame gives, of a chunk's
    terms, the highest weight."""
    x = tf.join(thesaurus, tf["term"] == thesaurus["word"]).filter("concept <> term")
    return x.groupBy(key, "concept").agg(F.max("weight").alias("weight"))


def scan_plan(listing: DataFrame, known: DataFrame, tolerance: float = 0.0, force: bool = False) -> DataFrame:
    """(path, action) of a scan of listing against known, both (path, size, mtime): index what is new or differs, skip
    what does not, delete what is known and no longer there. force: nothing is skipped. A file of unknown (null) size or
    time differs. Paths are unique on either side."""
    there = listing.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(True).alias("_there"))
    old = known.select("path", F.col("size").alias("_s0"), F.col("mtime").alias("_m0"))
    same = F.coalesce((F.col("_s") == F.col("_s0")) & (F.abs(F.col("_m") - F.col("_m0")) <= tolerance), F.lit(False))
    action = F.when(F.col("_there").isNull(), "delete").when(same & F.lit(not force), "skip").otherwise("index")
    return there.join(old, "path", "full").select("path", action.alias("action"))


def changed(listing: DataFrame, known: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rows of listing (path, size, mtime) that are new or differ in size or time from known."""
    same = known.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"))
    keep = (listing["path"] == same["path"]) & (listing["size"] == same["s0"]) & (F.abs(listing["mtime"] - same["m0"]) <= tolerance)
    return listing.join(same, keep, "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """table with all rows of fresh's documents replaced."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """All tables without the rows of the documents in gone."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str, how: str = "sum") -> DataFrame:
    """Upsert that adds counts, or keeps the larger or the later value."""
    f = {"sum": F.sum, "max": F.max}.get(how)
    both = old.select(*keys, value, F.lit(0).alias("_v")).unionByName(new.select(*keys, value, F.lit(1).alias("_v")))
    return both.groupBy(*keys).agg((f(value) if f else F.max_by(value, "_v")).alias(value))


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)
