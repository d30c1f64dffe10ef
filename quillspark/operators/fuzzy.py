"""Misspelt words against a vocabulary: candidates by shared letter pairs, then edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import bounded

#: Letters of a gram.
GRAM = 2
_MARK = "\x01"


def grams(word: Column) -> Column:
    """The grams of a word with a mark on either side, repeats numbered so that each is an element of its own."""
    marked = F.concat(F.lit(_MARK), word, F.lit(_MARK))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - GRAM + 1)), lambda i: F.substring(marked, i, F.lit(GRAM)))
    return F.transform(every, lambda g, i: F.concat(g, F.size(F.filter(F.slice(every, 1, i + 1), lambda o: o == g)).cast("string")))


def gram_index(vocabulary: DataFrame) -> DataFrame:
    """(gram, term, letters) of the distinct terms of a vocabulary (term, ...), which is few bytes and much work: it is dealt
    over all cores."""
    vocabulary = vocabulary.select("term").repartition(2 * vocabulary.sparkSession.sparkContext.defaultParallelism)
    return vocabulary.select("term", F.length("term").alias("letters"), F.explode(grams(F.col("term"))).alias("gram")).select("gram", "term", "letters")


def similar(index: DataFrame, words: DataFrame, least: float = 0.6) -> DataFrame:
    """(word, term, similarity) of the vocabulary's terms with similarity 1 - levenshtein / longer length of at least
    `least` to a word, exactly. index: gram_index() of the vocabulary; words: (word), distinct.

    An edit changes GRAM grams at most, so a term within d edits shares all but GRAM * d of the longer one's grams.
    Where that asks for no shared gram at all (short words, low thresholds), terms of a fitting length are compared
    directly."""
    longer = F.greatest("letters", "asked")
    edits = F.floor((1 - F.lit(least)) * longer + 1e-9)
    needed = longer + 2 - GRAM + 1 - GRAM * edits  # of the longer one's letters + 2 - GRAM + 1 grams
    small = F.broadcast if bounded(words, 1_000) else lambda d: d  # noqa: E731  few words come to the vocabulary
    asked = words.select("word", F.length("word").alias("asked"))
    fits = (F.abs(F.col("letters") - F.col("asked")) <= edits) & (longer > 0)
    shared = index.join(small(asked.select("word", "asked", F.explode(grams(F.col("word"))).alias("gram"))), "gram")
    shared = shared.groupBy("word", "term", "letters", "asked").agg(F.count(F.lit(1)).alias("n")).filter(fits & (F.col("n") >= needed)).select("word", "term")
    # no gram is needed: by length alone, which is few words and letters
    lengths = asked.withColumn("letters", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.col("asked") * least).cast("int")), F.ceil(F.col("asked") / F.lit(least)).cast("int"))))
    lengths = lengths.filter(fits & (needed <= 0)).select("word", "letters")
    # every term has one first gram: a distinct list of terms
    short = index.filter(F.col("gram").startswith(_MARK)).select("term", "letters").join(small(lengths), "letters").select("word", "term")
    pairs = shared.union(short).distinct()
    similarity = 1 - F.levenshtein("word", "term") / F.greatest(F.length("word"), F.length("term"))
    return pairs.select("word", "term", similarity.alias("similarity")).filter(F.col("similarity") >= least - 1e-12)
