"""Positional postings, and exact top-k by upper bounds.

Phrases are matched on the positions of their words, no text is read. For ranking, chunks are dealt into cells by length
and hash; the bounds table knows for each term and cell the largest tf and the smallest length, from which follows how much
a chunk of the cell can score at most, whatever the average length is by then.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.stemmer import stem
from quillspark.functions.text import tokens
from quillspark.operators.scoring import idf, saturation

#: Cells of each length class; classes of a doubling of the length.
CELLS, CLASSES = 16, 4
#: Cells of one class take numbers of a range of this size.
_RANGE = 1 << 16
#: Tokens of a segment, and rows that are handed on at once.
SEGMENT, _ROWS = 2_000_000, 50_000


def positional(chunks: DataFrame, keys: list[str], text: str = "text", style: str = "words") -> DataFrame:
    """(keys, term, positions): where every token of a text stands, from 0, in order. Texts without tokens have no rows."""
    x = chunks.select(*keys, F.posexplode(tokens(F.col(text), style)).alias("at", "term"))
    return x.groupBy(*keys, "term").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def segments(chunks: DataFrame, keys: list[str], text: str = "text", style: str = "words", stems: bool = False) -> DataFrame:
    """(keys, dl, term, positions) as positional() gives them, dl a text's tokens; with stems (keys, dl, term, tf) of Porter2
    stems. Every row of chunks is a text of its own. Postings are made within the task that reads the text, nothing is
    shuffled: a segment of texts at a time, sorted by term, so that the statistics of a Parquet file's pages tell where a term is."""
    k, last = len(keys), T.StructField("tf", T.LongType()) if stems else T.StructField("positions", T.ArrayType(T.IntegerType()))
    x = chunks.select(*keys, tokens(F.col(text), style).alias("tokens"))
    schema = T.StructType([*(x.schema[c] for c in keys), T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), last])

    def segment(b: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        words = b.column(k).flatten().dictionary_encode()
        names, which = np.unique(np.array([stem(w) if stems else w for w in words.dictionary.to_pylist()], dtype=object), return_inverse=True)
        both = which[words.indices.to_numpy()]  # as many as tokens: what is not needed any more goes at once
        both *= len(sizes)
        both += np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(both, kind="stable").astype(np.int32)  # a text's places stay in order
        both = both[order]
        ends = np.flatnonzero(np.append(both[1:] != both[:-1], True)) + 1
        term, row = np.divmod(both[ends - 1], len(sizes))
        del both, words, which
        if stems:
            what = pa.array(np.diff(ends, prepend=0))
        else:
            at = np.arange(len(order), dtype=np.int32)
            at -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
            what = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(at[order]))
            del at, order
        row = pa.array(row)
        columns = [*(b.column(i).take(row) for i in range(k)), pa.array(sizes.astype(np.int32)).take(row), pa.array(names.tolist(), pa.string()).take(pa.array(term)), what]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            upto, at = np.cumsum(sizes), 0
            while at < len(sizes):
                n = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SEGMENT, "right")) - at)
                if sizes[at : at + n].any():
                    made = segment(b.slice(at, n), sizes[at : at + n])
                    yield from (made.slice(i, _ROWS) for i in range(0, made.num_rows, _ROWS))
                at += n

    return x.mapInArrow(run, schema)


def phrase(places: DataFrame, words: str, key: str = "doc_id", df: DataFrame | None = None) -> DataFrame:
    """Ids (key) of texts where the words stand side by side, from their positions (key, term, positions) alone. The
    rarest word comes first and the others only narrow what it leaves; df (term, df) of the same tokens says which that is,
    else it is counted. A word that is nowhere, or a phrase without words, is found nowhere."""
    asked = [w.lower() for w in words.split()]
    found = df if df is not None else places.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = {r["term"]: r["df"] for r in found.filter(F.col("term").isin(*set(asked))).collect()} if asked else {}
    if not asked or len(known) < len(set(asked)):
        return places.select(key).limit(0)

    def begins(at: int):
        return F.transform("positions", lambda p: p - at)

    out = None
    for at, word in sorted(enumerate(asked), key=lambda x: (known[x[1]], x[0])):
        here = places.filter(F.col("term") == word).select(key, begins(at).alias("begins"))
        if out is None:
            out = here.withColumnRenamed("begins", "left")
        else:
            out = out.join(here, key).select(key, F.array_intersect("left", "begins").alias("left")).filter(F.size("left") > 0)
    return out.select(key).distinct()


def cell(dl: Column, key: Column, cells: int = CELLS) -> Column:
    """The cell of a chunk: its length's class and, within, its key's hash."""
    size = F.floor(F.log2(F.greatest(dl.cast("double"), F.lit(0.0)) + 1) * CLASSES).cast("int")
    return size * _RANGE + F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def bounds(tf: DataFrame) -> DataFrame:
    """(term, cell, n, most_tf, least_dl) of postings (term, tf, dl, cell)."""
    return tf.groupBy("term", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))


def widened(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Bounds that hold for old and fresh postings together. Postings that went leave them as they are: they still hold,
    though n counts what has gone."""
    both = old.unionByName(fresh).groupBy("term", "cell")
    return both.agg(F.sum("n").alias("n"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))


def bounded_top_k(tf: DataFrame, limits: DataFrame, df: DataFrame, stats: DataFrame, terms: Iterable[str], k: int, key: str = "chunk_id") -> tuple[DataFrame, dict]:
    """The k best chunks (key, score) by BM25 of the terms (a repeated one counts again), to nine places, ties to the
    smaller key, exactly as scoring all would give; and a report: cells and postings of the terms, and how many of them were read.

    Cells are ordered by what a chunk of theirs can score at most. The first of them give a k-th score; of the others
    only those that can reach it are scored. The driver sees a row for each cell (CELLS for each of at most 128 length
    classes) and each term of the query."""
    spark = tf.sparkSession
    asked = {t: list(terms).count(t) for t in terms}
    none = spark.createDataFrame([], f"{key} {tf.schema[key].dataType.simpleString()}, score double")
    about = df.filter(F.col("term").isin(*asked)).crossJoin(F.broadcast(stats)).select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf")).collect() if asked else []
    report = {"cells": 0, "cells_read": 0, "postings": 0, "postings_read": 0}
    if not about:
        return none, report
    avgdl = F.lit(float(about[0]["avgdl"]))
    weight = F.create_map(*[F.lit(x) for r in about for x in (r["term"], float(asked[r["term"]] * r["idf"]))])[F.col("term")]
    mine = [r["term"] for r in about]
    most = F.sum(weight * saturation(F.col("most_tf"), F.col("least_dl"), avgdl))
    cells = limits.filter(F.col("term").isin(*mine)).groupBy("cell").agg(most.alias("most"), F.sum("n").alias("n")).collect()
    cells.sort(key=lambda r: (-r["most"], r["cell"]))

    def scored(some: list[int]) -> DataFrame:
        rows = tf.filter(F.col("term").isin(*mine) & F.col("cell").isin(*some) & (F.col("tf") > 0) & (F.col("dl") > 0))
        rows = rows.groupBy(key).agg(F.round(F.sum(weight * saturation(F.col("tf"), F.col("dl"), avgdl)), 9).alias("score"))
        return rows.orderBy(F.desc("score"), key).limit(k)

    first, held = [], 0
    while len(first) < len(cells) and held < 2 * k:
        held += cells[len(first)]["n"]
        first.append(cells[len(first)]["cell"])
    best = [(r[key], r["score"]) for r in scored(first).collect()]
    bar = best[k - 1][1] if len(best) == k else float("-inf")
    rest = [r["cell"] for r in cells[len(first) :] if r["most"] >= bar - 1e-8 - 1e-9 * abs(bar)]
    if rest:
        best += [(r[key], r["score"]) for r in scored(rest).collect()]
    read = set(first) | set(rest)
    report = {"cells": len(cells), "cells_read": len(read), "postings": sum(r["n"] for r in cells), "postings_read": sum(r["n"] for r in cells if r["cell"] in read)}
    out = spark.createDataFrame(best, none.schema) if best else none
    return out.orderBy(F.desc("score"), key).limit(k), report
