"""Near-duplicate texts: joins by Jaccard similarity of word n-grams with Bayesian pruning of candidates.

Texts with equal shingle sets form a class, and one of each class goes on. Classes that agree in a band of their
MinHash values are candidates, in the first band that they share. Their MinHash values are compared a few at a time; a
pair is dropped once the posterior probability that its similarity reaches the threshold falls below a tolerance. What
is left is verified on the shingle sets themselves. Pairs never become rows: a bucket passes on the texts that still
have a pair in it, and these meet again, with their shingles, in the same bucket.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import portions
from .common import alone, attached, components, discard, parts, runs, scratch, ship, spanning, tiled
from .wordhash import BORDER, hashes, joined, letter_values, stretches

WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold agrees in no band with probability (1 - 0.8^5)^25 = 5e-5.
BANDS, BAND = 25, 5
HASHES = BANDS * BAND
#: A pair is dropped when its posterior probability of reaching the threshold is lower.
TOLERANCE = 1e-5
#: Rows of a block of a crowded bucket or cluster, and shingles of all its rows, if these are alike.
TILE, HEAVY = 2_048, 4_000_000
#: Letters hashed at once.
PORTION = 400_000

_breaks = re.compile(r"\W")


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which codes are part of a word, and the value of each."""
    part = np.zeros(BORDER + 1, bool)
    part[: 0x30000] = [chr(x).isalnum() or x == 95 for x in range(0x30000)]
    part[0x30000:BORDER] = [chr(x).isalnum() for x in range(0x30000, BORDER)]
    return part, letter_values()


def multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Word n-grams as 64-bit hashes, and their MinHash values."""

    def __init__(self, words: int = WORDS):
        self.words, self.a = words, multipliers()

    def hashes(self, texts: list[str]) -> list[np.ndarray]:
        """Hashes of each text's words, \\w+ of the lower-cased text."""
        part, value = _letters()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for some in stretches([t.lower() for t in texts], PORTION, _breaks):
            _, codes, begins = joined([t for _, t in some])
            word = part[codes]
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # a border ends the last word
            edge = np.append(0, edge) if word[0] else edge
            begin, end = edge[::2], edge[1::2]
            h = hashes(value[codes], begin, end)
            for (k, _), x in zip(some, np.split(h, np.searchsorted(begin, begins[1:-1])), strict=True):
                out[k].append(x)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def shingles(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Sorted distinct shingles of each text. A text of fewer words than a shingle has is one shingle; a text
        without words has none."""
        for some in portions([t or "" for t in texts], PORTION):
            for h in self.hashes(some):
                n = min(self.words, len(h))
                if not n:
                    yield h
                    continue
                s = np.full(len(h) - n + 1, n, np.uint64)
                for k in range(n):
                    s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
                s ^= s >> np.uint64(31)
                s *= np.uint64(0xBF58476D1CE4E5B9)
                s ^= s >> np.uint64(29)
                yield np.unique(s)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Smallest values of the shingles under HASHES multiplications."""
        low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 512):
            np.minimum(low, (s[i : i + 512, None] * self.a).min(axis=0), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)


_LOADED: dict[int, Shingler] = {}


def loaded(words: int) -> Shingler:
    alone(_LOADED)
    if words not in _LOADED:
        _LOADED[words] = Shingler(words)
    return _LOADED[words]


def least_agreeing(similarity: float, tolerance: float) -> np.ndarray:
    """By the number of values compared, how many must agree for a pair to stay: the posterior, from a flat prior, that
    the similarity reaches the threshold is the chance of at most m successes in n + 1 trials at the threshold."""
    out = np.zeros(HASHES + 1, np.int16)
    for n in range(1, HASHES + 1):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b) of rows of sig that are not dropped, comparing BAND more values each time. band: the
    band in which each row meets others here; pairs that share an earlier one meet there."""
    live, agree = np.arange(len(a)), np.zeros(len(a), np.int16)
    for k in range(0, HASHES, BAND):
        same = (sig[a[live], k : k + BAND] == sig[b[live], k : k + BAND]).sum(axis=1, dtype=np.int16)
        agree = agree + same
        keep = (agree >= least[k + BAND]) & ((same < BAND) | (band[a[live]] <= k // BAND))
        live, agree = live[keep], agree[keep]
        if not len(live):
            break
    return live


def pairs_of(group: np.ndarray, own: np.ndarray, ti: np.ndarray, tj: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows that this pair of blocks must compare, some at a time. Rows come sorted by group."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    end = np.append(begin[1:], len(group))
    held_a, held_b, size = [], [], 0
    for s, e in zip(begin.tolist(), end.tolist(), strict=True):
        rows = np.arange(s, e)
        same = ti[s] == tj[s]
        first = rows if same else rows[own[s:e] == ti[s]]
        second = rows if same else rows[own[s:e] == tj[s]]
        if not len(second):
            continue
        step = max(1, most // len(second))
        for i in range(0, len(first), step):
            f = first[i : i + step]
            a, b = np.repeat(f, len(second)), np.tile(second, len(f))
            if same:
                a, b = a[b > a], b[b > a]
            held_a.append(a)
            held_b.append(b)
            size += len(a)
            if size >= most:
                yield np.concatenate(held_a), np.concatenate(held_b)
                held_a, held_b, size = [], [], 0
    if size:
        yield np.concatenate(held_a), np.concatenate(held_b)


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sorted sets. Few pairs are met one by one; many among the same rows
    by products of the rows' incidence with the shingles that more than one has, in columns."""
    rows = np.unique(np.concatenate([a, b]))
    if len(a) <= 8 * len(rows):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    place = np.zeros(len(sets), np.int64)
    place[rows] = np.arange(len(rows))
    flat = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    x, y = place[a], place[b]
    left, right = np.unique(x), np.unique(y)
    total = np.zeros((len(left), len(right)), np.float32)
    width = 2_048
    for c in range(0, int(shared.sum()), width):
        s = slice(*np.searchsorted(column, [c, c + width]))
        block = np.zeros((len(rows), width), np.float32)
        block[owner[s], column[s] - c] = 1
        total += block[left] @ block[right].T
    return total[np.searchsorted(left, x), np.searchsorted(right, y)].astype(np.int64)


def _sorted(df: DataFrame, spread: int, *keys: str) -> DataFrame:
    return df.repartition(spread, *keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest id that links reach, its own included), n_links (other
    documents with similarity >= the threshold, copies included), text_class (smallest id with the same shingles), kept
    (doc_id = class_id).

    Words are \\w+ of the lower-cased text. A text without words (null, empty) links with nothing, not even its like; a
    null doc_id comes back unlinked, with null class. Rows repeated with one id count as copies; texts that differ are
    linked each for itself, even where they share an id. No pair is left out
    for the size of its group: buckets of any size are dealt in pairs of blocks of TILE rows, fewer where texts are very
    long (HEAVY shingles); a task holds two blocks, and the shingles of any one text. Links are counted where pairs are compared; pairs never become rows."""
    return decided(docs, words, similarity, tolerance).drop("same", "component")


def decided(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """near_duplicates() with two more columns: same (hash of the shingle set, null without words) and component
    (number of the group of texts that links connect)."""
    spark = docs.sparkSession
    ship(spark)
    least = least_agreeing(similarity, tolerance)
    text = docs["text"].cast("string").alias("text")

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from quillspark.llm.ngram import loaded

        shingler = loaded(words)
        for b in parts(batches):
            same, sigs, n = [], [], []
            for s in shingler.shingles(b.column(1).to_pylist()):
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(shingler.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "same", "sig"])

    every = scratch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(prepared, "doc_id long, n long, same binary, sig binary"), "ngram-docs")
    held = every.filter("doc_id IS NOT NULL AND same IS NOT NULL")
    unique = _unique(every)
    grouped = held.groupBy("same").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    # where an id has several texts it names none of them: classes get numbers
    classes = scratch(grouped.withColumn("rep", F.col("low") if unique else F.monotonically_increasing_id()), "ngram-classes")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, BAND).astype(np.uint64)
            number = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
            key = number.copy()
            for k in range(BAND):
                key = (key ^ sig[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(number.ravel().astype(np.int8) - 1, pa.int8()), pa.array(np.repeat(rep, BANDS)), pa.array(np.repeat(b.column(2).to_numpy(), BANDS))], ["key", "band", "rep", "size"])

    held_tables: list[DataFrame] = []
    bands = classes.select("rep", "sig", F.col("n").cast("int")).mapInArrow(banded, "key long, band byte, rep long, size int")
    place = ["key", "tile_i", "tile_j", "tile_own", "band", "rep"]
    buckets, spread = tiled(bands, ["key", "band"], "rep", TILE, held_tables, "size", HEAVY)
    buckets = buckets.select(*place).hint("merge").join(classes.select("rep", "sig"), "rep").select(*place, "sig")

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.common import runs
        from quillspark.llm.ngram import pairs_of, surviving

        for t, group in runs(batches, 3, 50_000):
            ti, tj, own, band = (t.column(k).to_numpy() for k in (1, 2, 3, 4))
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint32).reshape(-1, HASHES)
            asks = np.zeros(t.num_rows, bool)
            for a, b in pairs_of(group, own, ti, tj):
                live = surviving(sig, a, b, least, band)
                asks[a[live]] = asks[b[live]] = True
            yield from t.select(place).filter(pa.array(asks)).to_batches()

    types = "key long, tile_i int, tile_j int, tile_own int, band byte, rep long"
    asked = scratch(_sorted(buckets, spread, "key", "tile_i", "tile_j").mapInArrow(pruned, types), "ngram-asked")
    for x in held_tables:
        discard(x)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.ngram import loaded

        shingler = loaded(words)
        for b in parts(batches):
            made = [s.tobytes() for s in shingler.shingles(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["rep", "shingles"])

    # an id may come with several texts: the class hash picks the one that stands for its class
    total = classes.agg(F.sum("copies")).first()[0] or 0
    named = asked.select("rep").distinct().join(classes.select("rep", "low", "same", F.col("copies").alias("n")), "rep")
    texts = docs.select(docs["doc_id"].cast("long").alias("low"), text)
    if unique:
        texts = attached(texts, named.select("low", "n"), ["low"], total, shuffled=True).drop("n")
    else:
        rows_of = held.groupBy(F.col("doc_id").alias("low")).agg(F.count(F.lit(1)).alias("n"))
        texts = attached(texts, named.select("low").distinct().join(rows_of, "low"), ["low"], total, shuffled=True)
    shingled = texts.mapInArrow(sets, "rep long, shingles binary").dropDuplicates(["rep"]) if unique else _chosen(texts.select("low", "text"), named, words, total)
    shingled = scratch(shingled.hint("merge").join(classes.select("rep", "copies", "sig"), "rep"), "ngram-sets")
    dealt = asked.hint("merge").join(shingled, "rep").select(*place, "copies", "sig", "shingles")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.common import runs, spanning
        from quillspark.llm.ngram import common, pairs_of, surviving

        for t, group in runs(batches, 3, 4_096):
            ti, tj, own, band, rep, copies = (t.column(k).to_numpy() for k in range(1, 7))
            sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint32).reshape(-1, HASHES)
            held = [np.frombuffer(x, np.uint64) for x in t.column(8).to_pylist()]
            n = np.array([len(x) for x in held])
            links = np.zeros(len(rep), np.int64)
            some = []
            for a, b in pairs_of(group, own, ti, tj):
                live = surviving(sig, a, b, least, band)
                a, b = a[live], b[live]
                if not len(a):
                    continue
                both = common(held, a, b)
                good = both * (1 + similarity) >= similarity * (n[a] + n[b]) - 1e-9
                a, b = a[good], b[good]
                links += np.bincount(a, copies[b], len(rep)).astype(np.int64) + np.bincount(b, copies[a], len(rep)).astype(np.int64)
                names, row = np.unique(rep, return_inverse=True)  # one text may be here in several buckets
                some.append(np.stack(spanning(names, row[a], row[b])))
            x, y = np.concatenate(some, axis=1) if some else np.zeros((2, 0), np.int64)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[at], x])), pa.array(np.concatenate([links[at], np.zeros(len(x), np.int64)])), pa.array(np.concatenate([rep[at], y]))], ["rep", "links", "low"])

    found = scratch(_sorted(dealt, spread, "key", "tile_i", "tile_j").mapInArrow(verified, "rep long, links long, low long"), "ngram-links")
    discard(shingled)
    discard(asked)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))).toDF("rep", "component")
    reps = classes.select("same", "rep", "low", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    own = reps.select("same", "low", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    if unique:
        own = own.withColumn("least", F.col("component"))
    else:
        own = attached(own, own.groupBy("component").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")), ["component"], total).drop("n")
    columns = ["doc_id", "same", "low", "n_links", "component", "least"]
    placed = attached(held.select("doc_id", "same"), own.select(*columns[1:], F.col("copies").alias("n")), ["same"], total, shuffled=True).select(*columns)
    null = F.lit(None).cast("long")
    alone = every.filter("doc_id IS NULL OR same IS NULL").select("doc_id", "same", F.col("doc_id").alias("low"), F.lit(0).cast("long").alias("n_links"), null.alias("component"), F.col("doc_id").alias("least"))
    return placed.union(alone).select(
        "doc_id",
        F.col("least").alias("class_id"),
        "n_links",
        F.col("low").alias("text_class"),
        F.coalesce(F.col("least") == F.col("doc_id"), F.lit(True)).alias("kept"),
        "same",
        "component",
    )


def _unique(every: DataFrame) -> bool:
    """True if no id comes with two different texts."""
    n = every.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("same").alias("n")).filter("n > 1")
    return n.isEmpty()


def _chosen(texts: DataFrame, named: DataFrame, words: int, total: int) -> DataFrame:
    """Shingles of the texts whose set is their class's, where an id has several texts. A class's rows are no fewer than
    those of one id in it, so n bounds them."""
    made = hashed(texts, "text", words, "shingles binary, same binary").filter("same IS NOT NULL")
    return attached(made, named.select("low", "same", "rep", "n"), ["low", "same"], total, shuffled=True).select("rep", "shingles").dropDuplicates(["rep"])


def hashed(rows: DataFrame, text: str, words: int = WORDS, adds: str = "same binary") -> DataFrame:
    """rows with the shingles of their text and the hash of these (null without words), or with the hash alone."""
    ship(rows.sparkSession)
    at, sets = rows.columns.index(text), adds.startswith("shingles")
    names = [*rows.columns, *(x.split()[0] for x in adds.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from quillspark.llm.ngram import loaded

        for b in parts(batches):
            made = [s.tobytes() for s in loaded(words).shingles(b.column(at).to_pylist())]
            more = [pa.array([xxhash.xxh3_128_digest(x) if x else None for x in made], pa.binary())]
            if sets:
                more.insert(0, pa.array(made, pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    added = [F.lit(b"").alias(x.split()[0]) for x in adds.split(", ")]
    schema = rows.select(*rows.columns, *added).schema
    for f in schema.fields:
        f.nullable = True
    return rows.mapInArrow(run, schema)


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}

_OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS l FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < {WORDS} THEN [array_to_string(l, ' ')]
  ELSE list_distinct(list_transform(range(1, len(l) - {WORDS - 2}), lambda i: array_to_string(l[i : i + {WORDS - 1}], ' '))) END AS g FROM w),
h AS MATERIALIZED (SELECT doc_id, g, md5(array_to_string(list_sort(g), chr(1))) AS same FROM s),
k AS MATERIALIZED (SELECT same, min(doc_id) AS low, count(*) AS copies, any_value(g) AS g FROM h WHERE len(g) > 0 GROUP BY same),
x AS (SELECT low, len(g) AS n, unnest(g) AS t FROM k),
p AS MATERIALIZED (SELECT a.low AS a, b.low AS b FROM x a JOIN x b ON a.t = b.t AND a.low <> b.low GROUP BY a.low, b.low, a.n, b.n HAVING count(*) * {1 + SIMILARITY} >= {SIMILARITY} * (a.n + b.n) - 1e-9),
c(low, least) AS (SELECT low, low FROM k UNION SELECT p.a, c.least FROM c JOIN p ON p.b = c.low),
r AS (SELECT k.same, k.low, k.copies - 1 + coalesce((SELECT sum(o.copies) FROM p JOIN k o ON o.low = p.b WHERE p.a = k.low), 0) AS n_links, m.least
  FROM k JOIN (SELECT low, min(least) AS least FROM c GROUP BY low) m USING (low))
SELECT d.doc_id, coalesce(r.least, d.doc_id) AS class_id, coalesce(r.n_links, 0)::BIGINT AS n_links, coalesce(r.low, d.doc_id) AS text_class, coalesce(coalesce(r.least, d.doc_id) = d.doc_id, true) AS kept
FROM (SELECT documents.doc_id, h.same FROM documents LEFT JOIN h ON h.doc_id = documents.doc_id) d LEFT JOIN r ON r.same = d.same
"""
ORACLES = {"op2_ngram_jaccard": _OP2_SQL}
