"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

Hashed word n-grams of raw texts become postings: for each bucket and block of texts, which texts have it and how often.
Postings are shuffled by bucket, where the counts of both corpora meet; each bucket's gain is computed there, and what
it adds to every text goes back and is summed by text. The draw is a sorted, numbered table.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, parts, scratch, ship, unused

BUCKETS, NGRAM, SEED, LEAST_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
#: Texts, and bytes of text, of a block of postings. A longer text is a block of its own, read a portion at a time.
BLOCK, BLOCK_BYTES, PORTION = 4_096, 8_000_000, 1_000_000
#: Postings of one bucket that a task takes; a bucket with more is dealt over several.
SHARE = 4_000_000
#: Features whose buckets a worker remembers.
_KEPT = 500_000

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Bytes of words as they are, A-Z as a-z, all others as spaces.
_FOLD = bytes(x if x in _WORD_BYTES else x + 32 if 0x41 <= x <= 0x5A else 32 for x in range(256))


class _Buckets(dict):
    """Bucket by feature (bytes), computed when first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _KEPT:
            self.clear()
        found = self[feature] = crc32(feature) % self.buckets
        return found


def text_buckets(text: bytes, kept: _Buckets, ngram: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a text in UTF-8: how many words each portion has and the buckets of the features that end in it."""
    at, before = 0, []  # before: the words that runs may still begin with
    while at < len(text):
        end = len(text)
        if end - at > PORTION:
            end = at + PORTION
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
        words = text[at:end].translate(_FOLD).split()
        found = list(map(kept.__getitem__, words))
        if ngram > 1:
            row = before + words
            for n in range(2, ngram + 1):
                some = row[max(0, len(before) - n + 1) :]
                found += [kept[b" ".join(some[i : i + n])] for i in range(len(some) - n + 1)]
            before = row[max(0, len(row) - ngram + 1) :]
        yield len(words), np.array(found, np.int32)
        at = end


def postings(texts: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """From texts (id long, text): for every block of texts and bucket a row (block, bucket, n: postings, total: features,
    places: numbers of the texts within the block, counts), and for every block a row with bucket -1 that has all its
    texts (places, counts: their features, ids, words). A row of texts is a place of its own, whatever its id. Block
    numbers hold for one run only: write the result before it is read twice (scratch)."""
    ship(texts.sparkSession)
    arrays = {"places": pa.list_(pa.int16()), "counts": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "words": pa.list_(pa.int64())}
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), *arrays.items()])

    def rows(number: int, members: list[tuple], key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of a block: members (id, words, features), its postings by key (bucket * BLOCK + place, sorted) with counts."""
        ids, words, features = zip(*members, strict=True)
        listed = [pa.array([list(x)], t) for x, t in zip((range(len(ids)), features, ids, words), arrays.values(), strict=True)]
        heads = [pa.array([x], t) for x, t in ((number, pa.int64()), (-1, pa.int32()), (len(ids), pa.int64()), (0, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*heads, *listed], schema=schema)
        if not len(key):
            return
        bucket, place = np.divmod(key, BLOCK)
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        border = pa.array(np.append(begin, len(key)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(begin), number)),
                pa.array(bucket[begin].astype(np.int32)),
                pa.array(np.diff(np.append(begin, len(key)))),
                pa.array(np.add.reduceat(count, begin)),
                pa.ListArray.from_arrays(border, pa.array(place.astype(np.int16))),
                pa.ListArray.from_arrays(border, pa.array(count.astype(np.int32))),
                pa.nulls(len(begin), arrays["ids"]),
                pa.nulls(len(begin), arrays["words"]),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Buckets(buckets)
        number = TaskContext.get().partitionId() << 32
        members: list[tuple] = []
        keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        size = 0
        for batch in parts(batches, 256):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) > PORTION:  # a block of its own, with its counts as it is read
                    words = features = 0
                    sums = np.zeros(buckets, np.int64)
                    for n, found in text_buckets(data, kept, ngram):
                        words, features = words + n, features + len(found)
                        sums += np.bincount(found, minlength=buckets)
                    at = np.flatnonzero(sums)
                    yield from rows(number, [(name, words, features)], at * BLOCK, sums[at])
                    number += 1
                    continue
                words = features = 0
                for n, found in text_buckets(data, kept, ngram):
                    words, features = words + n, features + len(found)
                    keys.append(found * np.int64(BLOCK) + len(members))
                members.append((name, words, features))
                size += len(data)
                if len(members) == BLOCK or size >= BLOCK_BYTES:
                    yield from rows(number, members, *np.unique(np.concatenate(keys), return_counts=True))
                    number, members, keys, size = number + 1, [], keys[:1], 0
        if members:
            yield from rows(number, members, *np.unique(np.concatenate(keys), return_counts=True))

    ddl = "block long, bucket int, n long, total long, places array<short>, counts array<int>, ids array<long>, words array<long>"
    data = F.coalesce(F.encode(texts["text"].cast("string"), "utf-8"), F.lit(b""))
    return texts.select(texts["id"].cast("long").alias("id"), data.alias("data")).mapInArrow(run, ddl)


def weights(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """From two tables of postings (written ones): every text of source with (block, place, doc_id, n_words, n_features,
    weight). Postings go to their bucket, where both corpora's counts meet them and give the bucket's gain; a bucket with
    more than SHARE postings is dealt over several tasks by block. What the buckets of a task add to one text is summed
    there before it goes to the text. Buckets, at most so many, are counted before; of these only the two corpora's sums
    and the largest bucket's size reach the driver."""
    of = lambda posts, **x: posts.filter("bucket >= 0").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select("bucket", *(v.alias(k) for k, v in x.items()))
    zero = F.lit(0).cast("long")
    met = of(source, s=F.col("total"), t=zero, n=F.col("n")).union(of(target, s=zero, t=F.col("total"), n=zero))
    met = met.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    all_s, all_t, most = met.agg(F.coalesce(F.sum("s"), zero), F.coalesce(F.sum("t"), zero), F.coalesce(F.max("n"), zero)).first()
    shares = 1 + most // SHARE
    met = met.filter("s > 0").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    posts = source.filter("bucket >= 0").withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    gain = F.floor(F.lit(1000.0) * F.ln(up / down))
    added = posts.join(met.hint("shuffle_hash"), ["bucket", "share"]).select("block", gain.alias("gain"), F.explode(F.arrays_zip("places", "counts")).alias("x"))
    added = added.groupBy("block", F.col("x.places").alias("place")).agg(F.sum(F.col("gain") * F.col("x.counts")).alias("weight"))
    texts = source.filter("bucket = -1").select("block", F.explode(F.arrays_zip("places", "ids", "words", "counts")).alias("x"))
    texts = texts.select("block", F.col("x.places").alias("place"), F.col("x.ids").alias("doc_id"), F.col("x.words").alias("n_words"), F.col("x.counts").cast("long").alias("n_features"))
    return texts.join(added, ["block", "place"], "left").withColumn("weight", F.coalesce("weight", zero))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with position: 1, 2, 3 ... in this order over the whole table, by ranges that are sorted each for itself. Only
    the number of rows of each range is broadcast."""
    part, at = unused("part", rows.columns), unused("at", rows.columns)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = scratch(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = [(r[0], r[1]) for r in written.groupBy(part).count().orderBy(part).collect()]
    before = [(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)]
    base = rows.sparkSession.createDataFrame(before, f"{part} int, before long")
    name = unused("before", rows.columns)
    out = written.join(F.broadcast(base.withColumnRenamed("before", name)), part)
    return out.select(*rows.columns, (F.col(at) + F.col(name) + 1).alias("position"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) drawn without replacement by how much they look like the texts of target: doc_id, n_features,
    weight, score, rank (null if not drawn).

    Words are runs of 0-9, A-Z lowered, a-z and all letters beyond ASCII; features are all runs of 1 to ngram words, by
    crc32 in buckets. A bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))); weight sums the gains of a
    text's features. score adds floor(-1000 ln(-ln u)), u from sha256("<seed>:<doc_id>"). Of the N texts of at least
    least_words words, floor(percent N / 100) of the highest scores are drawn, ties to the smaller doc_id (null last).

    Null and empty texts and texts without a word have weight 0 and are never drawn for least_words > 0. Every row counts
    and is judged for itself, repeated ids and texts too; an empty docs gives no rows; without words in target every t is
    0. Further columns are not read. Very long texts are read a portion at a time."""
    written = scratch(postings(docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text")), buckets, ngram), "postings")
    aimed = scratch(postings(target.select(F.lit(0).cast("long").alias("id"), target["text"].alias("text")), buckets, ngram), "postings")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = scratch(weights(written, aimed, buckets).withColumn("score", F.col("weight") + noise), "scored")
    discard(written)
    discard(aimed)
    able = scored.filter(F.col("n_words") >= least_words)
    draws = percent * able.count() // 100
    placed = numbered(able, F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    rank = F.when(F.col("position") <= draws, F.col("position"))
    rest = scored.filter(F.col("n_words") < least_words)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).union(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


def drawn(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of docs whose id resample() has drawn; of an id with several rows all, if one was drawn."""
    ids = resampled.filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["drawn_id"], "left_semi")


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op12_importance": op12_importance}
ORACLES = {
    "op12_importance": r"""
WITH RECURSIVE
steps AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
words AS (
  SELECT 1 AS own, doc_id, len(w) AS n_features, unnest(w) AS word FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT 0, NULL, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)),
crc AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) AS BIGINT) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM spelt, tab),
counts AS (SELECT bucket, sum(own) AS s, sum(1 - own) AS t FROM words JOIN crc USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(CAST(1000 AS DOUBLE) * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts),
sums AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM words JOIN crc USING (word) JOIN gains USING (bucket) WHERE own = 1 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(CAST(-1000 AS DOUBLE) * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents d LEFT JOIN sums USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN r <= (10 * n) // 100 THEN CAST(r AS BIGINT) END AS rank
FROM scored LEFT JOIN able USING (doc_id)"""
}
