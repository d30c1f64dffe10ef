"""Exact dedup against a history, by minimal perfect hashing of its distinct digests.

An index is a table of shards, dealt by the first bytes of the SHA-256 digest of the normalised text. Each shard has a
minimal perfect hash of its digests, and slots with the full digests, the locators of the winners and the sizes of their
groups. Arriving digests are looked up in their shard: where the slot holds the same 32 bytes, the text is a repeat and its
rows join that group; the others group among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, discard, parts, scratch, ship

#: Distinct digests of a shard, and arriving ones that a task looks up in it, on average.
SHARD = 32_768
#: Cells of a level for each key that is left.
ROOM = 2.0
_FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


def normalised(text: bytes) -> bytes:
    """A text in UTF-8 with A-Z lowered, nothing else."""
    return text.translate(_FOLD)


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A hash of the four words of every digest, another for every level."""
    x = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for k in range(4):
        x = (x ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of n distinct digests: level after level, keys that have a cell to themselves stay there
    and the others go on; a key's slot is the number of taken cells before its own."""

    def __init__(self, sizes: list[int], taken: np.ndarray):
        self.sizes, self.taken = sizes, taken
        self.rank = np.append(0, np.cumsum(taken, dtype=np.int64))

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        sizes, levels, left, level = [], [], np.arange(len(words)), 0
        while len(left):
            if level > 99:
                raise ValueError("the digests must be distinct")
            size = max(2, int(ROOM * len(left)))
            cell = (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left, level = left[~alone[cell]], level + 1
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    @classmethod
    def read(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool))

    def packed(self) -> bytes:
        return np.packbits(self.taken).tobytes()

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each member; any slot, or -1, of a digest that is not one."""
        out = np.full(len(words), -1, np.int64)
        left, base = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            cell = base + (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
            here = self.taken[cell]
            out[left[here]] = self.rank[cell[here]]
            left, base = left[~here], base + size
        return out


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised whole text; null counts as empty) and row, a number of each row. Written,
    so that rows keep their numbers."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 256):
            found = [hashlib.sha256(normalised(x)).digest() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    data = F.coalesce(F.encode(docs["text"].cast("string"), "utf-8"), F.lit(b""))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), data.alias("data")).mapInArrow(run, "doc_id long, digest binary")
    return scratch(out.withColumn("row", F.monotonically_increasing_id()), "digests")


def groups(digests: DataFrame) -> DataFrame:
    """One row per distinct digest: winner (doc_id, row), the largest id and of its rows the last, and n. Rows of a hot
    digest are counted where they are before they move."""
    return digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int):
    """Of a digest: by its first 7 bytes, which are random."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


@dataclass
class Index:
    """Shards: shard, sizes and taken (the perfect hash), digests (of all slots, one after the other), ids, rows, ns."""

    table: DataFrame
    shards: int

    @staticmethod
    def build(history: DataFrame) -> Index:
        """From groups (digest, winner, n) of distinct digests. The number of shards follows from theirs, so that none
        grows with the data."""
        history = scratch(history, "history")
        shards = 1 + history.count() // SHARD

        def pack(rows: pa.Table) -> pa.Table:
            words = as_words(rows.column("digest").to_pylist())
            found = PerfectHash.of(words)
            put = rows.take(pa.array(np.argsort(found.slots(words))))
            one = {"shard": rows.column("shard")[:1], "sizes": [found.sizes], "taken": [found.packed()], "digests": [b"".join(put.column("digest").to_pylist())]}
            return pa.table(one | {c + "s": pa.array([put.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("id", "row", "n")})

        schema = "shard int, sizes array<long>, taken binary, digests binary, ids array<long>, rows array<long>, ns array<long>"
        flat = history.select(_shard(shards).alias("shard"), "digest", F.col("winner.doc_id").alias("id"), F.col("winner.row").alias("row"), "n")
        table = scratch(flat.groupBy("shard").applyInArrow(pack, schema), "perfect")
        discard(history)
        return Index(table, shards)

    def save(self, path: str) -> None:
        self.table.withColumn("shards", F.lit(self.shards)).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        table = spark.read.parquet(path)
        found = table.agg(F.max("shards")).first()[0]
        return Index(table.drop("shards"), found or 1)

    def slots(self) -> DataFrame:
        """shard, slot, digest, winner, n."""
        x = self.table.select("shard", "digests", F.posexplode(F.arrays_zip("ids", "rows", "ns")).alias("slot", "x"))
        digest = F.substring("digests", F.col("slot") * 32 + 1, F.lit(32))
        return x.select("shard", "slot", digest.alias("digest"), F.struct(F.col("x.ids").alias("doc_id"), F.col("x.rows").alias("row")).alias("winner"), F.col("x.ns").alias("n"))

    def lookup(self, arriving: DataFrame) -> DataFrame:
        """Of groups (digest, winner, n) of distinct digests: shard, and the slot that holds the same 32 bytes, null where
        none does. Where more arrive than the history has, a shard meets them in several tasks."""
        more = 1 + arriving.count() // (SHARD * self.shards)

        def look(rows: pa.Table, shard: pa.Table) -> pa.Table:
            slot, same = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, bool)
            if rows.num_rows and shard.num_rows:
                words = as_words(rows.column("digest").to_pylist())
                kept = shard.slice(0, 1).to_pylist()[0]
                slot = PerfectHash.read(kept["sizes"], kept["taken"]).slots(words)
                same = (slot >= 0) & (as_words([kept["digests"]])[slot] == words).all(axis=1)
            return rows.append_column("slot", pa.array(slot.astype(np.int32), mask=~same))

        portion = F.pmod(F.xxhash64("digest"), F.lit(more)).cast("int")
        flat = arriving.select(_shard(self.shards).alias("shard"), portion.alias("portion"), "digest", F.col("winner.doc_id").alias("id"), F.col("winner.row").alias("row"), "n")
        schema = "shard int, portion int, digest binary, id long, row long, n long, slot int"
        table = self.table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(more - 1))).alias("portion"), "sizes", "taken", "digests")
        found = flat.groupBy("shard", "portion").cogroup(table.groupBy("shard", "portion")).applyInArrow(look, schema)
        return found.select("digest", "shard", "slot", F.struct(F.col("id").alias("doc_id"), "row").alias("winner"), "n")


def merged(index: Index, arriving: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Groups (digest, winner, n) of the history and what arrives together, and the tables to discard when they are read:
    repeats join the group in their slot, the others stand for themselves."""
    arriving = scratch(arriving, "arriving")
    found = scratch(index.lookup(arriving), "found")
    discard(arriving)
    hits = found.filter("slot IS NOT NULL").select("shard", "slot", F.col("winner").alias("new"), F.col("n").alias("more"))
    held = index.slots().join(hits, ["shard", "slot"], "left")
    held = held.select("digest", F.greatest("winner", F.coalesce("new", "winner")).alias("winner"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return held.union(found.filter("slot IS NULL").select("digest", "winner", "n")), [found]


def dedup(docs: DataFrame, historical) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. historical (a boolean column of doc_id)
    says which rows make the history; the others arrive. The result is the same for every choice.

    Texts are equal if they are after A-Z are lowered, null counting as empty. Of equal ones the largest doc_id stays
    (a null id only if all are null), of several rows with that id one. Digests stand for texts: two different texts with
    one SHA-256 are not known. An empty table gives none; further columns are not read. Text is read once, by a narrow
    stage; after it 44 bytes a row move. Rows of a hot digest are counted before they move, and get their group's row
    by broadcast (attached)."""
    rows = digested(docs)
    past = F.coalesce(historical, F.lit(False))
    index = Index.build(groups(rows.filter(past)))
    both, held = merged(index, groups(rows.filter(~past)))
    both = scratch(both, "groups")
    for x in (index.table, *held):
        discard(x)
    out = attached(rows, both, ["digest"], rows.count())
    return out.select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    # half of the ids, by hash, stands for what earlier runs have seen
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLES = {
    "op13_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
