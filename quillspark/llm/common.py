"""Helpers shared by the training-data operators: code shipping, shared scratch tables, tiling of hot groups,
connected components."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that Python workers can import it wherever the
    driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    folder = tempfile.mkdtemp(prefix="quillspark-code-")
    path = os.path.join(folder, "quillspark_code.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._quillspark_shipped = True


def alone(mine: dict) -> None:
    """Empty what the other operators keep in this worker process and give the memory back: workers outlive a stage, and
    a pipeline's models and tables of words would add up."""
    freed = False
    for name, module in list(sys.modules.items()):
        held = getattr(module, "_LOADED", None) if name.startswith(__package__ + ".") else None
        if isinstance(held, dict) and held is not mine and held:
            held.clear()
            freed = True
    if freed:
        gc.collect()
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows: what is made of a part is freed before the next."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and Spark runs in one
    machine (tests) is a temporary folder made."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(sc, "_quillspark_shared", None)
    if made is None:
        made = sc._quillspark_shared = "file://" + tempfile.mkdtemp(prefix="quillspark-shared-")
    return made


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Queries run within leave no shuffle files behind. Else Spark keeps those of a finished query until the driver's
    collector finds that nothing refers to them, and a chain of jobs fills the executors' disks."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by scratch() that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, with marks after it if a column has it already."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def learns(doc_id, mod: int):
    """True for the rows that may be learned from: crc32 of the id as text, modulo mod, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod != 0, F.lit(False))


def held_out(doc_id, mod: int):
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == 0, F.lit(False))


#: A key with more than one in so many rows is joined by broadcast: there can be no more such keys than this.
HOT = 50_000


def attached(rows: DataFrame, table: DataFrame, keys: list[str], total: int, least: int = 256, shuffled: bool = False) -> DataFrame:
    """rows joined with table (keys, n: how many rows have them, more columns), so that no key's rows land in one task:
    those of keys with over max(least, total / HOT) rows, at most HOT keys or what least allows in small tables, meet
    their row of table by broadcast where they are; all others by a shuffle, in which no key has more rows than that.
    shuffled: never broadcast the rest of table instead, so that plans are alike at every size. Keys must not be null;
    rows whose keys table lacks are dropped."""
    limit = max(least, total // HOT)
    hot, cold = table.filter(F.col("n") > limit), table.filter(F.col("n") <= limit)
    here = rows.join(F.broadcast(hot), keys)
    cold = cold.hint("merge") if shuffled else cold
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return here.select(*rows.columns, *(c for c in table.columns if c not in keys)).unionByName(rest.select(*rows.columns, *(c for c in table.columns if c not in keys)))


def tiled(df: DataFrame, group: list[str], by: str, tile: int, held: list[DataFrame], weight: str | None = None, heavy: int = 1) -> tuple[DataFrame, int]:
    """Deal the rows of every group into blocks of at most about `tile` rows (fewer in small tables, so that all tasks
    have some) and repeat a row for each pair of blocks that it takes part in. Adds tile_i <= tile_j (the pair) and
    tile_own (the row's own block). Two rows of one group meet in the pair of their blocks; rows of one block meet where
    tile_i == tile_j. Groups of one row are dropped: they have no pairs. No group, however large, lands in one task,
    neither here (attached) nor where the caller deals the result by group and tiles, into as many partitions as the
    second result says. held: gets the table of group sizes, to discard when the result has been read. weight: a column
    of which a block gets about `heavy` at most, if its rows are alike."""
    weighed = F.sum(weight) if weight else F.lit(0)
    sizes = scratch(df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), weighed.cast("long").alias("_w")).filter("n > 1"), "sizes")
    held.append(sizes)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tile = min(tile, max(256, total // 512))
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.least(F.ceil(F.col("_w") / F.lit(heavy)), F.col("n")))
    x = attached(df, sizes.select(*group, "n", blocks.cast("int").alias("_t")), group, total, tile)
    x = x.drop("n")
    x = x.withColumn("tile_own", F.pmod(F.xxhash64(F.col(by), F.lit(17)), F.col("_t")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    x = x.withColumn("tile_i", F.least("tile_own", "_o")).withColumn("tile_j", F.greatest("tile_own", "_o"))
    return x.drop("_t", "_o"), max(32, total // 8_192)


def spanning(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (name, smallest name of its component) that connect what the links a-b (row numbers) connect: one per row
    at most."""
    order = np.argsort(names, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(names))
    root, x, y = np.arange(len(names)), place[a], place[b]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[order[moved]], names[order[root[moved]]]


def runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int, most: int = 64 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream that is sorted by its first columns (integers, without nulls): tables of about so many
    rows, or so many bytes, more where a group is larger, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def small(batches):
        for b in batches:
            step = max(1, int(b.num_rows * most / max(1, 4 * b.nbytes)))
            yield from (b.slice(i, step) for i in range(0, b.num_rows, step))

    def cut(table: pa.Table, last: bool):
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in range(keys):
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        at = table.num_rows if last else int(np.flatnonzero(change)[-1])
        return table.slice(0, at), np.cumsum(change[:at]) - 1, table.slice(at)

    weight = 0
    for b in small(batches):
        held.append(b)
        size += b.num_rows
        weight += b.nbytes
        if size >= rows or weight >= most:
            whole, group, rest = cut(pa.Table.from_batches(held), False)
            if whole.num_rows:
                yield whole, group
            held, size, weight = rest.to_batches(), rest.num_rows, rest.nbytes
            if not whole.num_rows:
                rows, most = max(rows, 2 * size), max(most, 2 * weight)
    if size:
        whole, group, _ = cut(pa.Table.from_batches(held), True)
        yield whole, group


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star steps: (node, component),
    component being the smallest id reachable. Only nodes with an edge appear. Each round cuts lineage with a table in
    the shared folder; edges are reduced as they go, and nothing but a count reaches the driver. The edges of a hub are
    spread over all tasks (attached)."""
    both = lambda d: d.union(d.select("v", "u")).toDF("u", "v")

    def mark(d: DataFrame) -> tuple:
        """Of a table of edges: twice their number, a hash, the most edges of a node."""
        each = both(d).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return tuple(each.agg(F.sum("n"), F.sum("h"), F.max("n")).first())

    def least_of(d: DataFrame, own: bool, total: int, most: int) -> DataFrame:
        """d with the smallest v of each u (of u too, if own) as m. Where no node has many edges, a window does, without
        the broadcasts whose plans and tables fill the driver. most: no u has more rows."""
        if most <= max(256, total // HOT):
            low = F.min("v").over(W.partitionBy("u"))
            return d.select("u", "v", (F.least(low, "u") if own else low).alias("m"))
        low = d.groupBy("u").agg((F.least(F.min("v"), F.first("u")) if own else F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        return attached(d, low, ["u"], total)

    now = scratch(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    done = mark(now)
    while done[0]:
        large = least_of(both(now), True, done[0], done[2]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = least_of(large, False, done[0] // 2, done[2])  # a node has no more of these than it had edges
        star = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        new = scratch(star, "edges")
        found = mark(new)
        discard(now)
        now = new
        if found == done:
            break
        done = found
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
