"""How tables are laid out over tasks."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tables of fewer bytes are dealt anew.
SMALL = 64 << 20


def balanced(table: DataFrame) -> DataFrame:
    """A small table is often one row group, which one task reads: its rows are dealt over all cores. Large ones have row
    groups enough, and moving them would cost more than it gains; they stay as they are. Order is lost."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= SMALL:
        return table
    return table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism)


def bounded(table: DataFrame, rows: int = 50_000) -> bool:
    """True if the table has at most so many rows, so that it may be broadcast."""
    return table.limit(rows + 1).count() <= rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only in one machine, where it is unset, is a
    temporary one made."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(sc, "_quillspark_folder", None)
    if made is None:
        made = sc._quillspark_folder = "file://" + tempfile.mkdtemp(prefix="quillspark-tables-")
    return made


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for a table as it is now: of its path and its files' names, sizes and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p))
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:24]
