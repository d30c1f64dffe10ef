"""Versions of a set of tables in one folder: every version is written beside the others and becomes the current one by
its manifest, which is written last. A job that dies in between leaves the version before as it was."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files that a bucketed table's terms are dealt into.
BUCKETS = 16


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, in order."""
    return [int(n[1:-5]) for n in _listed(spark, f"{path}/manifests") if n.startswith("v") and n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    fs, p = _files(spark, f"{path}/manifests/v{version:08d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], bucketed: dict[str, str] | None = None, buckets: int = BUCKETS, base: int | None = None, about: dict | None = None) -> int:
    """Write the tables as a new version and make it the current one; the number it got. bucketed: tables dealt into
    buckets by a column and sorted by it. base: the version that this one follows; if another has become current since, the
    commit fails and nothing changes. Tables may be made from the current version's: nothing is written over."""

    def follows() -> int:
        have = versions(spark, path)
        last = have[-1] if have else 0
        if base is not None and base != last:
            raise RuntimeError(f"version {base} is not the current one any more: {last} is")
        return last

    follows()
    folder, made = uuid.uuid4().hex, {}
    for name, t in tables.items():
        where = f"{path}/data/{folder}/{name}"
        by = (bucketed or {}).get(name)
        if by:
            label = f"quillspark_{folder}_{name}"
            t.repartition(buckets, by).write.option("compression", "zstd").bucketBy(buckets, by).sortBy(by).option("path", where).format("parquet").saveAsTable(label)
        else:
            t.write.option("compression", "zstd").parquet(where)
        made[name] = {"path": f"data/{folder}/{name}", "schema": t.schema.json(), "bucketed": by, "buckets": buckets if by else None}
    last = follows()
    fs, temporary = _files(spark, f"{path}/manifests/.{folder}")
    stream = fs.create(temporary, False)
    stream.write(bytearray(json.dumps({"tables": made, "about": about or {}}).encode()))
    stream.close()
    _, final = _files(spark, f"{path}/manifests/v{last + 1:08d}.json")
    if fs.exists(final) or not fs.rename(temporary, final):
        raise RuntimeError(f"version {last + 1} has been written by another job")
    return last + 1


def tables(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, DataFrame], dict]:
    """(number, tables by name, what the commit noted) of a version, the current one by default."""
    from pyspark.sql.types import StructType

    have = versions(spark, path)
    number = version if version is not None else have[-1] if have else None
    if number is None or number not in have:
        raise FileNotFoundError(f"no version {'' if number is None else number} below {path}")
    found = manifest(spark, path, number)
    out = {}
    for name, t in found["tables"].items():
        schema, where = StructType.fromJson(json.loads(t["schema"])), f"{path}/{t['path']}"
        if t["bucketed"]:
            label = f"quillspark_{t['path'].split('/')[1]}_{name}"
            if not spark.catalog.tableExists(label):  # another session wrote it
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
                place = where.replace("'", "\\'")
                spark.sql(f"CREATE TABLE {label} ({columns}) USING parquet CLUSTERED BY (`{t['bucketed']}`) SORTED BY (`{t['bucketed']}`) INTO {t['buckets']} BUCKETS LOCATION '{place}'")
            out[name] = spark.table(label)
        else:
            out[name] = spark.read.schema(schema).parquet(where)
    return number, out, found["about"]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last `keep` versions and what no version refers to, such as a dead job's tables; how many folders
    went. No job may be writing meanwhile."""
    have = versions(spark, path)
    used = {t["path"].split("/")[1] for v in have[-keep:] for t in manifest(spark, path, v)["tables"].values()}
    for v in have[:-keep]:
        fs, p = _files(spark, f"{path}/manifests/v{v:08d}.json")
        fs.delete(p, False)
    gone = [f for f in _listed(spark, f"{path}/data") if f not in used]
    for f in gone:
        for label in [t.name for t in spark.catalog.listTables() if t.name.startswith(f"quillspark_{f}_")]:
            spark.sql(f"DROP TABLE IF EXISTS {label}")
        fs, p = _files(spark, f"{path}/data/{f}")
        fs.delete(p, True)
    return len(gone)
