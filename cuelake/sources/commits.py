"""Tables that are replaced in one step: data folders that nothing touches again, and numbered manifests that name them.

A writer puts its rows into a new folder and, when all are there, renames a finished manifest to the next number. Readers
take the highest number, so they see the state before or after, also while a writer runs or after it failed. Of two
writers that want the same number one fails. All files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "_manifests", "data-"
#: Earlier versions whose rows stay for readers that have begun.
KEPT = 2


def _files(spark: SparkSession, folder: str) -> tuple[Any, Any, Any]:
    """Hadoop's context and file system of the folder, and a maker of paths in it."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(conf)
    root = system.makeQualified(root)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
    return context, system, lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([root.toString(), *parts]))


def _listed(system: Any, path: Any) -> list[str]:
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that were written, in order."""
    _, system, path = _files(spark, folder)
    return [int(n[:-5]) for n in _listed(system, path(MANIFESTS)) if n.endswith(".json")]


def manifest(spark: SparkSession, folder: str, version: int) -> dict:
    """What a version's manifest says: its number, data folder, rows and notes."""
    text = spark.read.option("wholetext", True).text(f"{folder}/{MANIFESTS}/{version:020d}.json").first()[0]
    return json.loads(text)


def commit(df: DataFrame, folder: str, expect: int | None = None, by: list[str] | None = None, **notes: Any) -> int:
    """Write df as the next version and switch readers to it; its number.

    expect: the version that df was made from; if another has come since, or comes meanwhile, ValueError is raised and
    nothing changes. df may read the folder itself. by: columns to write parts by. An empty df is a version too.
    """
    spark = df.sparkSession
    context, system, path = _files(spark, folder)
    before = versions(spark, folder)
    last = before[-1] if before else -1
    if expect is not None and expect != last:
        raise ValueError(f"version {last} is newer than {expect}")
    name = DATA + uuid.uuid4().hex
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path(name).toString())
    rows = spark.read.schema(df.schema).parquet(path(name).toString()).count()
    told = {"version": last + 1, "data": name, "rows": rows, "schema": df.schema.jsonValue(), **notes}
    system.mkdirs(path(MANIFESTS))
    draft = path(MANIFESTS, f".{uuid.uuid4().hex}.draft")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps(told).encode()))
        out.hsync()
    finally:
        out.close()
    none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    renames = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = none
    try:
        context.rename(draft, path(MANIFESTS, f"{last + 1:020d}.json"), renames)
    except Exception as e:
        system.delete(draft, False)
        system.delete(path(name), True)
        raise ValueError(f"version {last + 1} was written by another") from e
    return last + 1


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of another one. ValueError if there is none."""
    from pyspark.sql.types import StructType

    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{folder} has no version" + ("" if version is None else f" {version}"))
    told = manifest(spark, folder, known[-1] if version is None else version)
    _, _, path = _files(spark, folder)
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(path(told["data"]).toString())


def clean(spark: SparkSession, folder: str, kept: int = KEPT) -> list[str]:
    """Removes what failed writes left and all but the newest version and `kept` before it; the names removed.

    Not to be run while a writer is at work, whose folder no manifest names yet.
    """
    _, system, path = _files(spark, folder)
    known = versions(spark, folder)
    stay = known[-1 - kept :] if known else []
    named = {manifest(spark, folder, n)["data"] for n in stay}
    gone = [n for n in _listed(system, path()) if n.startswith(DATA) and n not in named]
    stale = [f"{MANIFESTS}/{n}" for n in _listed(system, path(MANIFESTS)) if n.endswith(".draft") or (n.endswith(".json") and int(n[:-5]) not in stay)]
    for name in [*stale, *gone]:
        system.delete(path(name), True)
    return [*gone, *stale]
