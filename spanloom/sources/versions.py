"""Versioned tables of projects: write beside the old data, then switch one pointer.

A store is a folder of tables (``docs``, ``spans``, ...), each Parquet
partitioned by ``project`` and ``_version``. What a project consists of stands in
``<store>/pointers/project=<name>/<number>``, one JSON object
``{"<table>": "<version>"}``; the highest complete number holds. A change writes new
versions next to the old ones (:func:`stage`) and ends with the creation of the next
pointer (:func:`commit`), which switches all its tables at once. Whatever fails
before leaves files that nothing points to; a job may read the tables that it
replaces. A pointer is created, never overwritten (on an object store a file appears
whole, elsewhere an unfinished one is no JSON object and is passed over), so of
two writers that start from one state the second is refused.

Old versions stay until :func:`prune` removes them: a query that has begun keeps its files.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

POINTERS = "pointers"
#: Partition column of the versions; the data must not have a column of this name.
VERSION = "_version"


class ChangedMeanwhile(RuntimeError):
    """Another writer has replaced the same table of the project since this change began."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def project_folder(spark: SparkSession, project: str | None) -> str:
    """The folder name of a project, escaped as Spark escapes partition values."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.getPartitionPathString("project", project)


def _pointers(spark: SparkSession, store: str, project: str | None) -> list:
    """The project's pointer files, the newest first."""
    folder, fs = _path(spark, f"{store}/{POINTERS}/{project_folder(spark, project)}")
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
    return sorted(found, key=lambda p: int(p.getName()), reverse=True)


def current(spark: SparkSession, store: str, project: str | None) -> dict[str, str]:
    """table -> version of a project; empty if there is no such project."""
    for path in _pointers(spark, store, project):
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            continue  # its writer did not finish
        if isinstance(found, dict):
            return found
    return {}


def new_version() -> str:
    return uuid.uuid4().hex


def stage(df: DataFrame, store: str, table: str, version: str) -> None:
    """Write the rows as a version of their projects; nobody reads it before it is committed."""
    if VERSION in df.columns:
        raise ValueError(f"a column {VERSION} would be lost")
    (df.withColumn(VERSION, F.lit(version)).write.mode("append")
     .partitionBy("project", VERSION).parquet(f"{store}/{table}"))


def staged_projects(spark: SparkSession, store: str, table: str, version: str) -> list[str | None]:
    """The projects that have rows in a version."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    pattern, fs = _path(spark, f"{store}/{table}/project=*/{VERSION}={version}")
    names = [utils.unescapePathName(s.getPath().getParent().getName().split("=", 1)[1])
             for s in fs.globStatus(pattern) or []]
    return [None if n == utils.DEFAULT_PARTITION_NAME() else n for n in names]


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if it does."""
    target, fs = _path(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as e:
        if fs.exists(target):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commit(spark: SparkSession, store: str, project: str | None, base: dict[str, str],
           changes: dict[str, str]) -> None:
    """Point the project to the new versions of some tables, all at once.

    ``base`` is what :func:`current` said when the change began.
    """
    while True:
        now = current(spark, store, project)
        if any(now.get(t) != base.get(t) for t in changes):
            raise ChangedMeanwhile(f"{project!r} in {store} was changed by another writer")
        newest = _pointers(spark, store, project)
        number = int(newest[0].getName()) + 1 if newest else 1
        if _create(spark, f"{store}/{POINTERS}/{project_folder(spark, project)}/{number:010d}",
                   json.dumps(now | changes)):
            return


def replace(df: DataFrame, store: str, table: str, project: str | None = None, named: bool = False) -> None:
    """Replace the projects of ``df`` in one table; with ``named`` also ``project``, if it has no row."""
    spark = df.sparkSession
    version = new_version()
    base = {project: current(spark, store, project)} if named else {}
    stage(df, store, table, version)
    for p in {*staged_projects(spark, store, table, version), *base}:
        commit(spark, store, p, base.get(p, current(spark, store, p)), {table: version})


def read(spark: SparkSession, store: str, table: str, project: str | None, schema: str | None = None,
         ) -> DataFrame | None:
    """The current version of one project's table; None if the project does not have it.

    Only the version's folder is listed and read. A version without rows needs the schema.
    """
    version = current(spark, store, project).get(table)
    if version is None:
        return None
    folder = f"{store}/{table}/{project_folder(spark, project)}/{VERSION}={version}"
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        if schema is None:
            raise LookupError(f"{table} of {project!r} in {store} has no rows and no given schema")
        return spark.createDataFrame([], schema)
    return _reader(spark, f"{store}/{table}", folder, schema).parquet(folder).drop(VERSION)


def _reader(spark: SparkSession, base: str, folder: str, schema: str | None):
    """A reader of a table's folder whose partition values stay text (``007`` is not 7)."""
    found = (spark.read.option("basePath", base).parquet(folder).schema if schema is None
             else StructType.fromDDL(schema))
    fields = [f for f in found if f.name not in ("project", VERSION)]
    keys = [StructField(c, StringType()) for c in ("project", VERSION)]
    return spark.read.option("basePath", base).schema(StructType(fields + keys))


def read_all(spark: SparkSession, store: str, table: str, schema: str | None = None) -> DataFrame:
    """The current versions of every project's table: a join with the pointers, which prunes partitions."""
    pointers = (spark.read.schema("value string, project string").option("wholetext", True)
                .text(f"{store}/{POINTERS}"))
    known = pointers.select("project", F.col("_metadata.file_name").cast("bigint").alias("number"),
                            F.from_json("value", "map<string,string>").alias("tables")).where("tables is not null")
    known = known.groupBy("project").agg(F.max_by("tables", "number").alias("tables"))
    known = known.select(F.col("project").alias("_p"), F.col("tables").getItem(table).alias("_v"))
    folder = f"{store}/{table}"
    rows = _reader(spark, folder, folder, schema).parquet(folder)
    return rows.join(known, rows["project"].eqNullSafe(known["_p"]) & (rows[VERSION] == known["_v"]),
                     "left_semi").drop(VERSION)


def prune(spark: SparkSession, store: str, project: str | None) -> int:
    """Remove the project's versions and pointers that no longer hold; the number of folders removed.

    For times without writers or long-running readers of the project.
    """
    now, removed = current(spark, store, project), 0
    root, fs = _path(spark, store)
    for s in fs.listStatus(root):
        table = s.getPath().getName()
        folder, _ = _path(spark, f"{store}/{table}/{project_folder(spark, project)}")
        if table == POINTERS or not fs.exists(folder):
            continue
        for v in fs.listStatus(folder):
            if v.getPath().getName() != f"{VERSION}={now.get(table)}":
                removed += fs.delete(v.getPath(), True)
    held = False
    for path in _pointers(spark, store, project):
        if held:
            fs.delete(path, False)
        held = held or fs.getFileStatus(path).getLen() > 0
    return removed
