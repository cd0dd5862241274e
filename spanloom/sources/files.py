"""Readers and writers. Native tables are versioned Parquet by ``project`` (:mod:`spanloom.sources.versions`).

JSON interchange formats:

* dataset: CSV (header, RFC-4180 quotes, optional BOM, embedded newlines) or a
  JSON array of records; every column is read as text.
* span store: JSON Lines ``{"project", "doc_id", "annotations": [...]}``
  (splittable). The single-object store ``{"0": [...], ...}`` can be imported
  with :func:`read_legacy_store`; such a file is one JSON value, so each file
  is read by one task -- use it for one-time imports only.
* vocabulary / label map: one JSON object ``{key: [terms]}`` per file, file
  name ``<project>_vocab.json`` / ``<project>_label_map.json``; or JSON Lines
  ``{"key": k, "terms": [...]}`` for large vocabularies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spanloom.operators.ingest import (empty_anns, explode_spans, nest_spans, parse_annotations,
                                      require_query, with_doc_id)
from spanloom.schema import DEFAULT_LABEL_MAP, LABEL_MAP, REJECTS, SPANS, VOCAB
from spanloom.session import materialize
from spanloom.sources import csv_records, versions

KEYS = ("project", "doc_id")
#: File and place of a record while a dataset is read.
PLACE = ("_file", "_record")
#: The text of what a JSON reader could not read.
BAD = "_unreadable"


def _project_from_name(suffix: str):
    """Project name = file name with the artefact suffix removed (suffix only).

    ``_metadata.file_name`` is percent-encoded; a plus sign in it is literal.
    """
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))
    return F.regexp_extract(name, r"(?s)^(.*)" + suffix + "$", 1)


def _table(path: str) -> tuple[str, str]:
    """Store and table name of a table's path."""
    store, _, name = path.rstrip("/").rpartition("/")
    return store, name


# ------------------------------------------------------------------ datasets
def _dataset(df: DataFrame, project: str, key: str | None, order_by: list[str] | None) -> DataFrame:
    df = with_doc_id(require_query(df), key=key, order_by=order_by)
    return df.withColumn("project", F.lit(project)).select("project", "doc_id", *[
        c for c in df.columns if c not in ("project", "doc_id", *PLACE)])


def _rejected(reasons: DataFrame, project: str) -> DataFrame:
    """Rejects without a row identity; ``elem`` is the record's number in its file, where it has one."""
    elem = F.col("record") if "record" in reasons.columns else F.lit(None)
    return reasons.select(F.lit(project).alias("project"), F.lit(None).cast("bigint").alias("doc_id"),
                          elem.cast("bigint").alias("elem"), "reason")


def read_docs_csv_checked(spark: SparkSession, path: str, project: str, order_by: list[str] | None = None,
                          key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV dataset -> (``project, doc_id, query, <other columns as text>``, rejects).

    With ``key``, that column is the row identity and is kept as it was read; without it and
    ``order_by`` rows are numbered in file order. Quoted records may span lines; files are split all
    the same (:mod:`spanloom.sources.csv_records`, which gives the reasons of rejects).
    """
    rows, rejects = csv_records.read(spark, path)
    return _dataset(rows, project, key, order_by or (None if key else list(PLACE))), _rejected(rejects, project)


def read_docs_csv(spark: SparkSession, path: str, project: str,
                  order_by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """The rows of :func:`read_docs_csv_checked`."""
    return read_docs_csv_checked(spark, path, project, order_by, key)[0]


def read_docs_json_checked(spark: SparkSession, path: str, project: str, order_by: list[str] | None = None,
                           multiline: bool = True, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON array of records (or JSON Lines with ``multiline=False``) -> (dataset, rejects).

    Column names come from one inference pass; every column is then read as
    text, nested values as the JSON text they had (nothing is re-typed). A line (or, of an
    array, a file) that cannot be read is one reject, ``invalid_line`` (``invalid_file``).
    """
    reader = spark.read.option("multiLine", multiline).option("columnNameOfCorruptRecord", BAD)
    names = [c for c in reader.option("primitivesAsString", True).json(path).columns if c != BAD]
    df = reader.schema(StructType([StructField(c, StringType()) for c in [*names, BAD]])).json(path)
    place = [F.col("_metadata.file_path").alias(PLACE[0]), F.monotonically_increasing_id().alias(PLACE[1])]
    df = materialize(df.select("*", *place), "json-dataset")
    bad = df.where(F.col(BAD).isNotNull()).select(
        F.lit("invalid_file" if multiline else "invalid_line").alias("reason"))
    return (_dataset(df.where(F.col(BAD).isNull()).drop(BAD), project, key, order_by or (None if key else list(PLACE))),
            _rejected(bad, project))


def read_docs_json(spark: SparkSession, path: str, project: str,
                   order_by: list[str] | None = None, multiline: bool = True,
                   key: str | None = None) -> DataFrame:
    """The rows of :func:`read_docs_json_checked`."""
    return read_docs_json_checked(spark, path, project, order_by, multiline, key)[0]


def json_layout(spark: SparkSession, path: str) -> str:
    """``json`` if every file starts with a bracket (one array), ``jsonl`` if none does; else an error.

    Opens each file for its first characters only.
    """
    conf = spark._jsc.hadoopConfiguration()
    kinds = set()
    for name in spark.read.format("binaryFile").load(path).inputFiles():
        file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        stream = file.getFileSystem(conf).open(file)
        try:
            while True:
                c = stream.read()
                if c == -1:
                    break
                if c not in b" \t\r\n\xef\xbb\xbf":
                    kinds.add(c == ord("["))
                    break
        finally:
            stream.close()
    if len(kinds) > 1:
        raise ValueError(f"{path} mixes JSON arrays and JSON Lines")
    return "jsonl" if kinds == {False} else "json"


def write_docs_csv(df: DataFrame, path: str) -> None:
    """CSV with header and doubled quotes (many files; one per partition)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("quote", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


# ------------------------------------------------------------------ span store
def write_spans(spans: DataFrame, path: str, project: str | None = None) -> None:
    """Native store: flat spans, Parquet, by project, as the table ``path`` of a versioned store.

    Replaces the projects being written; with ``project`` also when no span is left of it. The spans
    may be read from the table itself; if anything fails, the old ones stay.
    """
    store, name = _table(path)
    versions.replace(spans, store, name, project, named=project is not None)


def read_spans(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """The current spans of one project or of all; a project without any gives no rows."""
    store, name = _table(path)
    if project is None:
        return versions.read_all(spark, store, name, SPANS)
    found = versions.read(spark, store, name, project, SPANS)
    return spark.createDataFrame([], SPANS) if found is None else found


def write_annotation_store(spans: DataFrame, path: str) -> None:
    """JSON Lines interchange: one row per (project, doc_id) with its list."""
    (nest_spans(spans).withColumnRenamed("anns", "annotations")
     .write.mode("overwrite").json(path))


def read_annotation_store(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines store -> flat spans (see :func:`read_annotation_store_checked`)."""
    return read_annotation_store_checked(spark, path)[0]


def read_annotation_store_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines store -> (flat spans, rejects).

    Lists go through :func:`parse_annotations`, so a legacy scalar mapping is
    normalised and a bad element is rejected. A line that is no JSON object is a
    reject without keys (``invalid_line``).
    """
    schema = StructType([StructField("project", StringType()), StructField("doc_id", StringType()),
                         StructField("annotations", StringType()), StructField("_bad", StringType())])
    lines = materialize(spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path),
                        "store")
    good = lines.where("_bad is null").withColumn("doc_id", F.expr("try_cast(doc_id as bigint)"))
    docs, rejects = parse_annotations(good.drop("_bad"))
    bad = lines.where("_bad is not null").select(
        "project", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("elem"),
        F.lit("invalid_line").alias("reason"))
    return explode_spans(docs), rejects.unionByName(bad)


def read_legacy_store(spark: SparkSession, path: str, project: str | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """Single-object store files ``{"<row>": [...]}`` -> (flat spans, rejects).

    The project is the given name, else the partition folder, else the file name minus
    ``_annotations.json``. One file = one JSON value = one task. A file that is no JSON object
    (``invalid_file``) and a key that is no row number (``invalid_key``) are rejects.
    """
    raw = _whole_files(spark, path, project, "_annotations.json").select(
        "project", _objects(F.col("value"), "map<string,string>").alias("m"))
    bad = raw.where("m is null").select("project", F.lit("invalid_file").alias("reason"))
    rows = raw.select("project", F.explode("m").alias("k", "annotations"))
    number = F.expr("try_cast(k as bigint)")
    rows = rows.select("project", number.alias("doc_id"), "annotations")
    docs, rejects = parse_annotations(rows.where("doc_id is not null"))
    bad = bad.unionByName(rows.where("doc_id is null").select("project", F.lit("invalid_key").alias("reason")))
    none = F.lit(None).cast("bigint")
    return explode_spans(docs), rejects.unionByName(
        bad.select("project", none.alias("doc_id"), none.alias("elem"), "reason"))


def write_legacy_store(spans: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Single-object store files, by project; a file has the lists of at most so many consecutive row numbers."""
    nested = nest_spans(spans).where("doc_id is not null")
    entry = F.struct(F.col("doc_id").cast("string").alias("key"), F.to_json("anns").alias("value"))
    files = nested.groupBy("project", F.floor(F.col("doc_id") / rows_per_file).alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"))
    pair = F.transform("entries", lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    (files.select("project", F.concat(F.lit("{"), F.array_join(pair, ","), F.lit("}")).alias("value"))
     .write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("project").text(path))


# ------------------------------------------------------------------ vocabulary
def _project_of(df: DataFrame, project: str | None, suffix: str):
    """The given name, else the partition folder, else the file name."""
    return (F.lit(project) if project is not None else
            F.col("project") if "project" in df.columns else _project_from_name(suffix))


def _whole_files(spark: SparkSession, path: str, project: str | None, suffix: str) -> DataFrame:
    """project, file, value (the whole text) of every file; the reader itself passes over empty files."""
    df = spark.read.option("wholetext", True).text(path)
    found = df.select(_project_of(df, project, suffix).alias("project"),
                      F.col("_metadata.file_path").alias("file"), "value")
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(u)) for u in df.inputFiles()]
    empty = [(str(p.getName()), str(p)) for p in paths if p.getFileSystem(conf).getFileStatus(p).getLen() == 0]
    if not empty:
        return found
    name = F.lit(project) if project is not None else F.regexp_extract("name", r"(?s)^(.*?)(" + suffix + ")?$", 1)
    return found.unionByName(spark.createDataFrame(empty, "name string, file string").select(
        name.alias("project"), "file", F.lit("").alias("value")))


def _objects(text, kind: str):
    """The members of a text that is exactly one JSON object, else null."""
    text = F.regexp_replace(text, "^\ufeff", "")
    value = F.try_parse_json(text)
    # The parser stops after the first value: inside a list the text must still be one value.
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    whole = F.schema_of_variant(value).startswith("OBJECT") & (F.size(listed) == 1)
    return F.when(F.coalesce(whole, F.lit(False)), F.from_json(text, kind))


def _read_key_lists(spark: SparkSession, path: str, project: str | None, suffix: str,
                    fmt: str) -> tuple[DataFrame, DataFrame]:
    """(project, key, pos, term) and (project, file, key, reason)."""
    file = F.col("_metadata.file_path").alias("file")
    if fmt == "lines":
        found = spark.read.option("columnNameOfCorruptRecord", BAD).json(path).columns
        own = [StructField("project", StringType())] * ("project" in found)
        df = spark.read.schema(StructType([*own, *[StructField(c, StringType()) for c in ("key", "terms", BAD)]])) \
            .option("columnNameOfCorruptRecord", BAD).json(path)
        df = materialize(df.select(_project_of(df, project, suffix).alias("project"), file, "key",
                                   F.col("terms").alias("value"), BAD), "key-lists")
        bad = df.where(F.col(BAD).isNotNull()).select("project", "file", "key", F.lit("invalid_line").alias("reason"))
        pairs = df.where(F.col(BAD).isNull())
        kind = F.when(F.col("value").isNotNull(), F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit("STRING")))
    else:
        df = _whole_files(spark, path, project, suffix)
        df = df.select("project", "file", _objects(F.col("value"), "map<string,string>").alias("texts"),
                       F.try_variant_get(F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")), "$",
                                         "map<string,variant>").alias("kinds"))
        bad = df.where("texts is null").select("project", "file", F.lit(None).cast("string").alias("key"),
                                               F.lit("invalid_file").alias("reason"))
        pairs = df.select("project", "file", "kinds", F.explode("texts").alias("key", "value"))
        kind = F.schema_of_variant(F.col("kinds")[F.col("key")])
    pairs = pairs.withColumn("kind", F.coalesce(kind, F.lit("VOID")))
    terms = (F.when(F.col("kind").startswith("ARRAY"), F.from_json("value", "array<string>"))
             .when(F.col("kind") == "VOID", F.lit(None).cast("array<string>"))
             .otherwise(F.array("value")))
    wrong = F.col("kind").startswith("OBJECT") | F.col("key").isNull()
    bad = bad.unionByName(pairs.where(wrong).select(
        "project", "file", "key", F.when(F.col("key").isNull(), "no_key").otherwise("not_list").alias("reason")))
    return pairs.where(~wrong).select("project", "key", F.posexplode_outer(terms).alias("pos", "term")), bad


def _strict(rows: DataFrame, bad: DataFrame, path: str) -> DataFrame:
    """The rows, or an error that names what could not be read."""
    first = bad.limit(5).collect()
    if first:
        raise ValueError(f"{path}: " + "; ".join(f"{r['reason']} in {r['file']}, key {r['key']}" for r in first))
    return rows


def read_vocab_checked(spark: SparkSession, path: str, project: str | None = None,
                       fmt: str = "object") -> tuple[DataFrame, DataFrame]:
    """Vocabulary file(s) -> (``project, key, pos, term``, rejects ``project, file, key, reason``).

    Non-string JSON values keep their JSON text (``1.0`` -> ``"1.0"``); a scalar in place of a list is
    a list of one term, null an empty one. Rejects: ``invalid_file``, ``invalid_line``, ``not_list``
    (an object in place of a list), ``no_key``.
    """
    rows, bad = _read_key_lists(spark, path, project, "_vocab.json", fmt)
    return rows.select("project", "key", F.col("pos").cast("int"), "term"), bad


def read_vocab(spark: SparkSession, path: str, project: str | None = None,
               fmt: str = "object") -> DataFrame:
    """The rows of :func:`read_vocab_checked`; anything that cannot be read is an error."""
    return _strict(*read_vocab_checked(spark, path, project, fmt), path)


def read_label_map_checked(spark: SparkSession, path: str, project: str | None = None,
                           fmt: str = "object") -> tuple[DataFrame, DataFrame]:
    """Label map file(s) -> (``project, label, pos, category``, rejects as of a vocabulary)."""
    rows, bad = _read_key_lists(spark, path, project, "_label_map.json", fmt)
    return rows.select("project", F.col("key").alias("label"), F.col("pos").cast("int"),
                       F.col("term").alias("category")), bad


def read_label_map(spark: SparkSession, path: str, project: str | None = None,
                   fmt: str = "object") -> DataFrame:
    """The rows of :func:`read_label_map_checked`; anything that cannot be read is an error."""
    return _strict(*read_label_map_checked(spark, path, project, fmt), path)


def default_label_map(projects: DataFrame) -> DataFrame:
    """The default label -> categories map for every given project."""
    entries = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(i).alias("pos"), F.lit(cat).alias("category"))
        for label, cats in DEFAULT_LABEL_MAP.items() for i, cat in enumerate(cats)])
    return (projects.select("project").distinct()
            .select("project", F.explode(entries).alias("e"))
            .select("project", "e.label", "e.pos", "e.category"))


def vocab_lines(vocab: DataFrame, key_col: str = "key", term_col: str = "term",
                name_key: str = "key", name_terms: str = "terms") -> DataFrame:
    """One JSON line per (project, key): ``{"key":..,"terms":[..]}``, terms by pos."""
    g = vocab.groupBy("project", key_col).agg(
        F.array_sort(F.collect_list(F.when(F.col(term_col).isNotNull(),
                                           F.struct("pos", term_col)))).alias("_l"))
    return g.select("project", F.col(key_col).alias("key"), F.to_json(F.struct(
        F.col(key_col).alias(name_key),
        F.transform("_l", lambda x: x[term_col]).alias(name_terms))).alias("json"))


def write_vocab(vocab: DataFrame, path: str, fmt: str = "lines") -> None:
    """Write a vocabulary per project (``lines``: splittable JSON Lines;
    ``object``: one ``{key: [terms]}`` object per project)."""
    lines = vocab_lines(vocab)
    if fmt == "lines":
        (lines.select("project", "json").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("project").text(path))
        return
    g = vocab.groupBy("project", "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(),
                                           F.struct("pos", "term")))).alias("_l"))
    obj = g.groupBy("project").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "key", F.transform("_l", lambda x: x["term"]))))).alias("json"))
    (obj.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("project").text(path))


def write_label_map(label_map: DataFrame, path: str, fmt: str = "lines") -> None:
    """Write a label map per project, in the formats of :func:`write_vocab`."""
    write_vocab(label_map.select("project", F.col("label").alias("key"), "pos",
                                 F.col("category").alias("term")), path, fmt)


# ------------------------------------------------------------------ export
def export_csv(exported: DataFrame, path: str) -> None:
    """Write ``export_annotations`` output as CSV (header, doubled quotes)."""
    write_docs_csv(exported.drop("project") if "project" in exported.columns else exported, path)


# ------------------------------------------------------------------ projects
def save_vocab(spark: SparkSession, root: str, project: str, vocab: DataFrame) -> None:
    """Save or overwrite the vocabulary of a project under ``root``, also by nothing."""
    versions.replace(vocab.where(F.col("project") == project).select("project", "key", "pos", "term"),
                     root, "vocab", project, named=True)


def save_label_map(spark: SparkSession, root: str, project: str, label_map: DataFrame) -> None:
    """Save or overwrite the label map of a project under ``root``, also by nothing."""
    versions.replace(label_map.where(F.col("project") == project).select("project", "label", "pos", "category"),
                     root, "label_map", project, named=True)


def ingest_project(spark: SparkSession, data_path: str, project: str, root: str,
                   vocab_path: str | None = None, label_map_path: str | None = None,
                   order_by: list[str] | None = None, key: str | None = None,
                   fmt: str | None = None) -> dict[str, DataFrame]:
    """Create or replace one project under ``root``.

    Reads the dataset once (``fmt``: ``csv``, ``json`` for one array per file,
    ``jsonl``; by default from the suffix, and for ``.json`` from the files'
    first character), parses its ``annotations`` column if any (else empty
    lists), and writes docs, spans and rejects as new versions
    (:mod:`spanloom.sources.versions`). A vocabulary or label map is replaced if a file is given. One
    pointer switches all of them: until then, and if anything fails, the project
    is what it was before.
    """
    base = versions.current(spark, root, project)
    suffix = data_path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt is None:
        fmt = {"json": "json?", "jsonl": "jsonl", "ndjson": "jsonl"}.get(suffix, "csv")
    if fmt in ("json", "json?"):
        found = json_layout(spark, data_path)
        if fmt == "json" and found != "json":
            raise ValueError(f"{data_path} holds JSON Lines, not an array; use fmt='jsonl'")
        fmt = found
    if fmt == "csv":
        docs, unread = read_docs_csv_checked(spark, data_path, project, order_by, key=key)
    elif fmt in ("json", "jsonl"):
        docs, unread = read_docs_json_checked(spark, data_path, project, order_by, multiline=fmt == "json", key=key)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    docs = materialize(docs, "dataset")
    if "annotations" in docs.columns:
        parsed, rejects = parse_annotations(docs)
        spans = explode_spans(parsed)
        docs = docs.drop("annotations")
    else:
        spans = explode_spans(docs.withColumn("anns", empty_anns()))
        rejects = spark.createDataFrame([], REJECTS)
    rejects = rejects.unionByName(unread)
    tables = {"docs": docs, "spans": spans, "rejects": rejects}
    if vocab_path:
        tables["vocab"] = read_vocab(spark, vocab_path, project)
    if label_map_path:
        tables["label_map"] = read_label_map(spark, label_map_path, project)
    version = versions.new_version()
    for name, df in tables.items():
        versions.stage(df, root, name, version)
    versions.commit(spark, root, project, base, {name: version for name in tables})
    return load_project(spark, root, project)


def load_project(spark: SparkSession, root: str, project: str) -> dict[str, DataFrame]:
    """One project's tables; the ``project`` filter prunes partitions.

    A missing store, rejects table or vocabulary is an empty table, a missing
    label map the default one. A project without a dataset is an error.
    """
    docs = versions.read(spark, root, "docs", project)
    if docs is None:
        raise LookupError(f"no project {project!r} under {root}")
    out = {"docs": docs}
    for name, schema in (("spans", SPANS), ("rejects", REJECTS), ("vocab", VOCAB), ("label_map", LABEL_MAP)):
        found = versions.read(spark, root, name, project, schema)
        if found is None and name == "label_map":
            found = default_label_map(spark.createDataFrame([(project,)], "project string"))
        out[name] = spark.createDataFrame([], schema) if found is None else found
    return out


def list_projects(docs: DataFrame, spans: DataFrame | None = None,
                  vocab: DataFrame | None = None, label_map: DataFrame | None = None) -> DataFrame:
    """Projects with row and span counts and which artefacts they have."""
    out = docs.groupBy("project").agg(F.count(F.lit(1)).alias("n_docs"))
    if spans is not None:
        out = out.join(spans.groupBy("project").agg(F.count(F.lit(1)).alias("n_spans")),
                       "project", "left")
    for name, df in (("has_vocab", vocab), ("has_label_map", label_map)):
        if df is not None:
            out = out.join(df.select("project").distinct().withColumn(name, F.lit(True)),
                           "project", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.fillna(0, subset=[c for c in ("n_spans",) if c in out.columns])
