"""Named queries over the driver's tables: one per operator (see SURVEY §2).

Every query takes ``(spark, sf_dir)`` and returns a flat DataFrame (no
array / map / struct columns) with explicitly named columns; the matching
DuckDB SQL lives in :mod:`spanloom.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.mapping import mapping_text
from spanloom.operators import edits as E
from spanloom.operators import ingest as I
from spanloom.operators import mapping as MP
from spanloom.operators import match as M
from spanloom.operators import metrics as MT
from spanloom.operators import spans as S
from spanloom.operators import views as V
from spanloom.operators import vocab as VC
from spanloom.plans import bindings as B
from spanloom.session import scratch_path
from spanloom.sources import files as FS

KEYS = ["project", "doc_id"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def flat_spans(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.col("ord").cast("bigint").alias("ord"), "text", "label",
                     F.col("start").cast("bigint").alias("start_pos"),
                     F.col("end").cast("bigint").alias("end_pos"),
                     mapping_text("mapped_value").alias("mapping"))


# ------------------------------------------------------------------ B1-B4
def _entity_candidates(spark, d) -> DataFrame:
    """Per part name: word 1, word 2, word 1 upper-cased (absent), empty text."""
    s = B.short_docs(spark, d)
    c = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), t.alias("text")) for i, t in (
        (0, F.split_part("query", F.lit(" "), F.lit(1))),
        (1, F.split_part("query", F.lit(" "), F.lit(2))),
        (2, F.upper(F.split_part("query", F.lit(" "), F.lit(1)))),
        (3, F.lit("")))])
    return s.select(*KEYS, "query", "p_size", F.explode(c).alias("c")).select(
        *KEYS, "query", "p_size", "c.i", "c.text")


@query
def q_locate_first(spark, d):
    x = S.locate_first(_entity_candidates(spark, d))
    return x.select(*KEYS, "i", "text", "found", F.col("start").alias("start_pos"),
                    F.col("end").alias("end_pos"))


def _located_with_fallback(spark, d):
    x = (_entity_candidates(spark, d)
         .withColumn("s0", F.col("p_size") % 5).withColumn("e0", F.col("p_size") % 40))
    return S.locate_first(x, start_col="s0", end_col="e0")


@query
def q_validate_span(spark, d):
    x = S.validate_span(_located_with_fallback(spark, d))
    return x.select(*KEYS, "i", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
                    "reason", "valid")


@query
def q_span_slice(spark, d):
    x = S.with_slice(_located_with_fallback(spark, d))
    return x.select(*KEYS, "i", "text", "slice", "slice_matches")


@query
def q_overlap_pairs(spark, d):
    return S.overlap_pairs(B.edit_add_spans(spark, d))


# ------------------------------------------------------------------ B5, B7-B9
@query
def q_add_spans(spark, d):
    spans, _ = S.add_spans(None, B.edit_adds(spark, d))
    return flat_spans(spans).drop("mapping")


@query
def q_add_spans_outcomes(spark, d):
    _, out = S.add_spans(None, B.edit_adds(spark, d))
    return out


@query
def q_replay_edits(spark, d):
    return flat_spans(E.replay_edits(B.edits(spark, d)))


@query
def q_replay_outcomes(spark, d):
    return E.replay_outcomes(B.edits(spark, d))


def _requests(spark, d) -> DataFrame:
    return B.short_docs(spark, d).select(*KEYS, (F.col("doc_id") % 3).alias("ord"), "query")


@query
def q_remove_span(spark, d):
    return flat_spans(S.remove_span(B.ann_spans(spark, d), _requests(spark, d)))


@query
def q_update_span(spark, d):
    req = _requests(spark, d).select(
        *KEYS, "ord", F.upper("query").alias("text"), F.lit("UPD").alias("label"),
        F.lit(0).alias("start"), F.length("query").alias("end"))
    return flat_spans(S.update_span(B.ann_spans(spark, d), req))


def _mapping_changes(spark, d) -> DataFrame:
    return B.short_docs(spark, d).select(
        *KEYS, (F.col("doc_id") % 3).alias("ord"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("modifier")).otherwise(F.lit("extra")).alias("category"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("x"), (F.col("doc_id") % 4).cast("string")))).alias("values"),
        F.lit(0).alias("seq"))


@query
def q_set_mapping(spark, d):
    return flat_spans(MP.set_mapping(B.ann_spans(spark, d), _mapping_changes(spark, d)))


@query
def q_orphan_mappings(spark, d):
    spans = MP.set_mapping(B.ann_spans(spark, d), _mapping_changes(spark, d))
    o = MP.orphan_mappings(spans, B.voc(spark, d))
    return o.select(*KEYS, "ord", "category", F.col("vpos").cast("bigint"), "value")


# ------------------------------------------------------------------ B11
@query
def q_annotate_with_vocab(spark, d):
    spans = M.annotate_with_vocab(B.corpus_docs(spark, d), B.corpus_vocab(spark, d))
    return flat_spans(spans).drop("mapping")


@query
def q_annotate_short(spark, d):
    spans = M.annotate_with_vocab(B.short_docs(spark, d), B.voc(spark, d), B.label_map(spark, d))
    return flat_spans(spans).drop("mapping")


@query
def q_containment_hits(spark, d):
    h = M.containment_hits(B.corpus_docs(spark, d), B.corpus_vocab(spark, d), "ngram")
    return h.select(*KEYS, F.col("pos").cast("bigint"), "term", F.col("start").alias("start_pos"))


# ------------------------------------------------------------------ B6, B12, A5, A6, C5
@query
def q_explode_spans(spark, d):
    nested = I.nest_spans(B.ann_spans(spark, d))
    return flat_spans(I.explode_spans(nested))


@query
def q_get_annotations(spark, d):
    g = I.get_annotations(B.short_docs(spark, d).select(*KEYS), B.ann_spans(spark, d))
    return g.select(*KEYS, F.size("anns").cast("bigint").alias("n_spans"),
                    F.array_join(F.transform("anns", lambda a: a["text"]), ",").alias("texts"))


@query
def q_init_annotations(spark, d):
    g = I.init_annotations(B.short_docs(spark, d).select(*KEYS))
    return g.select(*KEYS, F.size("anns").cast("bigint").alias("n_spans"))


@query
def q_parse_annotations(spark, d):
    docs, _ = I.parse_annotations(B.raw_docs(spark, d))
    return flat_spans(I.explode_spans(docs))


@query
def q_annotation_rejects(spark, d):
    _, rej = I.parse_annotations(B.raw_docs(spark, d))
    return rej


@query
def q_normalize_mapping(spark, d):
    n = MP.normalize_mapping(B.raw_mappings(spark, d))
    return n.select(*KEYS, "ord", mapping_text("mapped_value").alias("mapping"))


# ------------------------------------------------------------------ C1-C11
@query
def q_find_mappings(spark, d):
    f = VC.find_mappings(B.mentions(spark, d), B.mention_vocab(spark, d))
    return f.select("project", "mention_id", "key", "text", F.col("pos").cast("bigint"), "term",
                    "matched")


@query
def q_candidates(spark, d):
    c = MP.candidates(B.ann_spans(spark, d), B.label_map(spark, d), B.voc(spark, d))
    return c.select(*KEYS, "ord", "label", "category", F.col("cat_pos").cast("bigint"), "term",
                    F.col("term_pos").cast("bigint"))


@query
def q_candidates_by_label(spark, d):
    """How many spans point to each candidate of their label."""
    spans, lists = MP.candidates_by_label(B.ann_spans(spark, d), B.label_map(spark, d), B.voc(spark, d))
    n = spans.groupBy("project", "label").agg(F.count("*").alias("n_spans"))
    return lists.join(n, ["project", "label"]).select(
        "project", "label", "category", F.col("cat_pos").cast("bigint"), "term", F.col("term_pos").cast("bigint"),
        "n_spans")


@query
def q_has_vocab(spark, d):
    projects = B.short_docs(spark, d).select("project").unionByName(
        B.corpus_docs(spark, d).select("project"))
    return VC.has_vocab(projects, B.voc(spark, d))


@query
def q_vocab_stats(spark, d):
    return VC.vocab_stats(B.voc(spark, d))


def _vocab_out(v: DataFrame) -> DataFrame:
    return v.select("project", "key", F.col("pos").cast("bigint"), "term")


@query
def q_add_candidates(spark, d):
    part = B.table(spark, d, "part")
    new = part.select(
        F.col("p_type").alias("project"), F.lit("brand").alias("key"),
        F.when(F.col("p_size") % 4 == 0, F.concat("p_brand", F.lit("+"))).otherwise(F.col("p_brand"))
        .alias("term"), F.col("p_partkey").alias("seq")).unionByName(part.select(
            F.col("p_type").alias("project"), F.lit("color").alias("key"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"),
            F.col("p_partkey").alias("seq")))
    return _vocab_out(VC.add_candidates(B.voc(spark, d), new))


def _added_labels(spark, d) -> DataFrame:
    part = B.table(spark, d, "part")
    r = F.col("p_size") % 4
    lbl = (F.when(r == 0, F.lit("  ")).when(r == 1, F.lit("MOD"))
           .when(r == 2, F.concat(F.lit(" "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))),
                                  F.lit(" ")))
           .otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))))
    new = part.select(F.col("p_type").alias("project"), lbl.alias("label"),
                      F.col("p_partkey").alias("seq"))
    return VC.add_labels(B.labels(spark, d), new)


@query
def q_add_labels(spark, d):
    return _added_labels(spark, d).select("project", F.col("pos").cast("bigint"), "label")


@query
def q_remove_labels(spark, d):
    part = B.table(spark, d, "part")
    rm = part.where(F.col("p_size") % 2 == 0).select(
        F.col("p_type").alias("project"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("label")
    ).unionByName(B.projects(spark, d).select("project", F.lit("MULTI").alias("label")))
    out = VC.remove_labels(_added_labels(spark, d), rm)
    return out.select("project", F.col("pos").cast("bigint"), "label")


def _raw_vocab(spark, d) -> DataFrame:
    part = B.table(spark, d, "part")
    orders = B.table(spark, d, "orders")
    return part.select(
        F.col("p_type").alias("project"), F.lit("size").alias("key"),
        F.col("p_partkey").alias("pos"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("term")
    ).unionByName(part.select(
        F.col("p_type").alias("project"), F.lit("sizeint").alias("key"),
        F.col("p_partkey").alias("pos"), (F.col("p_size") % 10).cast("string").alias("term"))
    ).unionByName(orders.select(
        F.lit("orders").alias("project"), F.lit("cust").alias("key"), F.col("o_orderkey").alias("pos"),
        F.concat((F.col("o_custkey") % 7).cast("string"),
                 F.when(F.col("o_orderkey") % 3 == 0, F.lit(".0")).otherwise(F.lit("")))
        .alias("term")))


@query
def q_clean_vocab(spark, d):
    return _vocab_out(VC.clean_vocab(_raw_vocab(spark, d)))


@query
def q_vocab_from_columns(spark, d):
    return _vocab_out(B.voc(spark, d))


# ------------------------------------------------------------------ M1-M5, G1, G2
@query
def q_mapping_progress(spark, d):
    return MT.mapping_progress(B.short_docs(spark, d), B.ann_spans(spark, d))


@query
def q_doc_status(spark, d):
    return MT.doc_status(B.short_docs(spark, d), B.ann_spans(spark, d))


@query
def q_span_counts(spark, d):
    return MT.span_counts(B.short_docs(spark, d), B.ann_spans(spark, d))


@query
def q_annotated_docs(spark, d):
    return MT.annotated_docs(B.ann_spans(spark, d)).select(
        "project", F.col("annotated_rows").cast("bigint"))


@query
def q_status_summary(spark, d):
    return MT.status_summary(MT.doc_status(B.short_docs(spark, d), B.ann_spans(spark, d)))


@query
def q_segments(spark, d):
    return V.segments(B.short_docs(spark, d), B.ann_spans(spark, d))


@query
def q_preview(spark, d):
    return V.preview(B.ann_spans(spark, d))


@query
def q_export_annotations(spark, d):
    e = V.export_annotations(B.short_docs(spark, d).select(*KEYS, "query"), B.ann_spans(spark, d))
    return e.select(*KEYS, "query", "annotations")


@query
def q_export_one(spark, d):
    e = V.export_one(B.short_docs(spark, d).select(*KEYS, "query"), B.ann_spans(spark, d), 0)
    return e.select(*KEYS, "query", "annotations")


# ------------------------------------------------------------------ A1-A15 (write, read back)
@query
def q_write_vocab(spark, d):
    path = scratch_path(spark, "vocab-lines")
    FS.write_vocab(B.voc(spark, d), path, fmt="lines")
    return spark.read.text(path).select("project", F.col("value").alias("json"))


@query
def q_read_vocab(spark, d):
    path = scratch_path(spark, "vocab-object")
    FS.write_vocab(B.voc(spark, d), path, fmt="object")
    return _vocab_out(FS.read_vocab(spark, path))


@query
def q_read_label_map(spark, d):
    path = scratch_path(spark, "label-map")
    lm = B.label_map(spark, d).select("project", F.col("label").alias("key"), "pos",
                                      F.col("category").alias("term"))
    FS.write_vocab(lm, path, fmt="object")
    out = FS.read_label_map(spark, path)
    return out.select("project", "label", F.col("pos").cast("bigint"), "category")


@query
def q_read_annotation_store(spark, d):
    path = scratch_path(spark, "store")
    FS.write_annotation_store(B.ann_spans(spark, d), path)
    return flat_spans(FS.read_annotation_store(spark, path))


@query
def q_read_legacy_store(spark, d):
    """The store of whole objects, a few files a project, and back."""
    path = scratch_path(spark, "store-objects")
    FS.write_legacy_store(B.ann_spans(spark, d), path, rows_per_file=500)
    return flat_spans(FS.read_legacy_store(spark, path)[0])


def _kept_and_rejected(docs: DataFrame, rejects: DataFrame) -> DataFrame:
    return docs.select(F.lit("row").alias("kind"), "doc_id", "query").unionByName(
        rejects.select(F.col("reason").alias("kind"), "doc_id", F.lit(None).cast("string").alias("query")))


@query
def q_csv_rejects(spark, d):
    """Quoted records over two lines, one in ten with a field too many, one in ten without its text."""
    part = B.table(spark, d, "part")
    text = F.concat(F.lit(',"'), "p_name", F.lit('\n""'), "p_brand", F.lit('"", x"'))
    line = F.concat("p_partkey", F.when(F.col("p_size") % 10 == 1, "").when(
        F.col("p_size") % 10 == 0, F.concat(text, F.lit(",more"))).otherwise(text))
    file = F.col("p_partkey") % 8
    body = part.select(file.alias("f"), F.lit(1).alias("body"), line.alias("value"))
    head = body.select("f").distinct().select("f", F.lit(0).alias("body"), F.lit("pk,query").alias("value"))
    path = scratch_path(spark, "records")
    (body.unionByName(head).repartition(8, "f").sortWithinPartitions("f", "body").drop("body")
     .write.partitionBy("f").text(path))
    return _kept_and_rejected(*FS.read_docs_csv_checked(spark, path, "csv", key="pk"))


@query
def q_json_rejects(spark, d):
    """Every seventh line is cut off."""
    docs = B.table(spark, d, "documents")
    line = F.to_json(F.struct(F.col("doc_id").alias("pk"), F.col("text").alias("query")))
    cut = F.when(F.col("doc_id") % 7 == 3, F.left(line, F.length(line) - 2)).otherwise(line)
    path = scratch_path(spark, "lines")
    docs.select(cut.alias("value")).write.text(path)
    return _kept_and_rejected(*FS.read_docs_json_checked(spark, path, "json", multiline=False, key="pk"))


def _short_export(spark, d) -> DataFrame:
    e = V.export_annotations(B.short_docs(spark, d).select(*KEYS, "query"), B.ann_spans(spark, d))
    return e.select(F.col("doc_id").cast("string").alias("pk"), "query", "annotations")


@query
def q_read_docs_csv(spark, d):
    path = scratch_path(spark, "docs-csv")
    FS.write_docs_csv(_short_export(spark, d).drop("annotations"), path)
    return FS.read_docs_csv(spark, path, "csv", key="pk").select(*KEYS, "query")


@query
def q_read_docs_json(spark, d):
    path = scratch_path(spark, "docs-json")
    _short_export(spark, d).drop("annotations").write.mode("overwrite").json(path)
    return FS.read_docs_json(spark, path, "json", key="pk", multiline=False).select(*KEYS, "query")


def _padded_documents(spark, d) -> DataFrame:
    """Whole texts with outer white space, as a dataset."""
    return B.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("pk"), F.concat(F.lit(" \t"), "text", F.lit("  ")).alias("query"))


@query
def q_documents_csv(spark, d):
    path = scratch_path(spark, "documents-csv")
    FS.write_docs_csv(_padded_documents(spark, d), path)
    return FS.read_docs_csv(spark, path, "csv", key="pk").select(*KEYS, "query")


@query
def q_documents_json(spark, d):
    path = scratch_path(spark, "documents-json")
    _padded_documents(spark, d).write.mode("overwrite").json(path)
    return FS.read_docs_json(spark, path, "json", key="pk", multiline=False).select(*KEYS, "query")


@query
def q_write_spans(spark, d):
    path = scratch_path(spark, "store") + "/spans"
    FS.write_spans(B.ann_spans(spark, d), path)
    return flat_spans(FS.read_spans(spark, path))


@query
def q_replace_project(spark, d):
    """Every project's spans are gone after it is replaced without annotations; half are replaced."""
    root = scratch_path(spark, "projects")
    src = scratch_path(spark, "ingest-src")
    FS.write_docs_csv(_short_export(spark, d), src)
    FS.ingest_project(spark, src, "007", root, key="pk")
    FS.ingest_project(spark, src, "7", root, key="pk")
    bare = scratch_path(spark, "ingest-bare")
    FS.write_docs_csv(_short_export(spark, d).drop("annotations"), bare)
    FS.ingest_project(spark, bare, "007", root, key="pk")
    both = [FS.load_project(spark, root, p) for p in ("007", "7")]
    return FS.list_projects(both[0]["docs"].unionByName(both[1]["docs"]),
                            both[0]["spans"].unionByName(both[1]["spans"])).select(
        "project", "n_docs", "n_spans")


@query
def q_ingest_project(spark, d):
    src = scratch_path(spark, "ingest-src")
    root = scratch_path(spark, "projects")
    FS.write_docs_csv(_short_export(spark, d), src)
    tables = FS.ingest_project(spark, src, "short", root, order_by=None, key="pk")
    return flat_spans(tables["spans"])


@query
def q_with_doc_id(spark, d):
    part = B.table(spark, d, "part")
    return I.with_doc_id(part, order_by=["p_name", "p_partkey"]).select(
        "doc_id", "p_partkey", "p_name")


@query
def q_list_projects(spark, d):
    return FS.list_projects(B.short_docs(spark, d), B.ann_spans(spark, d), B.voc(spark, d),
                            B.label_map(spark, d)).select(
        "project", F.col("n_docs").cast("bigint"), F.col("n_spans").cast("bigint"),
        "has_vocab", "has_label_map")


# ------------------------------------------------------------------ B10, M6 (Structured Streaming)
def _stream_run(spark, d) -> tuple[str, str]:
    """Replay EDITS through the streaming operator; return (snapshot sink, checkpoint).

    The log (seq made dense per row) is written as 4 files split by a hash of
    (row, seq), so every micro-batch holds edits out of order; every 20th edit
    is delivered twice.
    """
    from spanloom.streaming import edits_stream as SE
    edits = SE.dense_seq(B.edits(spark, d))
    src = scratch_path(spark, "edit-stream-src")
    redelivered = edits.where(F.col("seq") % 20 == 0)
    arrivals = edits.unionByName(redelivered).withColumn(
        "_f", F.pmod(F.hash("doc_id", "seq"), F.lit(4)))
    arrivals.repartition(4, "_f").drop("_f").write.parquet(src)
    sink = scratch_path(spark, "edit-stream-sink")
    ckpt = scratch_path(spark, "edit-stream-ckpt")
    SE.run_replay_stream(spark, src, edits.schema, sink, ckpt)
    return sink, ckpt


@query
def q_replay_edits_stream(spark, d):
    from spanloom.streaming import edits_stream as SE
    _, ckpt = _stream_run(spark, d)
    return flat_spans(SE.state_spans(spark, ckpt))


@query
def q_progress_stream(spark, d):
    from spanloom.streaming import edits_stream as SE
    sink, _ = _stream_run(spark, d)
    return SE.progress_from_snapshots(spark.read.parquet(sink))
