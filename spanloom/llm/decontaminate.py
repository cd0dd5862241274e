"""Benchmark decontamination: a prefix-filtered containment join in DataFrame operations.

A window is ``size`` consecutive words of a benchmark item (a shorter item is
one window). A document contains a window only if it contains the window's
rarest word, so that one word is the window's whole prefix: words are ordered
by their number of occurrences in all documents, each window is filed under
its rarest word and that word's offset, and document words are joined with
those prefix words. A match gives one possible start per offset; it must leave
room for the window inside the document (position and length bound), and the
window cut there is then joined with the item windows on its exact words.

The tables derived from the benchmark are broadcast only when a count finds
them under ``BROADCAST_ROWS``; above it the same joins shuffle. The document
pass is one scan; what is shuffled is one row per document and one per hit.

Defined results: a null or empty text has no words. A null or empty item has
no windows; an item without id counts for hits, not among the items. Rows are
told apart by id and text, so repeated rows give equal results, one per input
row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Consecutive words of a window.
SIZE = 10
#: Rows of a derived benchmark table up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 500_000
#: Stands for the end of a text; no word has this character.
END = "\x01"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = "".join(chr(c) for c in range(128)
                 if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER,
                         _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(spaced, " "), "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table if it is small by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Each item's windows: item, key (words joined by a space), toks."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("ws"))
    w = w.where(F.size("ws") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1))))
    w = w.select("item", "ws", at.alias("i"))
    w = w.select("item", F.slice("ws", F.col("i"), size).alias("toks"))
    return w.select("item", "toks", F.array_join("toks", " ").alias("key"))


def windows_by_prefix(docs_words: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct windows with their prefix: key, n, token (rarest in the documents), off."""
    spark = found.sparkSession
    vocab = materialize(found.select(F.explode("toks").alias("token")).distinct(), "vocab")
    use = (docs_words.select(F.explode("ws").alias("token"))
           .join(_small(vocab), "token").groupBy("token").agg(F.count("*").alias("uses")))
    use = materialize(vocab.join(use, "token", "left")
                      .select("token", F.coalesce("uses", F.lit(0)).alias("uses")), "uses")
    one = found.groupBy("key").agg(F.first("toks").alias("toks"))
    each = one.select("key", F.size("toks").alias("n"), F.posexplode("toks").alias("off", "token"))
    best = (each.join(_small(use), "token").groupBy("key", "n")
            .agg(F.min(F.struct("uses", "token", "off")).alias("best"))
            .select("key", "n", "best.token", "best.off"))
    # From literals: rows of this program would come by Python workers, which then stay in every executor.
    end = spark.range(1).select(F.lit("").alias("key"), F.lit(0).alias("n"), F.lit(END).alias("token"),
                                F.lit(0).alias("off"))
    return materialize(best.unionByName(end).withColumn("wid", F.monotonically_increasing_id()),
                       "windows")


def hit_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str,
                item_id: str, item_text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Per document: doc, text_hash, copies, n_words, spans (start, n), wids; and (wid, item) rows."""
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"),
                    words(F.col(text_col)).alias("ws"))
    found = materialize(item_windows(items, item_id, item_text, size), "item-windows")
    wins = windows_by_prefix(d, found)
    wid = wins.select("key", "wid", "n")
    of_item = materialize(found.select("item", "key").distinct().join(wid, "key")
                          .select("wid", "item"), "window-items")
    probe = materialize(wins.select("token", "off", "n").distinct(), "prefixes")

    ends = d.withColumn("all_ws", F.concat("ws", F.array(F.lit(END))))
    at = ends.select("doc", "text_hash", "ws", F.posexplode("all_ws").alias("p", "token"))
    at = at.join(_small(probe), "token").withColumn("start", F.col("p") - F.col("off"))
    at = at.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("ws")))
    cut = F.array_join(F.slice("ws", F.greatest(F.col("start") + 1, F.lit(1)), F.col("n")), " ")
    at = at.select("doc", "text_hash", "start", F.col("n").alias("len"), cut.alias("key"))
    hit = at.join(_small(wid), (at["key"] == wid["key"]) & (at["len"] == wid["n"]))
    real = F.col("n") > 0
    per_doc = hit.groupBy("doc", "text_hash").agg(
        F.count_if(~real).alias("copies"),
        F.max(F.when(~real, F.col("start"))).cast("long").alias("n_words"),
        F.collect_set(F.when(real, F.struct("start", "n"))).alias("spans"),
        F.collect_set(F.when(real, F.col("wid"))).alias("wids"))
    return materialize(per_doc, "hits"), of_item


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  size: int = SIZE) -> DataFrame:
    """Per input row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    per_doc, of_item = hit_windows(docs, items, id_col, text_col, item_id, item_text, size)
    named = (per_doc.select("doc", "text_hash", F.explode("wids").alias("wid"))
             .join(_small(of_item), "wid").groupBy("doc", "text_hash")
             .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    named = named.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), "items")
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), x["start"] + x["n"]
                                     - F.greatest(a["end"], x["start"]))).alias("total")),
        lambda a: a["total"])
    none = F.array().cast("array<string>")
    out = per_doc.join(named, per_doc["doc"].eqNullSafe(named["d"])
                       & (per_doc["text_hash"] == named["h"]), "left")
    out = out.select(F.col("doc").alias("doc_id"), "text_hash", "n_words", "copies", "spans",
                     covered.cast("long").alias("n_hit"),
                     F.coalesce("items", none).alias("items"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    out = out.select("*", each.alias("_row"))
    return out.select("doc_id", "text_hash", "n_words", "n_hit",
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          size: int = SIZE) -> DataFrame:
    """The documents without any benchmark window, all columns unchanged."""
    per_doc, _ = hit_windows(docs, items, id_col, text_col, "item_id", "text", size)
    bad = _small(materialize(per_doc.where(F.size("spans") > 0).select(
        F.col("doc").alias("_bad_doc"), F.col("text_hash").alias("_bad_hash")), "bad"))
    same = docs[id_col].eqNullSafe(bad["_bad_doc"]) & (F.xxhash64(docs[text_col]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_decontaminate``: hits of all benchmark windows in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).drop("text_hash", "spans")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[i:i + 9] AS t
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
             FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, ws[i:i + n - 1] AS t
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.t = bw.t),
cov AS (SELECT r, count(DISTINCT i + k) AS n_hit
        FROM (SELECT DISTINCT r, n, i FROM hit), (SELECT unnest(range(0, 10)) AS k) WHERE k < n GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)
"""
