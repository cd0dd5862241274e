"""Working tables derived by Spark from the driver's parquet tables.

Every table here is computed from whole input tables, so the work of every
registered query grows with the data:

* SHORT   part: p_type -> project, p_partkey -> doc_id, p_name -> query.
* DOCS    documents: source -> project, doc_id, text -> query.
* VOC     vocabulary built from part columns per project: keys modifier
          (word 1 of p_name), item (word 2), brand, type.
* LM      label map per project: MOD->modifier, ITEM->item, BRAND->brand,
          MULTI->brand,type; label NONE has no categories.
* ANN     stored spans: the two words of every part name located in it;
          rows whose p_size is a multiple of 7 have no spans, and spans of
          rows whose p_size is a multiple of 3 are unmapped -- so all three
          row statuses occur.
* RAW     ANN serialised as JSON text and damaged in 11 ways by doc_id % 11.
* CORPUS  every distinct word of ``benchmark`` as one global
          vocabulary (key ``word``) over DOCS.
* MENTION nation names as vocabulary with nation and region names as mentions, and the
  part vocabulary with one mention per part (item, brand prefix or an unmatched name).
* EDITS   events as an edit log: click/view -> add, purchase -> update,
          error -> remove, signup -> set_mapping; k from the props JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import locate0
from spanloom.operators.ingest import empty_anns, empty_map, nest_spans, position_within
from spanloom.operators.vocab import vocab_from_columns

KEYS = ("project", "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_docs(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_type").alias("project"), F.col("p_partkey").alias("doc_id"),
        F.col("p_name").alias("query"), "p_size")


def corpus_docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("source").alias("project"), "doc_id", F.col("text").alias("query"))


def word(i: int):
    return F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))


def voc(spark, d) -> DataFrame:
    part = table(spark, d, "part").withColumn("project", F.col("p_type"))
    return vocab_from_columns(part, {"modifier": word(1), "item": word(2),
                                     "brand": F.col("p_brand"), "type": F.col("p_type")})


# Fixed test label map (label -> categories) used with the part-derived vocabulary.
TEST_LABEL_MAP = {"MOD": ["modifier"], "ITEM": ["item"], "BRAND": ["brand"],
                  "MULTI": ["brand", "type"]}
TEST_LABELS = ["MOD", "ITEM", "BRAND", "MULTI", "NONE"]


def projects(spark, d) -> DataFrame:
    return short_docs(spark, d).select("project").distinct()


def label_map(spark, d) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(lbl).alias("label"), F.lit(i).alias("pos"), F.lit(c).alias("category"))
        for lbl, cats in TEST_LABEL_MAP.items() for i, c in enumerate(cats)])
    return (projects(spark, d).select("project", F.explode(entries).alias("e"))
            .select("project", "e.label", "e.pos", "e.category"))


def labels(spark, d) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(lbl).alias("label"))
                        for i, lbl in enumerate(TEST_LABELS)])
    return (projects(spark, d).select("project", F.explode(entries).alias("e"))
            .select("project", "e.pos", "e.label"))


def ann_spans(spark, d) -> DataFrame:
    s = short_docs(spark, d).where(F.col("p_size") % 7 != 0)
    words = F.array(
        F.struct(F.lit(0).cast("bigint").alias("ord"), F.split_part("query", F.lit(" "), F.lit(1))
                 .alias("text"), F.lit("MOD").alias("label"), F.lit("modifier").alias("key")),
        F.struct(F.lit(1).cast("bigint").alias("ord"), F.split_part("query", F.lit(" "), F.lit(2))
                 .alias("text"), F.lit("ITEM").alias("label"), F.lit("item").alias("key")))
    x = s.select(*KEYS, "query", "p_size", F.explode(words).alias("w")).select(
        *KEYS, "query", "p_size", "w.*")
    start = locate0("query", "text")
    return x.select(
        *KEYS, "ord", "text", "label", start.alias("start"),
        (start + F.length("text")).alias("end"),
        F.when(F.col("p_size") % 3 == 0, empty_map())
        .otherwise(F.create_map(F.col("key"), F.array(F.col("text")))).alias("mapped_value"))


def raw_docs(spark, d) -> DataFrame:
    """SHORT with a damaged JSON ``annotations`` column (see module doc)."""
    docs = short_docs(spark, d)
    nested = nest_spans(ann_spans(spark, d))
    j = docs.join(nested, list(KEYS), "left").withColumn(
        "json", F.to_json(F.coalesce("anns", empty_anns())))
    js = F.col("json")
    r = F.col("doc_id") % 11
    n = F.size(F.coalesce("anns", empty_anns()))
    damaged = (
        F.when(r == 0, F.lit(None).cast("string"))
        .when(r == 1, F.translate(js, '"', "'"))
        .when(r == 2, F.expr("substring(json, 1, length(json) - 1)"))
        .when(r == 3, F.lit("null"))
        .when(r == 4, F.lit("5"))
        .when(r == 5, F.lit('{"a":1}'))
        .when(r == 6, F.when(n > 0, F.concat(F.lit("[1,"), F.expr("substring(json, 2)")))
              .otherwise(F.lit("[1]")))
        .when(r == 7, F.regexp_replace(js, r'^(\[\{[^}]*?"start":)\d+', '$1"abc"'))
        .when(r == 8, F.concat(js, F.lit(" junk")))
        .when(r == 9, F.regexp_replace(js, r'"mapped_value":\{"(\w+)":\["([^"]*)"\]\}',
                                       '"mapped_value":{"$1":"$2"}'))
        .otherwise(js))
    return j.select(*KEYS, "query", damaged.alias("annotations"))


def raw_mappings(spark, d) -> DataFrame:
    """One JSON ``mapped_value`` text per ANN span, in 6 shapes by (doc_id + ord) % 6."""
    a = ann_spans(spark, d)
    key = F.when(F.col("label") == "MOD", F.lit("modifier")).otherwise(F.lit("item"))
    r = (F.col("doc_id") + F.col("ord")) % 6
    kq = F.concat(F.lit('{"'), key, F.lit('":'))
    j = (F.when(r == 0, F.concat(kq, F.lit('["'), F.col("text"), F.lit('"]}')))
         .when(r == 1, F.concat(kq, F.lit('"'), F.col("text"), F.lit('"}')))
         .when(r == 2, F.concat(kq, F.lit("0}")))
         .when(r == 3, F.concat(kq, F.lit('""}')))
         .when(r == 4, F.lit('"abc"'))
         .otherwise(F.concat(kq, F.lit("null}"))))
    return a.select(*KEYS, "ord", j.alias("mapped_value"))


def corpus_vocab(spark, d) -> DataFrame:
    words = (table(spark, d, "benchmark")
             .select(F.explode(F.split("text", r"[^\p{L}]+")).alias("term"))
             .where(F.length("term") > 0).distinct())
    return vocab_from_columns(words, {"word": "term"}, project_col=None).drop("project")


def mention_vocab(spark, d) -> DataFrame:
    geo = table(spark, d, "nation").select(
        F.lit("geo").alias("project"), F.lit("nation").alias("key"),
        F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("term"))
    return geo.unionByName(voc(spark, d).select("project", "key", "pos", "term"))


def mentions(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("mention_id"),
        F.col("n_name").alias("text"))
    r = table(spark, d, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("mention_id"),
        F.col("r_name").alias("text"))
    geo = n.unionByName(r).select(F.lit("geo").alias("project"), "mention_id",
                                  F.lit("nation").alias("key"), "text")
    kind = F.col("p_partkey") % 3
    part = table(spark, d, "part").select(
        F.col("p_type").alias("project"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("mention_id"),
        F.when(kind == 0, "item").when(kind == 1, "brand").otherwise("type").alias("key"),
        F.when(kind == 1, F.substring("p_brand", 1, 7)).otherwise(F.col("p_name")).alias("text"))
    return geo.unionByName(part)


def edits(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = (F.when(F.col("event_type").isin("click", "view"), F.lit("add"))
          .when(F.col("event_type") == "purchase", F.lit("update"))
          .when(F.col("event_type") == "error", F.lit("remove"))
          .when(F.col("event_type") == "signup", F.lit("set_mapping")))
    start = F.floor("value").cast("bigint")
    return (e.withColumn("k", k).select(
        F.lit("events").alias("project"), F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"), op.alias("op"), (F.col("k") % 5).alias("ord"),
        F.concat(F.lit("w"), F.col("k").cast("string")).alias("text"),
        F.concat(F.lit("L"), (F.col("k") % 3).cast("string")).alias("label"),
        start.alias("start"), (start + 1 + F.col("k") % 20).alias("end"),
        F.concat(F.lit("c"), (F.col("k") % 4).cast("string")).alias("category"),
        F.when(F.col("k") % 10 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("v"), (F.col("k") % 7).cast("string"))))
        .alias("values")))


def edit_adds(spark, d) -> DataFrame:
    return edits(spark, d).where(F.col("op") == "add")


def edit_add_spans(spark, d) -> DataFrame:
    """Every add of EDITS as a stored span, ordinal = arrival rank in its row."""
    ranked = position_within(edit_adds(spark, d), list(KEYS), ["seq"], "ord")
    return ranked.select(*KEYS, "ord", "text", "label", "start", "end",
                         empty_map().alias("mapped_value"))
