"""Vocabulary and label registry: lookups, stats, additions, cleaning, building.

Flat vocabulary: ``project, key, pos, term``. A key with an empty list is a row
with ``term`` and ``pos`` NULL (so it still counts as present).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ingest import position_within
from spanloom.operators.match import term_hits
from spanloom.schema import DEFAULT_LABELS
from spanloom.session import materialize


def has_vocab(projects: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per project: is there any vocabulary key (an empty list counts)?"""
    keys = vocab.groupBy("project").agg(F.count("key").alias("_n"))
    return (projects.select("project").distinct().join(keys, "project", "left")
            .select("project", (F.coalesce(F.col("_n"), F.lit(0)) > 0).alias("has_vocab")))


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """Terms per key, duplicates counted, empty list -> 0."""
    return vocab.groupBy("project", "key").agg(F.count("term").alias("n_terms"))


def find_mappings(mentions: DataFrame, vocab: DataFrame, strategy: str = "ngram") -> DataFrame:
    """Candidates of each mention among the terms of its label key.

    ``mentions``: project, mention_id, key, text. A term matches when
    ``text in term or term in text`` (an empty string is inside everything).
    Mentions with no match get every term of the key (``matched`` false);
    unknown keys give nothing. List order (``pos``) and duplicates are kept.

    No mention x term pairs are formed inside a key. Both directions are
    substring-containment joins over distinct strings inside ``(project, key)``
    (:func:`term_hits`, an n-gram blocking join): vocabulary terms found in each
    distinct mention text, and mention texts found in each
    distinct term. The distinct strings and the pairs found are written once. Hits come back through
    equi-joins on ``(project, key, ...)``, so only real matches are joined. Empty
    strings, which match everything, are equi-joins on ``(project, key)``.
    """
    scope = ["project", "key"]
    v = materialize(vocab.where(F.col("term").isNotNull()).select(*scope, "pos", "term"), "terms")
    m = materialize(mentions.select("project", "mention_id", "key", "text"), "mentions")
    mt = materialize(m.where(F.col("text").isNotNull()).select(*scope, "text").distinct(), "mention-texts")
    vt = materialize(v.select(*scope, "term").distinct(), "distinct-terms")
    # term inside text, text inside term
    a = term_hits(mt.where("text <> ''"), [*scope, "text"], "text", vt, strategy, scope)
    found = vt.where("term <> ''").withColumnRenamed("term", "vterm")
    b = term_hits(found, [*scope, "vterm"], "vterm", mt.withColumnRenamed("text", "term"), strategy, scope)
    # '' is inside every string
    e_text = mt.where("text = ''").join(vt, scope)
    e_term = vt.where("term = ''").join(mt, scope)
    pairs = a.select(*scope, "text", "term").unionByName(
        b.select(*scope, F.col("term").alias("text"), F.col("vterm").alias("term")))
    for e in (e_text, e_term):
        pairs = pairs.unionByName(e.select(*scope, "text", "term"))
    pairs = materialize(pairs.distinct(), "pairs")
    hit = (m.join(pairs, [*scope, "text"]).join(v, [*scope, "term"])
           .withColumn("matched", F.lit(True)))
    # A pair of strings is a hit of every mention with that text: terms of it are in the key.
    missing = m.join(pairs.select(*scope, "text").distinct(), [*scope, "text"], "left_anti")
    fallback = missing.join(v, scope).withColumn("matched", F.lit(False))
    cols = ["project", "mention_id", "key", "text", "pos", "term", "matched"]
    return hit.select(cols).unionByName(fallback.select(cols))


def add_candidates(vocab: DataFrame, new: DataFrame) -> DataFrame:
    """Append new terms at the end of their key; existing terms are skipped.

    ``new``: project, key, term, seq. Empty terms are ignored; a term added
    twice is appended once (first by ``seq``). Returns the whole vocabulary.
    """
    # First request per term (partial aggregation, safe for hot keys).
    fresh = (new.where(F.col("term").isNotNull() & (F.col("term") != ""))
             .groupBy("project", "key", "term").agg(F.min("seq").alias("seq")))
    fresh = fresh.join(vocab.where(F.col("term").isNotNull()).select("project", "key", "term"),
                       ["project", "key", "term"], "left_anti")
    base = vocab.groupBy("project", "key").agg(F.max("pos").alias("_max"))
    added = (position_within(fresh, ["project", "key"], ["seq", "term"], "_rn")
             .join(base, ["project", "key"], "left")
             .withColumn("pos", (F.coalesce(F.col("_max") + 1, F.lit(0)) + F.col("_rn")).cast("int"))
             .select("project", "key", "pos", "term"))
    # A key that only had an empty-list marker row loses the marker.
    kept = vocab.join(added.select("project", "key").distinct(), ["project", "key"], "left_anti") \
        .unionByName(vocab.where(F.col("term").isNotNull())
                     .join(added.select("project", "key").distinct(), ["project", "key"],
                           "left_semi"))
    return kept.select("project", "key", "pos", "term").unionByName(added)


def default_labels(projects: DataFrame) -> DataFrame:
    """The default label registry for every given project."""
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("label"))
                        for i, x in enumerate(DEFAULT_LABELS)])
    return (projects.select("project").distinct().select("project", F.explode(entries).alias("e"))
            .select("project", "e.pos", "e.label"))


def add_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Append labels: blank (after strip) rejected, existing rejected, stored unstripped.

    ``labels``: project, pos, label; ``new``: project, label, seq.
    Returns the registry. Dedup is a partial aggregate and positions come from
    :func:`position_within`, so one hot project or label never lands in one task.
    """
    # Blank = nothing but Unicode white space and the separators U+001C to U+001F.
    fresh = (new.where(F.col("label").rlike(r"[^\p{IsWhite_Space}\x1C-\x1F]"))
             .groupBy("project", "label").agg(F.min("seq").alias("seq"))
             .join(labels.select("project", "label"), ["project", "label"], "left_anti"))
    base = labels.groupBy("project").agg(F.max("pos").alias("_max"))
    added = (position_within(fresh, ["project"], ["seq", "label"], "_rn")
             .join(base, "project", "left")
             .withColumn("pos", (F.coalesce(F.col("_max") + 1, F.lit(0)) + F.col("_rn")).cast("int"))
             .select("project", "pos", "label"))
    return labels.select("project", "pos", "label").unionByName(added)


def remove_labels(labels: DataFrame, remove: DataFrame) -> DataFrame:
    """Remove labels (spans using them are not touched); positions close up."""
    kept = labels.join(remove.select("project", "label"), ["project", "label"], "left_anti")
    out = position_within(kept.withColumnRenamed("pos", "_p"), ["project"], ["_p"])
    return out.select("project", F.col("pos").cast("int"), "label")


def clean_vocab(vocab: DataFrame) -> DataFrame:
    """Clean raw terms (already text): strip one trailing ``.0``, then drop ``0``.

    Stripped terms move to the end of their key, in their old order; the rest
    keep theirs. No de-duplication. Keys left empty keep a marker row.
    """
    t = F.col("term")
    stripped = F.coalesce(t.endswith(".0"), F.lit(False))
    cleaned = (vocab.withColumn("_s", stripped)
               .withColumn("term", F.when(F.col("_s"), F.expr("left(term, length(term) - 2)"))
                           .otherwise(t)))
    keep = cleaned.where(F.col("term").isNotNull() & (F.col("term") != "0"))
    out = (position_within(keep.withColumnRenamed("pos", "_p"), ["project", "key"], ["_s", "_p"])
           .select("project", "key", F.col("pos").cast("int"), "term"))
    empty = (vocab.select("project", "key").distinct()
             .join(keep.select("project", "key").distinct(), ["project", "key"], "left_anti")
             .select("project", "key", F.lit(None).cast("int").alias("pos"),
                     F.lit(None).cast("string").alias("term")))
    return out.unionByName(empty)


def vocab_from_columns(df: DataFrame, columns: dict[str, object],
                       project_col: str | None = "project") -> DataFrame:
    """Build a vocabulary from the distinct values of columns.

    ``columns`` maps a key name to a column name or Column expression. Terms
    of a key are numbered in sorted order by :func:`position_within` (a plain
    window under the checked key size, a skew-safe range scan above it).
    """
    proj = F.col(project_col).cast("string") if project_col else F.lit(None).cast("string")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("term"))
                        for k, c in columns.items()])
    # One scan: every row gives an entry per column.
    u = df.select(proj.alias("project"), F.explode(entries).alias("e")).select("project", "e.key", "e.term")
    terms = u.where(F.col("term").isNotNull()).distinct()
    if project_col is None:
        out = position_within(terms.drop("project"), ["key"], ["term"])
        return out.select(F.lit(None).cast("string").alias("project"), "key",
                          F.col("pos").cast("int"), "term")
    out = position_within(terms, ["project", "key"], ["term"])
    return out.select("project", "key", F.col("pos").cast("int"), "term")
