"""Source divergence audit: how far each source's term use lies from other sources and from its language.

Every (language, source) group gives each kept term t the integer price
p = 1 + floor(SCALE * (count + 1) / (N + V)), N being the group's occurrences of
the V kept terms of its language. Two priced groups differ by the sum over the
terms of floor((p - q)^2 / q).

The terms of a language are the rows of a one-hot matrix whose columns are the
(group, count level) pairs: a 1 says that the term occurs so often in that group.
The product of this matrix with its transpose holds, in its block of two groups, how
many terms have level i in the one and level j in the other: the joint table
from which any pair of groups is priced without the terms. Rows are blocked; each
block has a few thousand ones, so it is a small dense matrix whose product is exact in
32-bit floats. Spark adds the blocks' non-zero entries. Level 0 is no column (most
terms are missing from most groups): its entries follow from the margins,
which are the diagonal blocks, and V.

Memory: a text slice or one matrix block in a task, and of one term its counts by
source. Counts are pre-aggregated by slice and again before each shuffle; no group's terms
meet in one task.

Defined results: null text, language and source are read as empty; a group without
kept terms has N = 0; a language without kept terms gives value 0 to each pair of
its sources. Equal values rank by the item's UTF-8 bytes. Repeated rows count each time.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from . import common

#: Documents of its language that a kept term occurs in at least.
MIN_DOCS = 3
SCALE = 1_000_000_000
#: Ranks of the ``term`` part.
TOP_TERMS = 200
#: Bytes of text whose counts are put together in a task.
SLICE_BYTES = 6 << 20
#: Ones of a matrix block at most (one row may have more: one for each of its sources).
BLOCK_ONES = 2048

#: Bytes that end a term become spaces, A-Z become a-z; letters and all bytes from 0x80 on stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"),
                ) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term)."""
    common.small_batches(docs.sparkSession)
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k)
                    for c, k in zip(group_cols, ("g", "s"), strict=True))
    src = docs.select(lang, source, F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "t", SLICE_BYTES):
            words = [t.translate(_TERM_BYTES).split() for t in common.text_bytes(batch.column("t"))]
            flat = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
            if not len(flat):
                continue
            terms = len(flat.dictionary)
            doc = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
            of_doc, groups = pd.factorize(pd.Series(list(zip(
                batch.column("g").to_pylist(), batch.column("s").to_pylist(), strict=True))))
            # Numbers of the (group, term) pairs, then the documents that have each.
            pair, keys = pd.factorize(of_doc[doc] * terms + flat.indices.to_numpy())
            once = pd.unique(doc * len(keys) + pair) % len(keys)
            names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(keys // terms)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*names, flat.dictionary.take(pa.array(keys % terms)).cast(pa.string()),
                 pa.array(np.bincount(pair)), pa.array(np.bincount(once, minlength=len(keys)))],
                names=["lang", "source", "term", "n", "docs"])

    each = src.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, levels: (source, n) of each source that has the term; kept terms only."""
    return counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"),
        F.collect_list(F.struct("source", "n")).alias("levels")).where(
            F.col("docs") >= min_docs).drop("docs")


def blocks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts of consecutive rows so that a block has at most ``most`` ones (or one row)."""
    out, first, ones = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and ones + n > most:
            out.append((first, i))
            first, ones = i, 0
        ones += n
    return [*out, (first, len(sizes))] if len(sizes) else []


def product(row: np.ndarray, column: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, entry) of the non-zero entries with i <= j of the one-hot block's transpose times the block.

    Entries are at most the number of rows, so 32-bit floats hold them exactly.
    """
    used, at = np.unique(column, return_inverse=True)
    hot = np.zeros((n_rows, len(used)), dtype=np.float32)
    hot[row, at] = 1
    joint = np.triu(hot.T @ hot)
    i, j = np.nonzero(joint)
    return used[i], used[j], joint[i, j].astype(np.int64)


def level_products(kept: DataFrame, block_ones: int = BLOCK_ONES) -> DataFrame:
    """lang, s1, c1, s2, c2, n: terms with level c1 > 0 in source s1 and c2 > 0 in s2 (s1 <= s2).

    Rows with s1 = s2 have c1 = c2: they are the margins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column("levels")
            sizes = np.diff(levels.offsets.to_numpy())
            entry = levels.flatten()
            # Columns (language, source, level), numbered in this order: so i <= j means s1 <= s2.
            frame = pd.DataFrame({
                "lang": np.repeat(batch.column("lang").to_numpy(zero_copy_only=False), sizes),
                "source": [s.encode() for s in entry.field("source").to_pylist()],
                "n": entry.field("n").to_numpy()})
            names = frame.drop_duplicates().sort_values(["lang", "source", "n"], ignore_index=True)
            column = frame.merge(names.reset_index(), "left", ["lang", "source", "n"])["index"].to_numpy()
            # Like rows together: languages, then totals.
            order = np.lexsort((batch.column("total").to_numpy(), batch.column("lang").to_numpy(zero_copy_only=False)))
            column = column[common.ragged(np.cumsum(sizes)[order] - sizes[order], sizes[order])]
            sizes = sizes[order]
            off = np.concatenate(([0], np.cumsum(sizes)))
            found = []
            for a, b in blocks(sizes, block_ones):
                row = np.repeat(np.arange(b - a), sizes[a:b])
                i, j, n = product(row, column[off[a]:off[b]], b - a)
                same = names["lang"].to_numpy()[i] == names["lang"].to_numpy()[j]
                found.append((i[same] * len(names) + j[same], n[same]))
            if not found:
                continue
            key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, at, np.concatenate([n for _, n in found]))
            one, two = names.iloc[key // len(names)], names.iloc[key % len(names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(one["lang"], pa.string()),
                 pa.array(one["source"], pa.binary()).cast(pa.string()), pa.array(one["n"], pa.int64()),
                 pa.array(two["source"], pa.binary()).cast(pa.string()), pa.array(two["n"], pa.int64()),
                 pa.array(total)], names=["lang", "s1", "c1", "s2", "c2", "n"])

    ddl = "lang string, s1 string, c1 long, s2 string, c2 long, n long"
    return kept.select("lang", "total", "levels").mapInArrow(run, ddl).groupBy(
        "lang", "s1", "c1", "s2", "c2").agg(F.sum("n").alias("n"))


def price(count, occurrences, terms) -> Column:
    """1 + floor(SCALE * (count + 1) / (N + V)), exact; null without terms."""
    count, occurrences, terms = (F.col(c) if isinstance(c, str) else c for c in (count, occurrences, terms))
    top = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 1)
    whole = F.call_function("div", top, (occurrences + F.nullif(terms, F.lit(0))).cast("decimal(20,0)"))
    return F.lit(1) + whole


def differ(p, q) -> Column:
    """floor((p - q)^2 / q); prices are at most SCALE + 1, so the square fits 64 bits."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(joint: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: each source priced against each other source of its language.

    With f(i, j) the price difference at levels i and j, and level 0 left out of the tables:
    sum = V f(0,0) + sum_i n(i) (f(i,0) - f(0,0)) + sum_j n(j) (f(0,j) - f(0,0))
    + sum_ij n(i,j) (f(i,j) - f(i,0) - f(0,j) + f(0,0)).
    """
    zero = groups.select("lang", "source", "occurrences", "terms",
                         price(F.lit(0), "occurrences", "terms").alias("p0"))
    one, two = (zero.select("lang", F.col("source").alias(f"s{k}"), F.col("occurrences").alias(f"o{k}"),
                            F.col("p0").alias(f"z{k}"), "terms") for k in (1, 2))
    pairs = one.join(two.drop("terms"), "lang").where("s1 <> s2")
    base = pairs.select("lang", F.col("s1").alias("source"), F.col("s2").alias("item"),
                        F.coalesce(F.col("terms") * differ("z1", "z2"), F.lit(0)).alias("v"))
    # Margins: the diagonal, once for each other source, in both roles.
    margin = joint.where("s1 = s2").select("lang", F.col("s1").alias("s"), F.col("c1").alias("c"), "n")
    own = margin.join(zero.select("lang", F.col("source").alias("s"), "occurrences", "terms", "p0"), ["lang", "s"])
    own = own.select("lang", "s", "n", F.col("p0").alias("z"), price("c", "occurrences", "terms").alias("p"))
    rest = zero.select("lang", F.col("source").alias("o"), F.col("p0").alias("zo"))
    both = own.join(rest, "lang").where("s <> o")
    ahead = both.select("lang", F.col("s").alias("source"), F.col("o").alias("item"),
                        (F.col("n") * (differ("p", "zo") - differ("z", "zo"))).alias("v"))
    behind = both.select("lang", F.col("o").alias("source"), F.col("s").alias("item"),
                         (F.col("n") * (differ("zo", "p") - differ("zo", "z"))).alias("v"))
    cells = joint.where("s1 <> s2").join(one, ["lang", "s1"]).join(two.drop("terms"), ["lang", "s2"])
    cells = cells.select("lang", "s1", "s2", "n", "z1", "z2", price("c1", "o1", "terms").alias("p1"),
                         price("c2", "o2", "terms").alias("p2"))

    def cell(a: str, b: str) -> DataFrame:
        f = (differ(f"p{a}", f"p{b}") - differ(f"p{a}", f"z{b}") - differ(f"z{a}", f"p{b}")
             + differ(f"z{a}", f"z{b}"))
        return cells.select("lang", F.col(f"s{a}").alias("source"), F.col(f"s{b}").alias("item"),
                            (F.col("n") * f).alias("v"))

    parts = base
    for part in (ahead, behind, cell("1", "2"), cell("2", "1")):
        parts = parts.unionByName(part)
    # The parts may exceed 64 bits where their sum does not.
    value = F.sum(F.col("v").cast("decimal(20,0)")).cast("long")
    return parts.groupBy("lang", "source", "item").agg(value.alias("value"))


def term_values(kept: DataFrame, groups: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, source, item, value: kept terms that a source uses more than its language does."""
    rows = kept.join(languages, "lang").select(
        "lang", F.col("term").alias("item"), price("total", "occurrences", "terms").alias("q"),
        F.explode("levels").alias("x"))
    rows = rows.select("lang", "item", "q", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    rows = rows.join(groups, ["lang", "source"]).withColumn("p", price("n", "occurrences", "terms"))
    return rows.where("p > q").select("lang", "source", "item", differ("p", "q").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank."""
    counts = term_counts(docs)
    kept = materialize(kept_terms(counts, min_docs), "kept-terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("occurrences"))
    languages = common.small(materialize(languages, "languages"))
    used = kept.select("lang", F.explode("levels").alias("x")).groupBy(
        "lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("occurrences"))
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    groups = seen.distinct().join(used, ["lang", "source"], "left").join(
        languages.select("lang", "terms"), "lang", "left")
    groups = common.small(materialize(groups.fillna(0, ["occurrences", "terms"]), "groups"))
    joint = materialize(level_products(kept), "level-products")
    by = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pair_values(joint, groups).withColumn("rank", F.row_number().over(by))
    terms = term_values(kept, groups, languages).withColumn("rank", F.row_number().over(by)).where(
        F.col("rank") <= top_terms)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(
        terms.withColumn("part", F.lit("term")).select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_divergence``: pairs of sources and leading terms of every source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words,
         row_number() OVER () AS r
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1))
           // (coalesce((SELECT sum(x.n) FROM c x WHERE x.lang = g.lang AND x.source = g.source), 0)::HUGEINT + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL),
term AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value
  FROM p JOIN (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
               FROM k JOIN v USING (lang)) q USING (lang, term)
  WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term)
WHERE rank <= 200
"""
