"""Substring containment join (``term in text``) and vocabulary pre-annotation.

``texts JOIN terms ON contains(text, term)`` has no equi-key, so Catalyst
would plan a cartesian product. :func:`term_hits` has two exact physical
strategies over distinct term strings, for any id columns:

* ``ngram`` (default) -- the grams of every length the terms need are looked up by hash among
  the terms' first grams and verified in place. Exact: a term inside a text puts its first gram
  there. A term list under the broadcast limits is shipped to the tasks, which take each length's
  gram hashes of a whole slice of texts as differences of running sums and pass on only the
  first place of each text and term. A larger list is joined: texts are cut into code-point
  chunks, one regex pass per chunk yields the grams, which are equi-joined with the
  terms' (inside a scope, such as the project, if there is one) and verified beside their chunk.
* ``broadcast`` -- on explicit request: a nested-loop join with the broadcast
  terms, for equivalence tests and tiny term lists.

:func:`containment_hits` attaches the hits to vocabulary rows and returns
``KEYS, key, pos, term, start``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanloom.functions.spans import locate0
from spanloom.operators.ordered import MAX_GROUP_ROWS, OrderedScan, largest_group
from spanloom.session import materialize, spread

KEYS = ("project", "doc_id")

# Size limits for shipping a vocabulary to every task.
BROADCAST_MAX_TERMS = 200_000
BROADCAST_MAX_CHARS = 16 << 20
#: Longest anchor gram (code points) of the join, and of the look-up in a task.
MAX_GRAM = 8
LONGEST = 16
#: Rows of an Arrow batch, and bytes of text handled at once in a task.
BATCH_ROWS, SLICE_BYTES = 1000, 1 << 20
# Arbitrary odd numbers; size of the table of hashes in use.
ODD, SPREAD, SLOT_BITS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 18


def _terms_size(terms: DataFrame) -> tuple[int, int]:
    """Number and total length of the distinct non-empty terms (the broadcast size)."""
    row = terms.where(F.length("term") > 0).select("term").distinct().agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("c")
    ).first()
    return int(row["n"]), int(row["c"])


def _distinct_terms(terms: DataFrame, scope: list[str]) -> DataFrame:
    return terms.where(F.length("term") > 0).select(*scope, "term").distinct()


def hits_broadcast(texts: DataFrame, ids: list[str], text_col: str, terms: DataFrame,
                   scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    t = _distinct_terms(terms, scope).withColumnsRenamed({c: f"_s_{c}" for c in scope})
    d = texts.select(*ids, F.col(text_col).alias("_q"))
    on = F.col("_q").contains(F.col("term"))
    for c in scope:
        on = on & (F.col(c) == F.col(f"_s_{c}"))
    return d.join(F.broadcast(t), on).select(*ids, "term", locate0("_q", "term").alias("start"))


def _chunks(texts: DataFrame, ids: list[str], text_col: str, chunk: int, ext: int) -> DataFrame:
    """Code-point chunks of ``chunk`` characters, each extended by the next
    ``ext`` characters so any match starting in a chunk lies inside it."""
    parts = F.regexp_extract_all(F.col(text_col), F.lit("(?s).{1,%d}" % chunk), F.lit(0))
    # A column of its own: inside the lambda the regex would run again for every chunk.
    cut = texts.select(*ids, parts.alias("_parts"))
    more = max(1, -(-ext // chunk))
    tail = F.transform("_parts", lambda c, i: F.concat(c, F.left(F.array_join(
        F.slice("_parts", i + 2, more), ""), F.lit(ext))))
    return cut.select(*ids, F.posexplode(tail).alias("ci", "chunk"))


def _grams(chunks: DataFrame, ids: list[str], sizes: list[int], chunk: int) -> DataFrame:
    """What lies ahead of every code point of a chunk, with the hash of its gram of each of ``sizes``.

    One regex pass per chunk: each match consumes one code point and captures up to
    ``MAX_GRAM`` code points starting there (a lookahead), so element ``j`` of the
    result is what lies ahead at code point ``j``; the shorter grams are its beginnings.
    """
    found = F.regexp_extract_all(F.col("chunk"), F.lit("(?s)(?=(.{1,%d}))." % MAX_GRAM), F.lit(1))
    at = chunks.select(*ids, "ci", "chunk", F.posexplode(F.slice(found, 1, chunk)).alias("j", "ahead"))
    grams = F.array(*[F.xxhash64(F.left("ahead", F.lit(k))) for k in sizes])
    return at.select(*ids, "ci", "chunk", "j", "ahead", F.explode(grams).alias("gram"))


def gram_length(term) -> Column:
    """Length of a term's anchor gram: as long as its length class allows, up to 8."""
    n = F.length(term)
    return F.when(n < 3, n).when(n < 6, F.lit(3)).when(n < 8, F.lit(6)).otherwise(F.lit(8))


class TermIndex:
    """Terms by the hash of their first gram: the term itself up to ``LONGEST`` code points."""

    def __init__(self, terms: list[str]):
        terms = sorted(terms, key=lambda x: (min(len(x), LONGEST), x))
        self.terms = terms
        self.length = np.array([len(x) for x in terms], dtype=np.int64)
        sums, powers, inverse = _running("".join(terms))
        start = np.cumsum(self.length) - self.length
        gram = np.minimum(self.length, LONGEST)
        self.whole = (sums[start + self.length] - sums[start]) * inverse[start]
        first = (sums[start + gram] - sums[start]) * inverse[start]
        #: gram length -> a bit per slot of the hash, the sorted hashes, the terms in that order.
        self.by_gram = {}
        for k in np.unique(gram).tolist():
            of = np.flatnonzero(gram == k)
            of = of[np.argsort(first[of], kind="stable")]
            slots = np.zeros(1 << SLOT_BITS, dtype=bool)
            slots[_slot(first[of])] = True
            self.by_gram[k] = slots, first[of], of

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, number of the term and place of each term's first occurrence in each text."""
        joined = "".join(texts)
        off = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
        n, (sums, _, inverse) = len(joined), _running(joined)
        room = np.repeat(off[1:], np.diff(off)) - np.arange(n)
        out = []
        for k, (slots, hashes, order) in self.by_gram.items():
            if k > n:
                continue
            h = (sums[k:] - sums[:-k]) * inverse[:n - k + 1]
            at = np.flatnonzero(slots[_slot(h)] & (room[:n - k + 1] >= k))
            lo, hi = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            term, pos = order[_ranges(lo, hi - lo)], np.repeat(at, hi - lo)
            fits = room[pos] >= self.length[term]
            term, pos = term[fits], pos[fits]
            same = (sums[pos + self.length[term]] - sums[pos]) * inverse[pos] == self.whole[term]
            term, pos = term[same], pos[same]
            text = np.searchsorted(off, pos, side="right") - 1
            # The first place of each text and term by hash, and then by the term itself.
            while len(pos):
                _, i = np.unique(text * len(self.terms) + term, return_index=True)
                right = np.fromiter((joined.startswith(self.terms[t], p) for t, p in
                                     zip(term[i].tolist(), pos[i].tolist(), strict=True)), bool, len(i))
                out.append((text[i[right]], term[i[right]], pos[i[right]] - off[text[i[right]]]))
                if right.all():
                    break
                wrong = np.isin(text * len(self.terms) + term, (text * len(self.terms) + term)[i[~right]])
                wrong[i[~right]] = False
                text, term, pos = text[wrong], term[wrong], pos[wrong]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _running(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of code points times powers of an odd number modulo 2^64, the powers, and their inverses."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    powers, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(code), x, np.uint64))))
                       for x in (ODD, pow(ODD, -1, 1 << 64)))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * powers[:-1]))), powers, inverse


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(SPREAD)) >> np.uint64(64 - SLOT_BITS)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(start - total[:-1], size) + np.arange(total[-1])


def _hits_in_task(texts: DataFrame, ids: list[str], text_col: str, terms: DataFrame, scope: list[str]) -> DataFrame:
    """The hits of a term list under the broadcast limits, with one scan of the texts."""
    spark = texts.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    shared = spark.sparkContext.broadcast(TermIndex([r["term"] for r in terms.select("term").distinct().collect()]))
    d = texts.select(*ids, F.col(text_col).alias("_q")).where(F.length("_q") > 0)
    fields = {f.name: f for f in d.schema.fields}
    schema = StructType([*[fields[c] for c in ids], StructField("term", StringType()), StructField("start", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = pa.array(index.terms, pa.string())
        for batch in batches:
            column = batch.column(len(ids)).cast(pa.large_binary())
            size = np.cumsum(pc.binary_length(column).to_numpy()) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text, term, start = index.find([x.decode("utf-8", "replace") for x in column[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i)[a:b].take(pa.array(text)) for i in range(len(ids))],
                     names.take(pa.array(term)), pa.array(start, pa.int64())], names=[*ids, "term", "start"])

    hit = d.mapInArrow(run, schema)
    if scope:
        s = F.broadcast(terms.select(*[f"_s_{c}" for c in scope], F.col("term").alias("_term")))
        on = F.col("term") == F.col("_term")
        for c in scope:
            on = on & (F.col(c) == F.col(f"_s_{c}"))
        hit = hit.join(s, on, "left_semi")
    return hit.groupBy(*ids, "term").agg(F.min("start").alias("start"))


def hits_ngram(texts: DataFrame, ids: list[str], text_col: str, terms: DataFrame,
               scope: list[str] | None = None, chunk: int = 512) -> DataFrame:
    """N-gram blocking join: one scan of the texts and one shuffle, whatever the terms' lengths.

    * Terms fall into length classes (1, 2, 3-5, 6-7, 8 and more); each class
      has its own gram length (:func:`gram_length`), so a short term does not
      blunt the anchors of the long ones. One join on the gram's hash (and the scope) serves
      all classes; the verification compares the terms themselves.
    * A term's anchor is its first gram. Text grams are joined with the anchors
      while they still stand beside their chunk, and a match is verified there:
      up to ``MAX_GRAM`` code points by what the regex has captured, beyond by ``substring``. Chunks carry
      ``max_len - 1`` extra characters, so a term that starts in a chunk lies inside it and no text
      is joined again.
    * Under the limits of count and length the terms are broadcast and looked up in the scan
      (:func:`_hits_in_task`); above them the join shuffles by gram.

    Only verified positions leave the scan, reduced to the first per text and
    term before the shuffle.
    """
    scope = scope or []
    t = _distinct_terms(terms, scope).withColumn("tlen", F.length("term")).withColumn("k", gram_length("term"))
    t = materialize(t.select(*[F.col(c).alias(f"_s_{c}") for c in scope], "term", "tlen", "k",
                             F.xxhash64(F.expr("substring(term, 1, k)")).alias("gram")), "anchors")
    stats = t.groupBy("k").agg(F.count("*").alias("n"), F.sum("tlen").alias("chars"), F.max("tlen").alias("hi")).collect()
    fields = {f.name: f for f in texts.schema.fields}
    if not stats:
        empty = StructType([fields[c] for c in ids]
                           + [StructField("term", StringType()), StructField("start", LongType())])
        return texts.sparkSession.createDataFrame([], empty)
    if sum(s["n"] for s in stats) <= BROADCAST_MAX_TERMS and sum(s["chars"] for s in stats) <= BROADCAST_MAX_CHARS:
        return _hits_in_task(texts, ids, text_col, t, scope)
    anchors = t.drop("k")
    chunks = _chunks(texts, ids, text_col, chunk, max(MAX_GRAM, *[s["hi"] for s in stats]) - 1)
    hit = _grams(chunks, ids, sorted(s["k"] for s in stats), chunk).alias("g")
    on = F.col("g.gram") == F.col("a.gram")
    for c in scope:
        on = on & (F.col(f"g.{c}") == F.col(f"a._s_{c}"))
    whole = F.when(F.col("tlen") <= MAX_GRAM, F.left("ahead", F.col("tlen")) == F.col("term")).otherwise(
        F.expr("substring(chunk, j + 1, tlen)") == F.col("term"))
    hit = hit.join(anchors.alias("a"), on).where(whole)
    hit = hit.select(*[F.col(f"g.{c}") for c in ids], "term", (F.col("ci").cast("bigint") * chunk + F.col("j")).alias("pos"))
    return hit.groupBy(*ids, "term").agg(F.min("pos").alias("start"))


def term_hits(texts: DataFrame, ids: list[str], text_col: str, terms: DataFrame,
              strategy: str = "ngram", scope: list[str] | None = None) -> DataFrame:
    """``ids..., term, start``: first occurrence (0-based code points) of every
    distinct non-empty ``terms.term`` inside every text that contains it.

    With ``scope``, columns that both sides have (among the ids of the texts), a term is
    looked for only in texts of the same scope. A strategy that cannot run (term list
    over its limit) is an error; none is replaced by another.
    """
    if strategy not in ("broadcast", "ngram"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "broadcast":
        n, c = _terms_size(terms)
        if n > BROADCAST_MAX_TERMS or c > BROADCAST_MAX_CHARS:
            raise ValueError(f"{n} terms of {c} characters are too many for {strategy!r}; use 'ngram'")
    fn = {"broadcast": hits_broadcast, "ngram": hits_ngram}[strategy]
    return fn(spread(texts), list(ids), text_col, terms, scope)


def _vocab_hits(docs: DataFrame, vocab: DataFrame, strategy: str) -> tuple[DataFrame, list[str]]:
    """Hits of distinct terms in the texts of their project, and the columns that join them to vocabulary rows."""
    scope = ["project"] if "project" in vocab.columns and "project" in docs.columns else []
    hits = term_hits(docs.select(*KEYS, "query"), list(KEYS), "query", vocab, strategy, scope)
    return hits, ["term", *scope]


def containment_hits(docs: DataFrame, vocab: DataFrame, strategy: str = "ngram") -> DataFrame:
    """First occurrence of every vocabulary term in every text (see module doc).

    Terms are matched as distinct strings of a project, then attached to every vocabulary
    row holding them there.
    """
    hits, cols = _vocab_hits(docs, vocab, strategy)
    v = vocab.where(F.length("term") > 0).select(*cols, "key", "pos")
    return hits.join(v, cols).select(*KEYS, "key", "pos", "term", "start")


def term_labels(vocab: DataFrame, label_map: DataFrame | None) -> DataFrame:
    """Vocabulary rows with the labels whose categories include the term's key.

    Without a label map the key itself is the label.
    """
    if label_map is None:
        return vocab.withColumn("label", F.col("key"))
    lm = label_map.select(*(["project"] if "project" in vocab.columns else []),
                          F.col("category").alias("key"), "label")
    return vocab.join(lm, [c for c in ("project", "key") if c in lm.columns])


def annotate_with_vocab(docs: DataFrame, vocab: DataFrame, label_map: DataFrame | None = None,
                        strategy: str = "ngram") -> DataFrame:
    """Pre-annotate texts from a vocabulary.

    Every term found in a text gives one span at its first occurrence, labelled
    with each label mapped to the term's key. Spans are then added greedily in
    the order (start, longer first, label, pos) -- leftmost-longest wins and a
    span overlapping an accepted one is dropped. Returns flat spans.

    In that order, and as no span is empty, a span overlaps an accepted one exactly if it starts
    before the last accepted end, so sorted rows are swept with one number of state. If a text has
    more than ``MAX_GROUP_ROWS`` hits, a running max of the ends (an ordered scan) first cuts them into
    islands that nothing overlaps from outside, and each island is folded by itself.
    """
    hits, cols = _vocab_hits(docs, vocab, strategy)
    labelled = term_labels(vocab.where(F.length("term") > 0), label_map).select(*cols, "key", "pos", "label")
    props = materialize(hits.join(labelled, cols).select(
        *KEYS, "start", (-F.length("term")).alias("neg_len"), "label", F.col("pos").cast("bigint").alias("pos"),
        "key", F.col("term").alias("text")), "proposals")
    order = ["start", "neg_len", "label", "pos", "key", "text"]
    if largest_group(props, list(KEYS)) <= MAX_GROUP_ROWS:
        dealt = props.select(*KEYS, *order).repartition(*KEYS).sortWithinPartitions(*KEYS, *order)
        return _flat(dealt.mapInArrow(_sweep, SWEPT))
    plan = OrderedScan(props, list(KEYS), order, skew_safe=True)
    rows = plan.scan(plan.frame, [("before", "max_before", F.col("start") - F.col("neg_len"))])
    rows = rows.withColumn("first", (F.col("start") >= F.coalesce("before", F.lit(0))).cast("int"))
    rows = materialize(rows, "islands")  # a scan reads its input twice
    rows = plan.finish(plan.scan(rows, [("island", "sum_upto", F.col("first"))]))
    one = rows.groupBy(*KEYS, "island").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("ps"))
    kept_type = "array<struct<start:bigint,neg_len:int,label:string,pos:bigint,key:string,text:string>>"
    kept = F.aggregate(
        "ps", F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(kept_type).alias("out")),
        lambda a, x: F.when(x["start"] < a["end"], a).otherwise(F.struct(
            (x["start"] - x["neg_len"]).alias("end"), F.array_append(a["out"], x).alias("out"))),
        lambda a: a["out"])
    kept = one.select(*KEYS, F.explode(kept).alias("x")).select(*KEYS, "x.*")
    kept = materialize(kept, "kept")
    last = OrderedScan(kept, list(KEYS), ["start"], skew_safe=True)
    return _flat(last.finish(last.scan(last.frame, [("ord", "index", None)])))


SWEPT = ("project string, doc_id bigint, start bigint, neg_len int, label string, pos bigint, key string, "
         "text string, ord bigint")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals sorted by row and order -> those that start at or after the last accepted end, numbered."""
    of, end, n = object(), 0, 0
    for batch in batches:
        keep, ords = [], []
        cells = (batch.column(c).to_pylist() for c in (*KEYS, "start", "neg_len"))
        for i, (project, doc_id, start, neg_len) in enumerate(zip(*cells, strict=True)):
            if (project, doc_id) != of:
                of, end, n = (project, doc_id), 0, 0
            if start >= end:
                keep.append(i)
                ords.append(n)
                end, n = start - neg_len, n + 1
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ords, pa.int64())], names=[*batch.schema.names, "ord"])


def _flat(kept: DataFrame) -> DataFrame:
    return kept.select(
        *KEYS, F.col("ord").cast("bigint").alias("ord"), "text", "label", "start",
        (F.col("start") - F.col("neg_len")).alias("end"),
        F.create_map().cast("map<string,array<string>>").alias("mapped_value"))
