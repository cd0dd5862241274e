"""Near duplicates: ProbMinHash sketches, banding, exact verification, connected classes.

Each distinct word sequence is a node. Its five-word shingles are weighted by
1 + ln(count). Every shingle is a Poisson process whose rate is its weight: it
arrives again and again at exponential distances and each arrival falls on one of
``REGISTERS`` registers; a register keeps its first arrival. Processes stop at
a time by which all registers are almost surely taken (and go on for texts
where one is not), so a text costs about ``REGISTERS * ln(REGISTERS)``
arrivals beyond one per shingle. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. A text that repeats
a shingle also gets the registers of its plain shingle set (all weights 1; the
same as the weighted ones of a text without repeats), since that is what is
verified: their agreement is the Jaccard similarity of the sets.

Nodes that agree in a whole band of registers share a bucket. Buckets are
never expanded into pairs. In each of ``ROUNDS`` rounds a bucket that still
holds more than one class proposes the pairs of one centre with the members of
other classes, as many as it has nodes. The centre is the most typical node, the one whose
buckets hold most nodes: an original among its copies; in the next
round it is the most typical one outside that node's class. Pairs are verified exactly
(Jaccard similarity of the shingle sets at least ``threshold``) and classes are joined. What is
still split after that goes through an exact prefix join: shingles are ordered by
rarity, and two nodes of different classes are proposed where they meet at a shingle
in places that still allow the threshold for their sizes (positional bound). Of each
shingle's nodes those outside its largest class are joined with all, so a large
class is never paired with itself. No link between nodes of one bucket is lost.

Defined results: a null or empty text has no shingles and is its own class;
one to four words are one shingle. The class id is the smallest id of its
rows (null only if all are null); rows are never merged, repeated rows each
appear. Nodes are told apart by a 64-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import common

SHINGLE = 5
THRESHOLD = 0.8
#: Registers, and rows of a band: sets at 0.8 share no band with probability 3e-5, whatever their counts.
REGISTERS, BAND_ROWS = 80, 4
ROUNDS = 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIDE = np.uint64(0xD1B54A32D192ED03)

SKETCH = "doc long, text_hash long, node long, n_shingles long, bands array<long>"


# -- shingles and sketches (inside tasks) -------------------------------------

def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of all texts, and the texts' node hashes."""
    words, off = common.split_words(texts)
    h = common.hash_words(words)
    grams, start = common.windows(h, off, SHINGLE)
    of = common.text_of(off, start)
    n = np.diff(off)
    node = np.zeros(len(texts), dtype=np.uint64)
    place = np.arange(len(words)) - np.repeat(off[:-1], n)
    some = np.flatnonzero(n)
    if len(words):
        powers = common.mix(place.astype(np.uint64) * _GOLD + np.uint64(1)) | np.uint64(1)
        node[some] = common.mix(np.add.reduceat(h * powers, off[:-1][some]) + n[some].astype(np.uint64))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    return np.concatenate((grams, node[short])), np.concatenate((of, short)), node


def weighted(grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) pairs and their counts."""
    key = common.mix(grams + of.astype(np.uint64) * _GOLD)
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0)
    count = np.diff(np.concatenate((first, [len(key)])))
    return grams[order[first]], of[order[first]], count


def registers(item: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int,
              m: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first on each register of each of ``n`` texts (0: no shingle)."""
    out = np.zeros((n, m), dtype=np.uint64)
    total = np.bincount(of, weights=weight, minlength=n)
    todo, horizon = total > 0, m * (np.log(m) + 3)
    while todo.any():
        live = np.flatnonzero(todo[of])
        limit = horizon / total[of]
        time, j = np.zeros(len(item)), 0
        when, where, what = [], [], []
        while len(live):
            turn = np.uint64(j * int(_GOLD) & (1 << 64) - 1)
            x = common.mix(item[live] + turn)
            u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            time[live] -= np.log(u) / weight[live]
            live = live[time[live] <= limit[live]]
            slot = common.mix(item[live] ^ turn ^ _SIDE) % np.uint64(m)
            when.append(time[live])
            where.append(of[live] * m + slot.astype(np.int64))
            what.append(item[live])
            j += 1
        order = np.argsort(-np.concatenate(when), kind="stable")  # the earliest is written last
        flat, taken = out.reshape(-1), np.zeros(n * m, dtype=bool)
        at = np.concatenate(where)[order]
        flat[at] = np.concatenate(what)[order]
        taken[at] = True
        todo &= ~taken.reshape(n, m).all(axis=1)
        horizon *= 3
    return out


def band_keys(reg: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One key per band, which also tells the band."""
    n, m = reg.shape
    parts = reg.reshape(n, m // rows, rows)
    key = np.arange(m // rows, dtype=np.uint64) * _SIDE
    for r in range(rows):
        key = common.mix(key + parts[:, :, r])
    return key.astype(np.int64)


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Node hash, number of distinct shingles and band keys of each text."""
    grams, of, node = shingles(texts)
    item, at, count = weighted(grams, of)
    size = np.bincount(at, minlength=len(texts))
    keys = band_keys(registers(item, at, 1 + np.log(count), len(texts)))
    bands = [k.tolist() if s else [] for k, s in zip(keys, size, strict=True)]
    again = np.bincount(at[count > 1], minlength=len(texts)) > 0
    pick, number = again[at], np.cumsum(again) - 1
    plain = band_keys(registers(item[pick], number[at[pick]], np.ones(pick.sum()), again.sum()))
    for i, k in zip(np.flatnonzero(again), plain, strict=True):
        bands[i] = np.union1d(keys[i], k).tolist()
    return node, size, bands


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash, node, n_shingles and band keys of every row, written once."""
    src = docs.select(F.col(id_col).cast("long").alias("doc"),
                      F.xxhash64(text_col).alias("text_hash"),
                      F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "t"):
            node, size, bands = sketches(common.text_bytes(batch.column("t")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_hash"),
                 pa.array(node.astype(np.int64)), pa.array(size, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc", "text_hash", "node", "n_shingles", "bands"])

    return materialize(src.mapInArrow(run, SKETCH), "sketches")


# -- verification --------------------------------------------------------------

def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have at least the threshold; written."""
    ta = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def shingle_set(node: int, text: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[node] = np.unique(shingles([text])[0])
            return kept[node]

        for batch in common.slices(batches, "tb"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for x, y, s, t in zip(a, b, common.text_bytes(batch.column("ta")),
                                  common.text_bytes(batch.column("tb")), strict=True):
                p, q = shingle_set(x, s), shingle_set(y, t)
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(both >= threshold * (len(p) + len(q) - both))
            mask = np.array(ok, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(a, dtype=np.int64)[mask]), pa.array(np.array(b, dtype=np.int64)[mask])],
                names=["a", "b"])

    return materialize(both.mapInArrow(run, "a long, b long"), "links")


# -- classes --------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, cls): the smallest node reachable over the edges, by label spreading and shortcuts."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("cls")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cls").alias("m"))
        step = label.join(near, F.col("node") == F.col("a")).select(
            "node", "cls", F.least("cls", "m").alias("m"))
        jump = label.select(F.col("node").alias("m"), F.col("cls").alias("far"))
        new = materialize(step.join(jump, "m", "left").select(
            "node", "cls", F.least("m", F.coalesce("far", "m")).alias("next")), "labels")
        changed = new.where("next <> cls").limit(1).count()
        label = new.select("node", F.col("next").alias("cls"))
        if not changed:
            return label


def with_class(df: DataFrame, label: DataFrame | None, node: str = "node") -> DataFrame:
    """Adds ``cls``, the node itself where no class is known."""
    if label is None:
        return df.withColumn("cls", F.col(node))
    lab = common.small(label.select(F.col("node").alias("_n"), F.col("cls").alias("_c")))
    return (df.join(lab, F.col(node) == F.col("_n"), "left")
            .withColumn("cls", F.coalesce("_c", node)).drop("_n", "_c"))


def star_pairs(buckets: DataFrame, label: DataFrame | None, turn: int, threshold: float) -> DataFrame:
    """For each bucket with several classes the pairs of its centre with the members of other classes.

    The centre is the node of the highest ``score`` (ties: the larger node), after the first turn
    the one outside that node's class. Sets whose sizes differ by more than the threshold allows are
    not proposed.
    """
    b = with_class(buckets, label)
    pick = F.max(F.struct("score", "node", "cls", "n")).alias("p")
    center = (b.groupBy("key").agg(pick, F.min("cls").alias("lo"), F.max("cls").alias("hi"))
              .where("lo <> hi").select("key", F.col("p.node").alias("c"), F.col("p.cls").alias("ccls"),
                                        F.col("p.n").alias("cn")))
    if turn:
        other = b.join(center, "key").where("cls <> ccls").groupBy("key").agg(pick)
        center = other.select("key", F.col("p.node").alias("c"), F.col("p.cls").alias("ccls"), F.col("p.n").alias("cn"))
    pairs = b.join(center, "key").where(
        (F.col("cls") != F.col("ccls")) & (F.col("n") >= F.col("cn") * threshold)
        & (F.col("cn") >= F.col("n") * threshold))
    return pairs.select(F.greatest("c", "node").alias("b"), F.least("c", "node").alias("a")).distinct()


def prefixes(buckets: DataFrame, label: DataFrame | None, texts: DataFrame, threshold: float) -> DataFrame:
    """node, n, cls, gram, place: the first shingles, by rarity, of the nodes in buckets of several classes.

    ``place`` counts the node's shingles before this one; those that no other of these nodes has come
    first and are left out. Two sets at the threshold share one of the first
    n - ceil(threshold * n) + 1.
    """
    b = with_class(buckets, label)
    split = b.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    nodes = materialize(b.join(split.select("key"), "key").select("node", "cls").distinct(), "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "t"):
            grams, of, _ = shingles(common.text_bytes(batch.column("t")))
            item, at, _ = weighted(grams, of)
            size = np.bincount(at, minlength=batch.num_rows)
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[at]), pa.array(item.astype(np.int64)), pa.array(size[at], pa.int64())],
                names=["node", "gram", "n"])

    src = texts.join(common.small(nodes.select("node")), "node").select("node", "t")
    each = materialize(src.mapInArrow(run, "node long, gram long, n long"), "grams")
    seen = each.groupBy("gram").agg(F.count("*").alias("uses")).where("uses > 1")
    order = each.join(seen, "gram").groupBy("node").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("uses", "gram"))).alias("g"))
    alone = F.col("n") - F.size("g")
    first = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    prefix = order.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("g", F.lit(1), first)))
    prefix = prefix.select("node", "n", F.col("col.gram").alias("gram"), (F.col("alone") + F.col("pos")).alias("place"))
    return materialize(prefix.join(nodes, "node"), "prefixes")


def prefix_pairs(prefix: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes of different classes that meet at a shingle whose places allow the threshold.

    The shingle may be the first that both have; then they share at most what follows it in
    either, and need threshold / (1 + threshold) of their sizes together. A place is dealt with only
    if another class has the shingle.
    """
    by_class = prefix.groupBy("gram", "cls").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    split = by_class.groupBy("gram").agg(
        F.max(F.struct("k", "cls")).alias("main"), F.count("*").alias("classes"), F.min("least").alias("least"))
    split = materialize(split.where("classes > 1").select("gram", F.col("main.cls").alias("main"), "least"), "split")
    share = threshold / (1 + threshold)

    def allows(n, place, other):
        """Whether a set of ``other`` shingles can share enough after this place."""
        return F.col(n) - F.col(place) >= (F.col(n) + F.col(other)) * share - 1e-9

    p = prefix.join(split, "gram").where(allows("n", "place", "least"))
    left = p.where("cls <> main").select("gram", F.col("node").alias("a"), F.col("n").alias("na"),
                                         F.col("cls").alias("ca"), F.col("place").alias("pa"))
    right = p.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cls").alias("cb"),
                     F.col("place").alias("pb"))
    pairs = left.join(right, "gram").where(
        (F.col("ca") != F.col("cb")) & allows("na", "pa", "nb") & allows("nb", "pb", "na")
        & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """doc, text_hash, node, n_shingles and cls (a node) of every row."""
    common.small_batches(docs.sparkSession)
    found = sketch(docs, id_col, text_col)
    one = found.where("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct("doc", "text_hash")).alias("who"), F.first("bands").alias("bands"),
        F.first("n_shingles").alias("n"))
    keyed = one.select("node", "who", "n", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    buckets = materialize(keyed.join(full, "key"), "buckets")
    # One text of each node that shares a bucket.
    who = materialize(buckets.select("node", "who.doc", "who.text_hash").distinct(), "nodes")
    who = common.small(who.select("node", F.col("doc").alias("_d"), F.col("text_hash").alias("_h")))
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    d = d.join(who, d["doc"].eqNullSafe(F.col("_d")) & (F.xxhash64("t") == F.col("_h")))
    texts = materialize(d.select("node", "t").dropDuplicates(["node"]), "texts")
    score = buckets.groupBy("node").agg(F.sum("k").alias("score"))
    buckets = materialize(buckets.join(score, "node").select("key", "node", "n", "score"), "scored")
    label, links = None, None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = star_pairs(buckets, label, turn, threshold)
        else:
            pairs = prefix_pairs(prefixes(buckets, label, texts, threshold), threshold)
        new = verified(materialize(pairs, "pairs"), texts, threshold)
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        label = components(links)
    return with_class(found.drop("bands"), label)


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, n_shingles of every row."""
    rows = classes(docs, id_col, text_col, threshold)
    full = rows.where("n_shingles > 0")
    size = full.groupBy("cls").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"))
    named = full.join(size, "cls").select(F.col("doc").alias("doc_id"), "class_id", "class_size", "n_shingles")
    alone = rows.where("n_shingles = 0").select(
        F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"),
        F.lit(1).cast("long").alias("class_size"), "n_shingles")
    return named.unionByName(alone)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the smallest id; all columns unchanged.

    Of rows with equal id and text the one whose columns, as JSON, come first stays.
    """
    rows = classes(docs, id_col, text_col, threshold).where("n_shingles > 0")
    # A null id comes after every id.
    best = rows.groupBy("cls").agg(F.min(F.struct(
        F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("best"))
    lost = materialize(
        rows.join(best, "cls").groupBy("doc", "text_hash").agg(
            F.max((F.col("doc").eqNullSafe(F.col("best.doc"))
                   & (F.col("text_hash") == F.col("best.text_hash"))).cast("int")).alias("wins"),
            F.count("*").alias("copies")), "dedup")
    name = {"doc": "_doc", "text_hash": "_hash"}

    def same(t: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(t["_doc"]) & (F.xxhash64(docs[text_col]) == t["_hash"])

    out = common.small(lost.where("wins = 0 or copies > 1").select("doc", "text_hash").withColumnsRenamed(name))
    again = lost.where("wins = 1 and copies > 1").select("doc", "text_hash").withColumnsRenamed(name)
    single = docs.join(out, same(out), "left_anti")
    again = common.small(again)
    repeated = docs.join(again, same(again), "left_semi").groupBy(id_col, text_col).agg(
        F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row"))
    return single.unionByName(repeated.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_near_dup``: class of every document."""
    return near_dup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
