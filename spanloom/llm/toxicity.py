"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the hashed embeddings of the word and of its
byte n-grams, so unseen forms of a stem share most of their vector. Filters of
one, two and three words slide over the text; each filter's maximum over the
whole text goes to a logistic output. A filter of ``k`` words is ``k`` dot
products per word, so a task computes them once per distinct word and only
adds them per position. They are kept one filter after the other (filter, word),
so that gathering, adding and taking maxima run along memory.

Every labelled row is learned from, three quarters (by a hash of the id) for the weights and
the rest for the thresholds. The counts behind the starting weights and the language
profile are sums over all rows. The rows are then dealt by id into shards of about
``SHARD_ROWS``; each is trained on in its own task from the same start, and the weights
move by the mean of the shards' changes (an embedding by the mean over the shards that
changed it), added as integers so that their order does not matter. The driver sees sums
of a fixed size only. The model is a few MB and is broadcast. Thresholds are calibrated for
each training language over all calibration rows; at scoring, the language is read off the
text by a hashed-word profile, so a score is a function of the text alone and 0.5 is the
threshold.

Defined results: a null or empty text is scored like a text without words (low);
every input row gives one row. Rows without a label, with a null label or id, or
held out (crc32 of the id as text modulo 5 is 0) are never trained on; several labels of one
id count as toxic if any is. Without both classes in the training rows all
scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import OrderedScan
from ..session import materialize
from . import common

BUCKETS = 1 << 17
LANG_BUCKETS = 1 << 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
GRAMS = (4, 5, 6)
#: About so many training rows are trained on in one task; bounds its memory.
SHARD_ROWS = 2000
#: Training texts handled at once.
CHUNK_TEXTS = 50
EPOCHS = 3
BATCH = 64
#: Smoothing of a bucket's class log-odds, in texts.
PRIOR_TEXTS = 5.0
SLICE_BYTES = 1 << 20
#: Rows of embeddings, or positions of words, gathered at once (a longer text's alone).
BLOCK = 1 << 14
#: Changes of weights are added as multiples of 2^-SCALE_BITS.
SCALE_BITS = 40
#: Words whose filter products a task keeps.
CACHE_WORDS = 100_000

_LETTERS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased words; ASCII other than letters and digits separates."""
    return common.split_words([(t or "").lower().encode().translate(_LETTERS) for t in texts])


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``tokens`` by number: each word's number among the distinct ones, each text's offsets, the distinct words."""
    parts = [(t or "").lower().encode().translate(_LETTERS) for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    end = np.cumsum([len(p) + 1 for p in parts])  # of each text, its separator included
    letter = data != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # the last byte separates
    if letter[0]:
        edge = np.concatenate(([0], edge))
    start, size = edge[::2], edge[1::2] - edge[::2]
    bounds = np.concatenate(([0], np.cumsum(size)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(bounds), pa.py_buffer(data[letter])]).dictionary_encode()
    off = np.concatenate(([0], np.searchsorted(start, end)))
    return words.indices.to_numpy(), off, words.dictionary.to_numpy(zero_copy_only=False).tolist()


def factorize(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number of each word's distinct form, the distinct hashes, the distinct words."""
    code, hashes = pd.factorize(common.hash_words(words))
    first = np.zeros(len(hashes), dtype=np.int64)
    first[code[::-1]] = np.arange(len(words) - 1, -1, -1)
    return code, hashes, [words[i] for i in first]


def distinct(values: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each value once; ``mark`` is room for one number per possible value, of any content."""
    place = np.arange(len(values), dtype=mark.dtype)
    mark[values] = place
    return values[mark[values] == place]


def numbers(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them; values are under ``limit``."""
    met = np.zeros(limit, np.bool_)
    met[values] = True
    found = np.flatnonzero(met)
    number = np.empty(limit, np.int32)
    number[found] = np.arange(len(found))
    return found, number[values]


def grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the buckets of all n-grams, word by word, and each word's number of them."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = b"<" + b"><".join(words) + b">" if words else b""
    byte = _BYTE[np.frombuffer(text, dtype=np.uint8)]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(byte))  # bytes from here to the word's end
    h, done = byte, 1
    for n in GRAMS:
        while done < n:  # the polynomial of ``common.windows``, one byte longer each time
            h = h[:-1] * np.uint64(common.ROLL[0]) + byte[done:]
            done += 1
        h_in = common.mix(h[left[:len(h)] >= n])
        yield (h_in & np.uint64(BUCKETS - 1)).astype(np.int64), np.maximum(size - n + 1, 0)


def blocks(start: np.ndarray, n: int) -> list[int]:
    """Cuts of the segments that start there and end at ``n`` into blocks of about ``BLOCK`` places."""
    cuts = np.unique(np.searchsorted(start, np.arange(0, n, BLOCK)))
    return [*cuts[cuts < len(start)], len(start)]


def bucket_sums(embed: np.ndarray, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the buckets' embeddings from each start to the next, in blocks that fit a core's cache."""
    cuts = blocks(start, len(bucket))
    ends = np.append(start, len(bucket))
    sums = np.empty((len(start), embed.shape[1]), embed.dtype)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.take(embed, bucket[ends[a]:ends[b]], axis=0, mode="clip")
        np.add.reduceat(part, start[a:b] - start[a], axis=0, out=sums[a:b])
    return sums


def features(words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word and of its n-grams, and their offsets."""
    parts = [((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), np.ones(len(words), np.int64)), *grams(words)]
    off = np.concatenate(([0], np.cumsum(sum(n for _, n in parts))))
    bucket, at = np.empty(off[-1], np.int32), off[:-1].copy()
    for b, n in parts:
        bucket[common.ragged(at, n)] = b
        at += n
    return bucket, off


@dataclass
class Model:
    """Weights; ``conv[k]`` is (width, DIM, FILTERS); offsets move each language's threshold to 0."""
    embed: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    langs: list[str] = field(default_factory=list)
    profile: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: bool = False
    _cache: WordRows | None = None

    def vectors(self, bucket: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean embedding of each word, from its buckets and their offsets."""
        return bucket_sums(self.embed, bucket, off[:-1]) / np.diff(off)[:, None]

    def word_vectors(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The same from the words, one n-gram size at a time."""
        total = np.take(self.embed, (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), axis=0)
        count = np.ones(len(words))
        for bucket, n in grams(words):
            some = np.flatnonzero(n)
            if len(some):
                start = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                total[some] += bucket_sums(self.embed, bucket, start)
                count += n
        return total / count[:, None]

    def flat(self) -> np.ndarray:
        """All filter rows side by side."""
        return np.concatenate([w[j] for w in self.conv.values() for j in range(len(w))], axis=1)

    def word_rows(self, words: list[bytes], hashes: np.ndarray, block: int = 20_000) -> np.ndarray:
        """The dot products of every filter row with each distinct word; last column: the padding word."""
        flat = self.flat()
        rows = np.zeros((flat.shape[1], len(words) + 1), np.float32)
        for a in range(0, len(words), block):
            b = min(a + block, len(words))
            rows[:, a:b] = (self.word_vectors(words[a:b], hashes[a:b]) @ flat).T
        return rows

    def cached_rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``word_rows`` and profile slots of distinct words, most from this task's table."""
        if self._cache is None:
            self._cache = WordRows(self)
        return self._cache.get(words)

    def responses(self, rows: np.ndarray, padded: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width the response of each filter at every position of the padded word sequence."""
        col = 0
        for k, w in self.conv.items():
            r = np.empty((FILTERS, len(padded)), np.float32)
            for f in range(FILTERS):
                np.take(rows[col + f], padded, out=r[f], mode="clip")
            r += self.bias[k][:, None]
            for j in range(1, len(w)):
                col += FILTERS
                for f in range(FILTERS):
                    r[f, :-j] += np.take(rows[col + f], padded[j:], mode="clip")
            col += FILTERS
            yield k, r

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probability of each text."""
        if self.constant:
            return np.zeros(len(texts))
        code, off, words = coded(texts)
        rows, slot = self.cached_rows(words)
        z = self.logits(code, off, rows)
        if self.profile is not None:
            z -= self.offsets[self.language(slot[code], off)]
        return 1 / (1 + np.exp(-z))

    def logits(self, code: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
        padded, starts = pad(code, off, rows.shape[1] - 1)
        pooled = np.empty((FILTERS * len(self.conv), len(starts)), np.float32)
        ends = np.append(starts, len(padded))
        cuts = blocks(starts, len(padded))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # The last position's words reach on.
            for c, (_, r) in enumerate(self.responses(rows, padded[ends[a]:ends[b] + max(WIDTHS) - 1])):
                np.maximum.reduceat(r[:, :ends[b] - ends[a]], starts[a:b] - starts[a], axis=1,
                                    out=pooled[c * FILTERS:(c + 1) * FILTERS, a:b])
        pooled = np.ascontiguousarray(np.maximum(pooled, 0).T)
        return (pooled @ self.out + self.out_bias).astype(np.float64)

    def language(self, slot: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of each text's language, from its words' slots of the profile."""
        if not len(slot):
            return np.zeros(len(off) - 1, dtype=np.int64)
        total = np.zeros((len(self.langs), len(slot) + 1))
        for c, of in enumerate(np.ascontiguousarray(self.profile.T)):
            np.cumsum(np.take(of, slot), dtype=np.float64, out=total[c, 1:])
        return np.argmax(total[:, off[1:]] - total[:, off[:-1]], axis=0)


class WordRows:
    """Filter products and profile slots of words met before in a task; the most used half stays when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.table = common.WordTable(CACHE_WORDS)
        self.rows = np.zeros((model.flat().shape[1], 0), np.float32)  # (filter row, word)
        self.slot, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.move(np.zeros(0, np.int64), CACHE_WORDS * 5 // 4)

    def get(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Filter products of the distinct words (last column: the padding word), and their slots."""
        if len(self.table.index) > CACHE_WORDS:
            self.shrink()
        hashes, known = common.hash_words(words), len(self.table.index)
        number = self.table.get(hashes)
        new = np.flatnonzero(number < 0)
        n = known + len(new)
        if n > len(self.slot):
            self.move(np.arange(known), n)
        if len(new):
            number[new] = np.arange(known, n)
            self.table.add(hashes[new])
            self.rows[:, known:n] = self.model.word_rows([words[i] for i in new], hashes[new])[:, :-1]
            self.slot[known:n] = lang_slots(hashes[new])
        self.uses[number] += 1
        found = np.zeros((len(self.rows), len(words) + 1), np.float32)
        for row, kept in zip(found, self.rows, strict=True):
            row[:-1] = np.take(kept, number, mode="clip")
        return found, self.slot[number]

    def move(self, keep: np.ndarray, room: int) -> None:
        """Keep these words, in this order, with room for so many."""
        old = self.rows, self.slot, self.uses
        self.rows = np.zeros((len(self.rows), room), np.float32)
        self.slot, self.uses = np.zeros(room, np.int32), np.zeros(room, np.int64)
        for now, before in zip([*self.rows, self.slot, self.uses], [*old[0], *old[1:]], strict=True):
            now[:len(keep)] = before[keep]

    def shrink(self) -> None:
        most = CACHE_WORDS // 2
        keep = np.sort(np.argpartition(-self.uses[:len(self.table.index)], most)[:most])
        self.table.index = self.table.index[keep]
        self.move(keep, CACHE_WORDS * 5 // 4)
        self.uses //= 2


def lang_slots(hashes: np.ndarray) -> np.ndarray:
    """Slots of words in the language profile."""
    return (hashes & np.uint64(LANG_BUCKETS - 1)).astype(np.int32)


def pad(code: np.ndarray, off: np.ndarray, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, each text followed by padding words; and the texts' starts."""
    tail = max(WIDTHS)
    n = len(off) - 1
    padded = np.full(len(code) + tail * n, zero, dtype=np.int64)
    padded[np.arange(len(code)) + tail * np.repeat(np.arange(n), np.diff(off))] = code
    return padded, off[:-1] + tail * np.arange(n)


class Vocabulary:
    """Training texts as numbers: the word codes of each text, and the buckets of each word."""

    def __init__(self, texts: list[str | None]):
        table = common.WordTable(0)
        codes, sizes, buckets, counts = [], [], [], []
        for a in range(0, len(texts), CHUNK_TEXTS):
            code, off, words = coded(texts[a:a + CHUNK_TEXTS])
            hashes = common.hash_words(words)
            at = table.get(hashes)
            new = np.flatnonzero(at < 0)
            at[new] = len(table.index) + np.arange(len(new))
            table.add(hashes[new])
            bucket, boff = features([words[i] for i in new], hashes[new])
            codes.append(at[code].astype(np.int32))
            sizes.append(np.diff(off))
            buckets.append(bucket)
            counts.append(np.diff(boff))
        self.code = np.concatenate(codes)
        self.off = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.hashes = table.index.to_numpy()
        self.bucket = np.concatenate(buckets)
        self.boff = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)

    def words(self, text: int) -> np.ndarray:
        return self.code[self.off[text]:self.off[text + 1]]

    def buckets(self, words: np.ndarray) -> np.ndarray:
        return self.bucket[common.ragged(self.boff[words], self.boff[words + 1] - self.boff[words])]


def start_model(v: Vocabulary, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Model:
    """Weights before training on these rows."""
    n, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    count_buckets(v, rows, y, n, t)
    return start_weights(n, t, y[rows].mean(), rng)


def count_buckets(v: Vocabulary, rows: np.ndarray, y: np.ndarray, n: np.ndarray, t: np.ndarray) -> None:
    """Add to each bucket's number of texts and of toxic texts."""
    word_mark, mark = np.empty(len(v.hashes), np.int32), np.empty(BUCKETS, np.int32)
    for a in range(0, len(rows), CHUNK_TEXTS):
        part = rows[a:a + CHUNK_TEXTS]
        seen = [distinct(v.buckets(distinct(v.words(i), word_mark)), mark) for i in part]
        every, toxic = np.concatenate(seen), np.repeat(y[part], [len(x) for x in seen])
        n += np.bincount(every, minlength=BUCKETS)
        t += np.bincount(every, toxic, minlength=BUCKETS)


def start_weights(n: np.ndarray, t: np.ndarray, base: float, rng: np.random.Generator) -> Model:
    """Weights before training: the first embedding component is the bucket's class log-odds."""
    p = (t + PRIOR_TEXTS * base) / (n + PRIOR_TEXTS)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = np.log(p / (1 - p)) - np.log(base / (1 - base))
    conv, bias = {}, {}
    for k in WIDTHS:
        conv[k] = rng.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32)
        conv[k][:, 0, 0] = 1 / k
        bias[k] = np.zeros(FILTERS, np.float32)
    out = np.full(FILTERS * len(WIDTHS), 0.05, np.float32)
    out[::FILTERS] = 1.0
    return Model(embed, conv, bias, out, -4.0)


def train_step(m: Model, v: Vocabulary, texts: np.ndarray, y: np.ndarray, memory: dict,
               rate: float) -> None:
    """One Adagrad step of the logistic loss over a batch; gradients go to the maxima only."""
    part = [v.words(i) for i in texts]
    use, local = numbers(np.concatenate(part), len(v.hashes))
    each = v.boff[use + 1] - v.boff[use]
    loff = np.concatenate(([0], np.cumsum(each)))
    lbucket = v.buckets(use)
    vec = (m.vectors(lbucket, loff) if len(use) else np.zeros((0, DIM))).astype(np.float32)
    flat = m.flat()
    rows = np.zeros((flat.shape[1], len(use) + 1), np.float32)
    rows[:, :-1] = (vec @ flat).T
    o = np.concatenate(([0], np.cumsum([len(p) for p in part])))
    padded, starts = pad(local, o, len(use))
    ends = np.concatenate((starts[1:], [len(padded)]))
    pooled, best = [], []
    for _, r in m.responses(rows, padded):
        at = np.stack([a + r[:, a:b].argmax(axis=1) for a, b in zip(starts, ends, strict=True)])
        best.append(at)
        pooled.append(np.maximum(r[np.arange(FILTERS), at], 0))
    h = np.concatenate(pooled, axis=1)
    p = 1 / (1 + np.exp(-(h @ m.out + m.out_bias)))
    d = ((p - y[texts]) / len(texts)).astype(np.float32)

    def step(name, w, g):
        s = memory.setdefault(name, np.zeros_like(w))
        s += g * g
        w -= rate * g / (np.sqrt(s) + 1e-6)

    dh = np.outer(d, m.out) * (h > 0)
    padded = np.concatenate((padded, np.full(max(WIDTHS), len(use))))
    vec0 = np.concatenate((vec, np.zeros((1, DIM), np.float32)))
    dvec = np.zeros_like(vec0)
    for c, k in enumerate(WIDTHS):
        g = dh[:, c * FILTERS:(c + 1) * FILTERS]
        dw = np.zeros_like(m.conv[k])
        for j in range(k):
            word = padded[best[c] + j]
            dw[j] = np.einsum("nfd,nf->df", vec0[word], g)
            np.add.at(dvec, word, g[:, :, None] * m.conv[k][j].T[None])
        step(("bias", k), m.bias[k], g.sum(axis=0))
        step(("conv", k), m.conv[k], dw)
    step("out", m.out, h.T @ d)
    bias = np.array([m.out_bias], np.float32)
    step("out_bias", bias, np.array([d.sum()], np.float32))
    m.out_bias = float(bias[0])
    if len(use):
        hot = np.flatnonzero(np.any(dvec[:-1] != 0, axis=1))
        g = np.repeat(dvec[hot] / each[hot][:, None], each[hot], axis=0)
        b, back = numbers(v.buckets(use[hot]), BUCKETS)
        total = np.zeros((len(b), DIM), np.float32)
        np.add.at(total, back, g)
        s = memory.setdefault("embed", np.zeros_like(m.embed))
        s[b] += total * total
        m.embed[b] -= rate * total / (np.sqrt(s[b]) + 1e-6)


def dense(m: Model) -> np.ndarray:
    """All weights but the embeddings, in rows of ``DIM``."""
    flat = np.concatenate([*[m.conv[k].ravel() for k in WIDTHS], *[m.bias[k] for k in WIDTHS], m.out, [m.out_bias]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM).astype(np.float64)


def set_dense(m: Model, rows: np.ndarray) -> None:
    """The inverse of ``dense``."""
    flat, at = rows.ravel().astype(np.float32), 0
    for part in [*[m.conv[k] for k in WIDTHS], *[m.bias[k] for k in WIDTHS], m.out]:
        part[...] = flat[at:at + part.size].reshape(part.shape)
        at += part.size
    m.out_bias = float(flat[at])


def own(m: Model) -> Model:
    """A copy whose weights may be changed."""
    return replace(m, embed=m.embed.copy(), conv={k: w.copy() for k, w in m.conv.items()},
                   bias={k: w.copy() for k, w in m.bias.items()}, out=m.out.copy(), _cache=None)


def changes(start: Model, texts: list[str | None], labels: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (buckets, then the rows of ``dense``) and scaled changes after training on the texts."""
    rng = np.random.default_rng(seed)
    y, v, m = np.asarray(labels, dtype=np.float32), Vocabulary(texts), own(start)
    memory: dict = {}
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            train_step(m, v, batch, y, memory, 0.05)
    moved = m.embed.astype(np.float64) - start.embed
    at = np.flatnonzero(moved.any(axis=1))
    rest = dense(m) - dense(start)
    diff = np.concatenate((moved[at], rest))
    return (np.concatenate((at, BUCKETS + np.arange(len(rest)))),
            np.rint(diff * 2.0 ** SCALE_BITS).astype(np.int64))


def labelled(labels: DataFrame) -> DataFrame:
    """One row (_id, toxic) of each id that may be learned from."""
    return (labels.where("doc_id is not null and toxic in (0, 1)").where(~common.held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic")))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """d, text, lang, toxic, fit of every labelled row; those that are not ``fit`` calibrate."""
    d = docs.select(F.col("doc_id").alias("d"), "text", "lang" if "lang" in docs.columns
                    else F.lit(None).cast("string").alias("lang"))
    one = d.join(labelled(labels), F.col("d") == F.col("_id")).groupBy("d").agg(
        F.min(F.struct("text", "lang", "toxic")).alias("x"))
    return one.select("d", "x.*", (F.pmod(F.xxhash64("d", F.lit("fit")), F.lit(4)) != 0).alias("fit"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: texts and toxic texts of each bucket (lang null, fit rows), words of each slot by language."""
    n, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    words_of: dict[str, np.ndarray] = {}
    for batch in common.slices(batches, "text", SLICE_BYTES):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        fit = np.flatnonzero(batch.column("fit").to_numpy(zero_copy_only=False))
        v = Vocabulary(texts)
        if len(fit):
            count_buckets(v, fit, batch.column("toxic").to_numpy(), n, t)
        slot = lang_slots(v.hashes)[v.code]
        for x in [x for x in dict.fromkeys(langs) if x is not None]:
            at = words_of.setdefault(x, np.zeros(LANG_BUCKETS, dtype=np.int64))
            at += np.bincount(np.concatenate([slot[v.off[i]:v.off[i + 1]] for i, y in enumerate(langs) if y == x]),
                              minlength=LANG_BUCKETS)
    for lang, count, toxic in [(None, n, t), *[(x, c, np.zeros(LANG_BUCKETS)) for x, c in words_of.items()]]:
        at = np.flatnonzero(count)
        # A language without words is still a language.
        at = at if len(at) or lang is None else np.zeros(1, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at, pa.int64()),
            "n": pa.array(count[at], pa.float64()).cast(pa.int64()),
            "t": pa.array(toxic[at], pa.float64()).cast(pa.int64())})


def _cuts(scored: DataFrame) -> dict[int, tuple[float, int, int]]:
    """guess -> (the cut between logits with the largest F1, toxic rows, clean rows); -1: all rows."""
    every = scored.unionByName(scored.withColumn("guess", F.lit(-1)))
    per = materialize(every.groupBy("guess", (-F.col("z")).alias("down")).agg(
        F.sum("toxic").alias("hit"), F.count("*").alias("n")), "logits")
    total = per.groupBy("guess").agg(F.sum("hit").alias("toxic"), F.sum("n").alias("rows"))
    plan = OrderedScan(per, ["guess"], ["down"])
    ranked = plan.finish(plan.scan(plan.frame, [("hits", "sum_upto", "hit"), ("upto", "sum_upto", "n"),
                                                ("next", "lead", "down")]))
    ranked = ranked.join(F.broadcast(total), "guess")  # one row per language
    f1 = 2.0 * F.col("hits") / (F.col("upto") + F.col("toxic"))
    cut = (F.col("down") + F.coalesce("next", F.col("down") + 2)) / -2
    best = ranked.groupBy("guess", "toxic", "rows").agg(
        F.max_by(cut, F.struct(f1.alias("f"), (-F.col("down")).alias("z"))).alias("cut"))
    return {r["guess"]: (r["cut"], r["toxic"], r["rows"] - r["toxic"]) for r in best.collect()}


def fit_model(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = 11) -> Model:
    """Train on all labelled rows (see module doc)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = materialize(training_rows(docs, labels), "training-rows")
    n = {(r["fit"], r["toxic"]): r["count"] for r in rows.groupBy("fit", "toxic").count().collect()}
    empty = np.zeros(0, np.float32)
    if not all(n.get((True, y), 0) + n.get((False, y), 0) for y in (0, 1)):
        return Model(empty, {}, {}, empty, 0.0, constant=True)
    calibrate = rows.where("not fit")
    if not all(n.get((True, y)) for y in (0, 1)) or not all(n.get((False, y)) for y in (0, 1)):
        # Too few rows to hold any back: all of them train and calibrate.
        rows = calibrate = rows.withColumn("fit", F.lit(True))
        n = {(True, y): n.get((True, y), 0) + n.get((False, y), 0) for y in (0, 1)}
    size = n[True, 0] + n[True, 1]
    found = rows.select("text", "lang", "toxic", "fit").mapInArrow(
        _counts, "lang string, at bigint, n bigint, t bigint")
    found = found.groupBy("lang", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow().to_pandas()
    by_bucket = found[found["lang"].isna()]
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    seen[by_bucket["at"]], toxic[by_bucket["at"]] = by_bucket["n"], by_bucket["t"]
    start = start_weights(seen, toxic, n[True, 1] / size, np.random.default_rng(seed))

    shared = spark.sparkContext.broadcast(start)

    def train(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("d")
        at, diff = changes(shared.value, table["text"].to_pylist(), table["toxic"].to_pylist(), seed + key[0].as_py())
        common.release()
        return pa.table({"at": pa.array(at, pa.int64())} | {f"v{j}": diff[:, j] for j in range(DIM)})

    shards = max(1, -(-size // shard_rows))
    dealt = rows.where("fit").select("d", "text", "toxic", F.pmod(F.xxhash64("d"), F.lit(shards)).alias("shard"))
    moved = dealt.groupBy("shard").applyInArrow(
        train, "at bigint, " + ", ".join(f"v{j} bigint" for j in range(DIM)))
    moved = moved.groupBy("at").agg(F.count("*").alias("c"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(DIM)])
    moved = moved.toArrow().to_pandas()
    shared.unpersist()
    mean = moved[[f"v{j}" for j in range(DIM)]].to_numpy(np.float64) / moved[["c"]].to_numpy() / 2.0 ** SCALE_BITS
    at, m = moved["at"].to_numpy(), own(start)
    m.embed[at[at < BUCKETS]] += mean[at < BUCKETS].astype(np.float32)
    rest = dense(m)
    rest[at[at >= BUCKETS] - BUCKETS] += mean[at >= BUCKETS]
    set_dense(m, rest)

    m.langs = sorted(found["lang"].dropna().unique())
    if m.langs:
        count = np.full((LANG_BUCKETS, len(m.langs)), 0.1)
        for c, x in enumerate(m.langs):
            of = found[found["lang"] == x]
            count[of["at"], c] += of["n"]
        m.profile = np.log(count / count.sum(axis=0)).astype(np.float32)
        m.offsets = np.zeros(len(m.langs))
    cuts = _cuts(materialize(_logits(calibrate, m), "calibration"))
    general = cuts[-1][0]
    if not m.langs:
        m.out_bias -= general
    for c in range(len(m.langs)):
        cut, toxic, clean = cuts.get(c, (general, 0, 0))
        m.offsets[c] = cut if toxic >= 10 and clean else general
    return m


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """guess (the language's number), z (before any offset), toxic of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replace(shared.value, _cache=None)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            code, off, words = coded(batch.column("text").to_pylist())
            found, slot = m.cached_rows(words)
            z = m.logits(code, off, found)
            guess = m.language(slot[code], off) if m.langs else np.zeros(len(off) - 1)
            yield pa.RecordBatch.from_pydict({"guess": pa.array(guess, pa.float64()).cast(pa.int32()), "z": z,
                                              "toxic": batch.column("toxic").cast(pa.int64())})

    return rows.select("text", "toxic").mapInArrow(run, "guess int, z double, toxic bigint")


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = replace(shared.value, _cache=None)  # the cache ends with the task
        return lambda texts: [pa.array(m.scores(texts.to_pylist()), pa.float64())]

    return common.add_columns(docs, text_col, [(name, "double")], start, SLICE_BYTES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit_model(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_toxicity``: score of every document."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    spark.read.parquet(f"{sf_dir}/labels.parquet"))
