"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces of
the product of the pieces' probabilities (forward algorithm on the piece
lattice of ``pieces.Transducer``); a text's score is the product over its
words. The probabilities are fitted by expectation maximisation: forward and
backward sums give the expected piece counts, summed over the words of a
bounded sample of about ``rows_per_lang`` texts of each language.

Scoring is one scan: a task computes each distinct word once and keeps up to
``KEEP_WORDS`` of them between slices.

Defined results: a text that is null or has no letter is ``und`` with score 0.
Ties go to the first language in alphabetical order. Rows whose language or id is
null, or that are held out, are never learned from; without any training row
every text is ``und``. Every input row gives one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import common
from .pieces import SPACE, UNIGRAM, Transducer, read_model
from .sentencepiece_fst import MODEL

#: About so many training texts of each language.
ROWS_PER_LANG = 600
ITERATIONS = 3
#: Expected counts added to each piece from the languages' common distribution.
SMOOTH = 50.0
#: Probability left for a character without a piece.
ODD = 1e-7
KEEP_WORDS = 150_000
#: Languages up to which their table (a name and a number) is broadcast.
MAX_LANGS = 10_000
BLOCK_CHARS = 150_000

_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased words; ASCII other than letters separates."""
    return common.split_words([(t or "").lower().encode().translate(_LETTERS) for t in texts])


class Lattice:
    """All segmentations of some words, in blocks of nodes that no piece spans."""

    def __init__(self, fst: Transducer, words: list[bytes]):
        text = [SPACE + w.decode() for w in words]
        self.off = np.concatenate(([0], np.cumsum([len(w) for w in text], dtype=np.int64)))
        chars = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.pid = fst.arcs(chars, self.off)
        self.cut = fst.segments(self.pid, self.off)
        length = np.diff(self.cut)
        order = np.argsort(-length, kind="stable")
        self.seg, self.length = self.cut[:-1][order], length[order]
        self.is_cut = np.zeros(len(chars) + 1, dtype=bool)
        self.is_cut[self.cut] = True
        self.seg_word = common.text_of(self.off, self.cut[:-1])

    def _active(self, p: int) -> np.ndarray:
        return np.searchsorted(-self.length, -p, side="right")

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all paths from a segment's start to each node."""
        alpha = np.full((len(self.is_cut), logp.shape[1]), -np.inf)
        for p in range(1, int(self.length[0]) + 1):
            e = self.seg[:self._active(p)] + p
            for k in range(1, min(len(self.pid), p) + 1):
                t = self.pid[k - 1, e - k]
                i = np.flatnonzero(t >= 0)
                s = e[i] - k
                step = np.where(self.is_cut[s][:, None], 0.0, alpha[s]) + logp[t[i]]
                alpha[e[i]] = np.logaddexp(alpha[e[i]], step)
        return alpha

    def backward(self, logp: np.ndarray) -> np.ndarray:
        """The same from each node to its segment's end."""
        beta = np.full((len(self.is_cut), logp.shape[1]), -np.inf)
        for p in range(int(self.length[0]) - 1, 0, -1):
            n = self._active(p + 1)
            s, room = self.seg[:n] + p, self.length[:n] - p
            for k in range(1, len(self.pid) + 1):
                t = self.pid[k - 1, s]
                i = np.flatnonzero((t >= 0) & (room >= k))
                e = s[i] + k
                step = np.where(self.is_cut[e][:, None], 0.0, beta[e]) + logp[t[i]]
                beta[s[i]] = np.logaddexp(beta[s[i]], step)
        return beta

    def word_logs(self, logp: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        seg = self.forward(logp)[self.cut[1:]]
        first = np.flatnonzero(np.diff(self.seg_word, prepend=-1))
        return np.add.reduceat(seg, first, axis=0)

    def expected(self, logp: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language; ``freq``: words x languages."""
        alpha, beta = self.forward(logp), self.backward(logp)
        seg_of = np.searchsorted(self.cut, np.arange(len(self.is_cut) - 1), side="right") - 1
        total = alpha[self.cut[1:]]
        alpha[self.cut] = 0.0
        beta[self.cut] = 0.0
        counts = np.zeros(logp.shape)
        for k in range(1, len(self.pid) + 1):
            s = np.flatnonzero(self.pid[k - 1] >= 0)
            t, g = self.pid[k - 1, s], seg_of[s]
            share = np.exp(alpha[s] + logp[t] + beta[s + k] - total[g]) * freq[self.seg_word[g]]
            for c in range(logp.shape[1]):
                counts[:, c] += np.bincount(t, weights=share[:, c], minlength=len(counts))
        return counts


def blocks(words: list[bytes]) -> list[tuple[int, int]]:
    size = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) // BLOCK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(words)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


@dataclass
class LanguageModel:
    """``logp``: pieces (and the odd character) x languages."""
    fst: Transducer
    langs: list[str]
    logp: np.ndarray
    _table: common.WordTable = field(default_factory=lambda: common.WordTable(KEEP_WORDS))
    _rows: np.ndarray | None = None

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        rows = [Lattice(self.fst, words[a:b]).word_logs(self.logp) for a, b in blocks(words)]
        return np.concatenate([*rows, np.zeros((0, len(self.langs)))])

    def text_logs(self, texts: list[str | None]) -> np.ndarray:
        """Log probability of each text in each language."""
        words, off = words_of(texts)
        code, hashes = pd.factorize(common.hash_words(words))
        at = self._table.get(hashes)
        new = np.flatnonzero(at < 0)
        if self._rows is None or len(self._rows) + len(new) > KEEP_WORDS:
            self._table.clear()
            self._rows = np.zeros((0, len(self.langs)))
            at, new = np.full(len(hashes), -1), np.arange(len(hashes))
        first = np.zeros(len(hashes), dtype=np.int64)
        first[code[::-1]] = np.arange(len(words) - 1, -1, -1)
        at[new] = len(self._rows) + np.arange(len(new))
        self._rows = np.concatenate((self._rows, self.word_rows([words[i] for i in first[new]])))
        self._table.add(hashes[new])
        each = self._rows[at[code]] if len(code) else np.zeros((0, len(self.langs)))
        total = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(each, axis=0)))
        return total[off[1:]] - total[off[:-1]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most likely language and its posterior under equal priors."""
        logs = self.text_logs(texts) if self.langs else np.zeros((len(texts), 1))
        top = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        known = [bool(self.langs) and any(map(str.isalpha, t or "")) for t in texts]
        return ([self.langs[i] if k else "und" for i, k in zip(top, known, strict=True)],
                np.where(known, score, 0.0))


def fit(fst: Transducer, texts: list[str], langs: list[str]) -> LanguageModel:
    """Expectation maximisation over the distinct words of the sample."""
    names = sorted(set(langs))
    words, off = words_of(texts)
    if not names or not words:
        return LanguageModel(fst, [], np.zeros((fst.size + 1, 0)))
    lang = np.array([names.index(x) for x in langs])[common.text_of(off, np.arange(len(words)))]
    code, hashes = pd.factorize(common.hash_words(words))
    first = np.zeros(len(hashes), dtype=np.int64)
    first[code[::-1]] = np.arange(len(words) - 1, -1, -1)
    distinct = [words[i] for i in first]
    del words
    freq = np.zeros((len(distinct), len(names)))
    np.add.at(freq, (code, lang), 1.0)
    logp = np.full((fst.size + 1, len(names)), -np.log(fst.size))
    logp[fst.oov] = np.log(ODD)
    parts = [(Lattice(fst, distinct[a:b]), freq[a:b]) for a, b in blocks(distinct)]
    for _ in range(ITERATIONS):
        count = np.zeros_like(logp)
        for lattice, f in parts:
            count += lattice.expected(logp, f)
        share = count[:-1].sum(axis=1, keepdims=True) + 0.01
        p = count[:-1] + SMOOTH * share / share.sum()
        logp = np.concatenate((np.log(p / p.sum(axis=0)), logp[-1:]))
    return LanguageModel(fst, names, logp)


def training_rows(docs: DataFrame, rows_per_lang: int) -> DataFrame:
    """About ``rows_per_lang`` texts of each language, those with the smallest hashes of id and text."""
    d = docs.select("doc_id", "text", "lang").where(
        "doc_id is not null and lang is not null and text is not null")
    d = d.where(~common.held_out(F.col("doc_id")))
    share = d.groupBy(F.col("lang").alias("_lang")).agg(
        (F.lit(float(rows_per_lang)) / F.count("*")).alias("share"))
    share = materialize(share, "languages")
    if share.count() <= MAX_LANGS:  # one row per language; beyond it the join shuffles the texts
        share = F.broadcast(share)
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return (d.join(share, F.col("lang") == F.col("_lang")).where(u < F.col("share"))
            .select("text", "lang").orderBy("lang", "text"))


def language_id(docs: DataFrame, vocabulary: str = MODEL,
                rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from ``docs`` itself."""
    fst = Transducer(replace(read_model(vocabulary), kind=UNIGRAM))
    rows = training_rows(docs, rows_per_lang).collect()
    model = fit(fst, [r["text"] for r in rows], [r["lang"] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        m = LanguageModel(own.fst, own.langs, own.logp)  # the word cache ends with the task

        def run(texts: pa.Array) -> list[pa.Array]:
            lang, score = m.predict(texts.to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return run

    out = common.add_columns(docs.select("doc_id", "text"), "text",
                             [("lang_pred", "string"), ("score", "double")], start)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"),
                      "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_language_id``: language of every document."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
