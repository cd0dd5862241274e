"""Quality rules, line first: judge every line, drop the failing ones, then judge what was lost.

Each line of a text is tested by punctuation, navigation, boilerplate and
repetition rules. Failing lines are removed. A document is rejected when the
document-level base rules fail or when the removed lines hold more than
``max_lost`` of its words. Everything is a function of one row, so the
operator is one scan without a shuffle.

Defined results: a null or empty text has no words, no lines and fails the
base rule (too few words); every input row gives one output row, repeated
rows and null ids included; other input columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SYMBOLS = b"#*$%&|<>"
#: A word that only separates menu entries.
SEPARATORS = (b"|", "»".encode(), "›".encode(), "•".encode(), "·".encode())
#: Share of separators among a line's words from which it counts as navigation.
NAV_SHARE = 0.25
#: A line of fewer words must end in punctuation.
SHORT_LINE = 5
#: Words that end in two exclamation marks, as a share of a line's words.
SHOUT_SHARE = 0.5
#: Symbols per byte of word text from which a line counts as noise.
SYMBOL_SHARE = 0.1
END = re.compile(rb"[.!?:;,\"')\]]$|(?:\xe2\x80[\xa6\x99\x9d])$|(?:\xc2\xbb)$")
BOILERPLATE = re.compile(
    rb"(?i)(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved"
    rb"|enable javascript|click here|sign in to|subscribe to our|lorem ipsum)")
RULES = ("navigation", "punctuation", "symbols", "boilerplate", "repeated")

OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("n_lines", pa.int64()), ("n_lines_removed", pa.int64()), ("n_words_removed", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("reason", pa.string()),
    ("clean_text", pa.string())])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
       "n_repeat_words long, n_lines long, n_lines_removed long, n_words_removed long, "
       "base_failed boolean, kept boolean, reason string, clean_text string")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~_SPACE


def line_rule(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with words fails, or None."""
    n = len(words)
    if sum(w in SEPARATORS for w in words) >= max(1, NAV_SHARE * n):
        return "navigation"
    size = sum(map(len, words))
    if len(line.translate(None, SYMBOLS)) < len(line) - SYMBOL_SHARE * size:
        return "symbols"
    if (n < SHORT_LINE and not END.search(words[-1])
            or sum(w.endswith(b"!!") for w in words) >= max(1, SHOUT_SHARE * n)):
        return "punctuation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    return None


def clean_lines(text: bytes) -> tuple[list[bytes], int, int, int, int, dict[str, int]]:
    """Kept lines; lines with a word, equal to an earlier one, removed; words removed; removals by rule."""
    kept, seen, why = [], set(), {}
    n_lines = n_dup = removed = words_removed = 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            kept.append(line)
            continue
        n_lines += 1
        rule = "repeated" if line in seen else line_rule(line, words)
        n_dup += line in seen
        seen.add(line)
        if rule:
            removed += 1
            words_removed += len(words)
            why[rule] = why.get(rule, 0) + len(words)
        else:
            kept.append(line)
    return kept, n_lines, n_dup, removed, words_removed, why


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 50, max_repeat: float = 0.5,
                  max_lost: float = 0.3) -> DataFrame:
    """One row per input row: counts, removed lines, the verdict, its reason and the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts = common.text_bytes(batch.column("text"))
            words, off = common.split_words(texts)
            n = np.diff(off)
            tri, start = common.windows(common.hash_words(words), off, 3)
            key = common.mix(tri + common.text_of(off, start).astype(np.uint64))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            repeat = common.sums(common.cover(len(words), start[twice], 3), off)
            buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
            at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            chars, symbols = common.sums(_CHAR[buf], at), common.sums(_SYMBOL[buf], at)
            lines = [clean_lines(t) for t in texts]
            base = (n < min_words) | (repeat > max_repeat * n)
            lost = np.array([x[4] for x in lines]) > max_lost * n
            reason = [("few_words" if n[i] < min_words else "repeated_words") if base[i]
                      else max(sorted(lines[i][5]), key=lines[i][5].get) if lost[i] else None
                      for i in range(len(texts))]
            yield common.record_batch(
                OUT, doc_id=batch.column("doc_id"), n_words=n, word_chars=chars,
                n_symbols=symbols, n_dup_lines=[x[2] for x in lines], n_repeat_words=repeat,
                n_lines=[x[1] for x in lines], n_lines_removed=[x[3] for x in lines],
                n_words_removed=[x[4] for x in lines], base_failed=base, kept=~(base | lost),
                reason=reason,
                clean_text=[b"\n".join(x[0]).decode("utf-8", "replace") for x in lines])

    common.small_batches(docs.sparkSession)
    src = docs.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({text_col} as string) as text")
    return src.mapInArrow(run, DDL)


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_line_quality``: the counts and the verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("clean_text", "reason")


#: The same rules in DuckDB SQL. RE2 works on code points as the operator does on UTF-8.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, ws[i:i + 2] AS t
        FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
lw AS (SELECT r, i, line, ws, len(ws) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) AS seen
       FROM (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM ln)
       WHERE len(ws) > 0),
lr AS (SELECT r, n, seen > 1 AS dup,
         seen > 1
         OR len(list_filter(ws, lambda x: x IN ('|', '»', '›', '•', '·'))) >= greatest(1, 0.25 * n)
         OR len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.1 * strlen(array_to_string(ws, ''))
         OR (n < 5 AND NOT regexp_matches(ws[-1], '([.!?:;,"'')\]]|…|’|”|»)$'))
         OR len(list_filter(ws, lambda x: x[-2:] = '!!')) >= greatest(1, 0.5 * n)
         OR regexp_matches(line, '(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|sign in to|subscribe to our|lorem ipsum)')
         AS bad FROM lw),
la AS (SELECT r, count(*) AS n_lines, count_if(dup) AS n_dup, count_if(bad) AS n_bad,
              coalesce(sum(n) FILTER (bad), 0) AS n_lost FROM lr GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_lines_removed,
       coalesce(n_lost, 0)::BIGINT AS n_words_removed,
       len(ws) < 50 OR coalesce(n_repeat, 0) > 0.5 * len(ws) AS base_failed,
       NOT (len(ws) < 50 OR coalesce(n_repeat, 0) > 0.5 * len(ws)
            OR coalesce(n_lost, 0) > 0.3 * len(ws)) AS kept
FROM w LEFT JOIN cov USING (r) LEFT JOIN la USING (r)
"""
