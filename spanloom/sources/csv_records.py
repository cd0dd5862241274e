"""CSV records that may span lines, read by all tasks: quote parity instead of one task per file.

A line break lies inside a quoted field exactly if an odd number of quotes precedes it in
its file. Each split's lines are therefore read as text, and the task that reads a split notes
beside each line its number in the split, the parity of the quotes before it and the even ones so far;
a summary with one row per split carries the parity (and the number of records begun) from split to split.
A line is the start of a record if the parity before it is even. A second pass over the noted lines,
again in their order, joins the lines of a record; only the pieces of records that reach over
the end of what a task reads are put together by a shuffle. Nothing is sorted, so a task holds an
Arrow batch and the record it is in, whatever the size of the files. Each record is then
parsed on its own.

Quotes follow RFC 4180: a field with a quote, comma or line break is quoted, a quote in it
doubled. Line ends are ``\\n`` or ``\\r\\n``; blank lines are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spanloom.session import materialize

#: Options under which one record is parsed; the same as those of a whole file.
PARSE = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true",
         "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: Rows of an Arrow batch of lines at most.
BATCH_ROWS = 1000
NOTED = "file string, split bigint, at bigint, line string, quotes bigint, odd bigint, even bigint"
JOINED = "file string, record bigint, split bigint, at bigint, text string, whole boolean, open boolean"


def _joined() -> pa.Schema:
    return pa.schema([("file", pa.string()), ("record", pa.int64()), ("split", pa.int64()), ("at", pa.int64()),
                      ("text", pa.string()), ("whole", pa.bool_()), ("open", pa.bool_())])


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of lines, which may be long, hold at most ``BATCH_ROWS`` in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _pieces(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Where the values of some columns change inside a batch: the starts of its runs, and its length."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for name in names:
        c = batch.column(name)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order read -> with their number in the split, the parity before them, the even lines so far."""
    of, at, odd, even = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        quotes = batch.column("quotes").to_numpy()
        noted = [np.empty(len(quotes), dtype=np.int64) for _ in range(3)]
        cuts = _pieces(batch, ("file", "split"))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (batch.column("file")[a].as_py(), batch.column("split")[a].as_py())
            if key != of:
                of, at, odd, even = key, 0, 0, 0
            total = odd + np.cumsum(quotes[a:b])
            noted[0][a:b] = at + np.arange(b - a)
            noted[1][a:b] = (total - quotes[a:b]) % 2
            noted[2][a:b] = even + np.cumsum(noted[1][a:b] == 0)
            at, odd, even = at + int(b - a), int(total[-1]) % 2, int(noted[2][b - 1])
        yield pa.RecordBatch.from_pydict({
            "file": batch.column("file"), "split": batch.column("split"), "at": noted[0],
            "line": batch.column("line"), "quotes": batch.column("quotes"), "odd": noted[1], "even": noted[2]})


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Noted lines in their order -> records; ``whole`` if both ends were seen here, else a piece of one.

    An open record is its first line's row, without text.
    """
    held: list[str] = []  # lines of the record the last batch ended in
    head: dict = {}
    last = None  # file, split, place of the last line

    def flush(whole: bool) -> pa.RecordBatch:
        out = {k: [v] for k, v in head.items() if k != "start"}
        out |= {"text": ["\n".join(held)], "whole": [whole and head["start"]], "open": [False]}
        held.clear()
        return pa.RecordBatch.from_pydict({k: out[k] for k in _joined().names}, schema=_joined())

    for batch in batches:
        if not batch.num_rows:
            continue
        at, start = batch.column("at").to_numpy(), batch.column("start").to_numpy(zero_copy_only=False)
        is_open = batch.column("open").to_numpy(zero_copy_only=False)
        of = [batch.column(c) for c in ("file", "split")]
        new = np.zeros(len(at), dtype=bool)  # does not follow on the line before
        new[_pieces(batch, ("file", "split"))[:-1]] = True
        new[1:] |= np.diff(at) != 1
        new[0] = last != (of[0][0].as_py(), of[1][0].as_py(), int(at[0]) - 1)
        last = (of[0][-1].as_py(), of[1][-1].as_py(), int(at[-1]))
        cuts = np.append(np.flatnonzero(new | start), len(at))
        if cuts[0] > 0 and held:  # the batch begins inside the held record; else inside an open one
            held += batch.column("line")[:cuts[0]].to_pylist()
        if len(cuts) > 1 and held:
            yield flush(bool(start[cuts[0]] and not new[cuts[0]]))
        begin, end = cuts[:-1], cuts[1:]
        if not len(begin):
            continue
        # The last record may go on in the next batch; all others end here.
        follows = np.append(start[end[:-1]] & ~new[end[:-1]], False)
        opened = is_open[begin]
        done = ~opened
        done[-1] = False
        keep = np.flatnonzero(done)
        if len(keep):
            size = end[keep] - begin[keep]
            index = np.repeat(begin[keep] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            parts = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(size))),
                                                  batch.column("line").cast(pa.large_string()).take(index))
            first = batch.take(begin[keep])
            yield pa.RecordBatch.from_pydict({
                "file": first.column("file"), "record": first.column("record"), "split": first.column("split"),
                "at": first.column("at"), "text": pc.binary_join(parts, pa.scalar("\n", pa.large_string())).cast(pa.string()),
                "whole": start[begin[keep]] & follows[keep], "open": np.zeros(len(keep), dtype=bool)}, schema=_joined())
        marks = begin[opened & start[begin]]
        if len(marks):
            first = batch.take(marks)
            yield pa.RecordBatch.from_pydict({
                "file": first.column("file"), "record": first.column("record"), "split": first.column("split"),
                "at": first.column("at"), "text": [None] * len(marks), "whole": np.zeros(len(marks), dtype=bool),
                "open": np.ones(len(marks), dtype=bool)}, schema=_joined())
        if not opened[-1]:
            held = batch.column("line")[begin[-1]:].to_pylist()
            head = batch.slice(begin[-1], 1).select(["file", "record", "split", "at", "start"]).to_pylist()[0]
    if held:
        yield flush(False)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (0-based in its file), text, open: the last record of a file whose quote never closes.

    An open record has no text: it runs to the end of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    small_batches(spark)
    # Written once: the summary and the lines must see the same splits.
    lines = materialize(lines.withColumn("quotes", quotes.cast("bigint")).mapInArrow(_note, NOTED), "csv-lines")
    by_split = lines.groupBy("file", "split").agg(
        F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.count("*").alias("lines"))
    order = Window.partitionBy("file").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    by_split = by_split.withColumn("carry", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("carry") == 0, F.col("even")).otherwise(F.col("lines") - F.col("even"))
    by_split = by_split.withColumn("starts", starts)
    by_split = by_split.select(
        "file", "split", "carry", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("first"),
        F.sum("quotes").over(Window.partitionBy("file")).alias("all"),
        F.sum("starts").over(Window.partitionBy("file")).alias("n"))
    begun = F.when(F.col("carry") == 0, F.col("even")).otherwise(F.col("at") + 1 - F.col("even"))
    # One row per split, broadcast: the lines must keep their order.
    rows = lines.join(F.broadcast(by_split), ["file", "split"]).withColumn("record", F.col("first") + begun - 1)
    start = F.col("odd") == F.col("carry")
    open_ = (F.col("all") % 2 == 1) & (F.col("record") == F.col("n") - 1)
    rows = rows.select("file", "split", "at", "line", "record", start.alias("start"), open_.alias("open"))
    found = materialize(rows.mapInArrow(_join_lines, JOINED), "csv-joined")
    one = found.where("whole or open").select("file", "record", "text", "open")
    long = found.where("not (whole or open)").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "at", "text"))).alias("parts"))
    long = long.select("file", "record", F.array_join("parts.text", "\n").alias("text"), F.lit(False).alias("open"))
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r$", "")
    return one.unionByName(long).withColumn(
        "text", F.when(F.col("record") == 0, text).otherwise(F.regexp_replace("text", "\r$", "")))


def header(spark: SparkSession, text: str) -> list[str]:
    """The column names in a header; an empty one is ``_c<place>``, a repeated one gets its place."""
    n = spark.range(1).select(F.lit(text).alias("t")).select(fields("t")).first()[0]
    ddl = ", ".join(f"_c{k} string" for k in range(n))
    row = spark.range(1).select(F.from_csv(F.lit(text), ddl, PARSE).alias("r")).select("r.*").first()
    names = [v or f"_c{k}" for k, v in enumerate(row)]
    low = [x.lower() for x in names]
    return [f"{x}{k}" if low.count(x.lower()) > 1 else x for k, x in enumerate(names)]


def fields(text: str) -> Column:
    """The number of fields of a record with closed quotes."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): every column as text, with ``_file`` and ``_record`` for the order; file, record, reason.

    The first record of each file is its header; files with other columns are an error. A record with too
    few fields is filled with nulls; one with too many (``field_count``) or an open quote (``open_quote``) is a
    reject.
    """
    found = materialize(records(spark, path), "csv-records")
    heads = [r["text"] for r in found.where("record = 0 and not open").select("text").distinct().limit(2).collect()]
    if not heads:
        raise ValueError(f"{path} has no header")
    if len(heads) > 1:
        raise ValueError(f"the files of {path} have different headers")
    names = header(spark, heads[0])
    schema = StructType([StructField(n, StringType()) for n in names])
    body = found.where((F.col("record") > 0) & (F.col("open") | (F.col("text") != "")))
    reason = F.when(F.col("open"), "open_quote").when(fields("text") > len(names), "field_count")
    body = body.withColumn("_reason", reason)
    parsed = F.from_csv("text", schema.toDDL(), PARSE)
    rows = body.where("_reason is null").select(F.col("file").alias("_file"), F.col("record").alias("_record"), parsed.alias("_r"))
    rows = rows.select(*[F.col("_r").getField(n).alias(n) for n in names], "_file", "_record")
    return rows, body.where("_reason is not null").select("file", "record", F.col("_reason").alias("reason"))
