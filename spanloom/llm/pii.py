"""Personal data: pattern spans, and bootstrapped contextual extraction, in DataFrame operations.

Base spans are regular expressions per kind (email, ip, card, phone) with a
check of each match. Positions come from the lengths of the pieces between
matches, so no row leaves the JVM.

The bootstrap starts from the base spans as seed entities. The nearest word to the
left or right of a seed (a run of letters, up to the next match of the kind) is a lexical pattern for its kind; a pattern needs
``MIN_SEEDS`` different seeds. Candidates are other identifier-like tokens:
letters and digits of ASCII, joined by any of ``_+-`` and single dots, with a
digit, of ``MIN_CANDIDATE`` characters or more. They end on a letter or digit, so
punctuation behind them stays outside. Rounds of two aggregations score the graph
of patterns and instances: a pattern's confidence is the summed score of the
instances it stands beside over the number of times its word occurs in the
whole corpus; an instance's score is the noisy-or of its patterns'. Candidates
that end at ``MIN_SCORE`` or more become spans of the pattern's kind.

One pass over the texts writes the base spans and candidates (a few bytes a
document); a second counts the pattern words, if there are any patterns. The
texts themselves are never shuffled.

Defined results: a null text counts as empty; every input row gives one row
(rows are numbered when the first pass is written, so repeated rows and null ids
stay apart); a candidate that overlaps a base span or an earlier candidate is
not added; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Same matches as the plain forms; guards and possessive loops keep them linear.
PATTERNS = {
    # A run of local characters is tried from its start, or from the end of the match before.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Whole runs of digits with single separators; runs of another length fail the check anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this cannot match.
NEEDS = {"email": "@", "phone": "+"}
_JOINT = r"(?:[_+-]++\.?+|\.)[_+-]*+"
_RUN = r"\p{L}0-9_.+@-"
#: In front of a token, not part of it.
_LEAD = r"(?:[_+]*+[.-]++)*+"
#: One piece of a run of token characters: a token, or else what stands beside an at sign or has
#: other letters. A run with a digit is cut from its start, each piece from the end of the one before.
CANDIDATE = (rf"(?:(?<![{_RUN}])(?=[\p{{L}}_.+@-]*+[0-9])|\G){_LEAD}"
             rf"(?:[_+]*+[A-Za-z0-9]++(?!\p{{L}})(?:{_JOINT}[A-Za-z0-9]++(?!\p{{L}}))*+(?!_*+[@\p{{L}}])"
             rf"|[A-Za-z0-9_.+-]*+@[{_RUN}]*+|[_+]*+[\p{{L}}0-9]++)")
MIN_CANDIDATE = 5
MIN_SEEDS = 3
MIN_SCORE = 0.8
ROUNDS = 3

_SPAN = "array<struct<kind:string,start:int,end:int,value:string,ctx:struct<L:string,R:string>>>"


def no_context() -> Column:
    return F.struct(F.lit("").alias("L"), F.lit("").alias("R")).alias("ctx")


def luhn(digits: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check of one match."""
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(m, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def check(kind: str):
    return lambda span: valid(kind, span["value"])


def is_kind(kind: str):
    return lambda span: span["kind"] == kind


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Every match (that ``keep`` accepts) with its place in code points, as an array of spans.

    ``ctx`` has the nearest word on either side, in the text up to the next match that counts there.
    """
    def added(out: Column, span: Column, m: Column) -> Column:
        more = F.array_append(out, span)
        return more if keep is None else F.when(keep(m), more).otherwise(out)

    def words(piece: Column) -> Column:
        """What a neighbouring match adds to the context: a rejected one is text like any other."""
        return F.lit("") if keep is None else F.when(keep(piece), "").otherwise(piece)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    none = F.array(F.lit(""))
    before = F.zip_with(F.concat(none, found), F.slice(gaps, F.lit(1), n), lambda m, g: F.struct(
        F.length(g).alias("gap"), F.concat(words(m), g).alias("text")))
    after = F.zip_with(F.slice(gaps, F.lit(2), n), F.concat(F.slice(found, F.lit(2), n), none),
                       lambda g, m: F.concat(g, words(m)))
    pairs = F.zip_with(F.slice(before, F.lit(1), n), found, lambda x, m: F.struct(
        x["gap"].alias("gap"), x["text"].alias("before"), m.alias("m")))
    pairs = F.zip_with(pairs, F.slice(after, F.lit(1), n), lambda p, g: F.struct(
        p["gap"].alias("gap"), p["before"].alias("before"), p["m"].alias("m"), g.alias("after")))
    step = F.aggregate(
        pairs, F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["pos"] + x["gap"] + F.length(x["m"])).alias("pos"),
            added(a["out"], F.struct(
                F.lit(kind).alias("kind"), (a["pos"] + x["gap"]).alias("start"),
                (a["pos"] + x["gap"] + F.length(x["m"])).alias("end"),
                x["m"].alias("value"), F.struct(
                    F.lower(F.regexp_extract(x["before"], r"(\p{L}++)\P{L}*+$", 1)).alias("L"),
                    F.lower(F.regexp_extract(x["after"], r"^\P{L}*+(\p{L}++)", 1)).alias("R")).alias("ctx")),
                x["m"]).alias("out")),
        lambda a: a["out"])
    return step


def base_spans(text: Column) -> Column:
    """Checked spans of all kinds."""
    parts = []
    for kind, pattern in PATTERNS.items():
        has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        kept = F.filter(matches(text, pattern, kind), check(kind))
        parts.append(F.when(has, kept).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def candidates(text: Column) -> Column:
    """Identifier-like tokens, as an array of spans without a kind."""
    def trimmed(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], f"^{_LEAD}", 0))
        return F.struct(s["kind"].alias("kind"), (s["start"] + lead).alias("start"), s["end"].alias("end"),
                        s["value"].substr(lead + 1, F.length(s["value"])).alias("value"), s["ctx"].alias("ctx"))

    pieces = matches(text, CANDIDATE, "", lambda m: m.rlike("[0-9]") & ~m.rlike("[^A-Za-z0-9_.+-]"))
    found = F.filter(F.transform(pieces, trimmed), lambda s: F.length(s["value"]) >= MIN_CANDIDATE)
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast(_SPAN))


def ordered(spans: Column) -> Column:
    """Spans by start, then kind in the order of ``KINDS``."""
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    keyed = F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"),
        x["kind"].alias("kind")))
    return F.array_sort(keyed)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written once per input row: rid, doc, text_hash, base, cand (each with its context words)."""
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("base", base_spans(F.col("t")))
    d = d.withColumn("cand", candidates(F.col("t")))
    clear = F.filter("cand", lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return materialize(d.select(
        F.monotonically_increasing_id().alias("rid"), "doc", "text_hash", "base", clear.alias("cand")), "pii-found")


def _edges(found: DataFrame, column: str) -> DataFrame:
    """(kind, value, side, word, n): how often an instance stands beside a pattern word."""
    e = found.select(F.explode(column).alias("s"))
    e = e.select("s.kind", F.col("s.value").alias("value"), F.explode(F.array(
        *[F.struct(F.lit(side).alias("side"), F.col(f"s.ctx.{side}").alias("word"))
          for side in "LR"])).alias("p"))
    return (e.select("kind", "value", "p.side", "p.word").where("word <> ''")
            .groupBy("kind", "value", "side", "word").agg(F.count("*").alias("n")))


def word_totals(docs: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """Occurrences in all texts of the given words (column ``word``), cut as context words are: runs of letters."""
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\P{L}+")
    each = docs.select(F.explode(cut).alias("word")).select(F.lower("word").alias("word"))
    return each.join(common.small(words), "word").groupBy("word").agg(F.count("*").alias("total"))


def discovered(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame | None:
    """(value, kind) of the candidates that the rounds accept; None without any pattern."""
    seed = _edges(found, "base")
    patterns = materialize(seed.groupBy("side", "word", "kind").agg(F.count("*").alias("seeds"))
                           .where(F.col("seeds") >= MIN_SEEDS), "pii-patterns")
    if patterns.isEmpty():
        return None
    words = materialize(patterns.select("word").distinct(), "pii-words")
    total = materialize(word_totals(docs, text_col, words), "pii-totals")
    known = patterns.select("side", "word", "kind").join(total, "word", "left")
    known = known.withColumn("total", F.coalesce("total", F.lit(0)))
    seed = materialize(seed.join(patterns.select("side", "word", "kind"), ["side", "word", "kind"]),
                       "pii-seeds")
    cand = _edges(found, "cand").drop("kind")
    cand = materialize(cand.join(known.select("side", "word").distinct(), ["side", "word"]),
                       "pii-candidates")
    seeds = seed.groupBy("side", "word", "kind").agg(F.sum("n").cast("double").alias("mass"))
    scores = None
    for _ in range(ROUNDS):
        mass = seeds
        if scores is not None:
            mass = mass.unionByName(cand.join(scores, "value").groupBy("side", "word", "kind").agg(
                F.sum(F.col("n") * F.col("score")).alias("mass")))
        conf = mass.groupBy("side", "word", "kind").agg(F.sum("mass").alias("mass"))
        conf = conf.join(known, ["side", "word", "kind"]).select(
            "side", "word", "kind",
            F.least(F.col("mass") / F.greatest(F.col("total"), F.lit(1)), F.lit(0.99)).alias("conf"))
        scores = materialize(
            cand.join(conf, ["side", "word"]).groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")), "pii-scores")
    best = scores.where(F.col("score") >= MIN_SCORE).groupBy("value").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))
    return materialize(best.select("value", "b.kind"), "pii-discovered")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc, text_hash, base and spans (both ordered: start, rank, end, kind)."""
    found = first_pass(docs, id_col, text_col)
    values = discovered(docs, found, text_col)
    base = found.select("rid", "doc", "text_hash", ordered(F.col("base")).alias("base"))
    if values is None:
        return base.withColumn("spans", F.col("base"))
    more = (found.select("rid", F.explode("cand").alias("c"))
            .select("rid", "c.start", "c.end", F.col("c.value").alias("value"))
            .join(common.small(values), "value").groupBy("rid").agg(
                F.collect_list(F.struct("kind", "start", "end", "value", no_context())).alias("more")))
    out = base.join(more, "rid", "left")
    both = F.concat(
        F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                               x["end"].alias("end"), F.lit("").alias("value"), no_context())),
        F.coalesce(F.col("more"), F.array().cast(_SPAN)))
    return out.select("rid", "doc", "text_hash", "base", ordered(both).alias("spans"))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts per kind, base_sha256, spans and n_added of every input row."""
    out = find(docs, id_col, text_col)
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}")
              for k in KINDS]
    return out.select(
        F.col("doc").alias("doc_id"), *counts,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; in the text every span is replaced by its kind in angle brackets."""
    spans = find(docs, id_col, text_col).where(F.size("spans") > 0)
    spans = materialize(spans.groupBy("doc", "text_hash").agg(F.first("spans").alias("_spans")),
                        "pii-spans")
    spans = common.small(spans.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"}))
    # The row as one value: no column of it can clash with the spans'.
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    d = row.join(spans, F.col("_row").getField(id_col).eqNullSafe(spans["_doc"])
                 & (F.xxhash64(F.col("_row").getField(text_col)) == spans["_hash"]), "left")
    t = F.col("_row").getField(text_col)
    done = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["pos"], x["end"]).alias("pos"),
            F.when(x["start"] < a["pos"], a["out"]).otherwise(F.concat(
                a["out"], t.substr(a["pos"] + 1, x["start"] - a["pos"]),
                F.lit("<"), F.upper(x["kind"]), F.lit(">"))).alias("out")),
        lambda a: F.concat(a["out"], t.substr(a["pos"] + 1, F.length(t))))
    masked = F.when(F.col("_spans").isNull(), t).otherwise(done)
    return d.select(*[masked.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_pii``: spans of every document."""
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
