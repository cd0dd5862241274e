"""Golden rows (FIXTURES.md part 3): expected values read from the tool's code."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.mapping import is_mapped, mapping_text
from spanloom.functions.spans import overlaps
from spanloom.operators import ingest as I
from spanloom.operators import mapping as MP
from spanloom.operators import metrics as MT
from spanloom.operators import spans as S
from spanloom.operators import views as V
from spanloom.operators import vocab as VC
from spanloom.schema import LABEL_MAP, SPANS, VOCAB
from spanloom.sources.files import default_label_map

# The sample vocabulary shipped with the source tool.
SAMPLE_VOCAB = {
    "品牌": ["联想", "华为", "苹果", "小米", "戴尔"],
    "品类": ["手机", "电脑", "电视", "平板"],
    "型号": ["Mate50", "MacBook Pro", "Y9000", "4S"],
}


def vocab_df(spark, vocab=SAMPLE_VOCAB, project="p"):
    rows = [(project, k, i, t) for k, terms in vocab.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "project string, key string, pos int, term string")


def spans_df(spark, rows):
    """rows: (doc_id, ord, start, end, mapping dict)."""
    data = [("p", d, o, f"t{o}", "L", s, e, m) for d, o, s, e, m in rows]
    return spark.createDataFrame(data, SPANS)


def test_locate(spark):
    rows = [("苹果macbook pro", "macbook"), ("abab", "ab"), ("a😀b华为é", "华为"),
            ("华为mate50手机", "Mate50")]
    df = spark.createDataFrame(rows, "query string, text string")
    out = [(r.found, r.start, r.end) for r in S.locate_first(df).collect()]
    assert out == [(True, 2, 9), (True, 0, 2), (True, 3, 5), (False, 0, 0)]


def test_validate(spark):
    rows = [("abc", "", 0, 1), ("abc", "a", 1, 1), ("abc", "a", 0, 4), ("abc", "a", 0, 3),
            ("abc", "a", None, 2)]
    df = spark.createDataFrame(rows, "query string, text string, start bigint, `end` bigint")
    out = [r.reason for r in S.validate_span(df).collect()]
    assert out == ["empty_text", "start_ge_end", "end_past_text", None, "bad_offset"]


def test_overlap_predicate(spark):
    pairs = [(5, 7), (4, 6), (0, 5), (3, 3), (5, 5)]
    df = spark.createDataFrame(pairs, "s bigint, e bigint")
    out = [r.o for r in df.select(overlaps(F.lit(0), F.lit(5), "s", "e").alias("o")).collect()]
    assert out == [False, True, True, True, False]


def test_greedy_add(spark):
    props = spark.createDataFrame(
        [("p", 1, i, f"x{i}", "L", s, e) for i, (s, e) in enumerate([(0, 5), (3, 8), (5, 7), (6, 9), (8, 9)])],
        "project string, doc_id bigint, seq bigint, text string, label string, start bigint, `end` bigint")
    spans, out = S.add_spans(None, props)
    got = sorted((r.ord, r.start, r.end) for r in spans.collect())
    assert got == [(0, 0, 5), (1, 5, 7), (2, 8, 9)]
    acc = {r.seq: r.accepted for r in out.collect()}
    assert acc == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_greedy_add_respects_existing_and_duplicates(spark):
    existing = spans_df(spark, [(1, 0, 0, 4, {}), (1, 1, 2, 6, {})])  # stored lists may overlap
    props = spark.createDataFrame(
        [("p", 1, 10, "a", "L", 6, 8), ("p", 1, 11, "b", "L", 6, 8), ("p", 1, 12, "c", "L", 5, 7),
         ("p", 1, 13, "d", "L", 8, 8), ("p", 2, 1, "e", "L", 0, 1)],
        "project string, doc_id bigint, seq bigint, text string, label string, start bigint, `end` bigint")
    spans, out = S.add_spans(existing, props)
    got = sorted((r.doc_id, r.ord, r.text) for r in spans.collect())
    assert got == [(1, 0, "t0"), (1, 1, "t1"), (1, 2, "a"), (1, 3, "d"), (2, 0, "e")]
    assert {r.seq: r.accepted for r in out.collect()} == {10: True, 11: False, 12: False,
                                                        13: True, 1: True}


def test_remove_and_update(spark):
    base = spans_df(spark, [(1, 0, 0, 2, {}), (1, 1, 3, 5, {}), (2, 0, 0, 2, {}), (2, 1, 3, 5, {}),
                            (3, 0, 0, 2, {}), (3, 1, 3, 5, {})])
    req = spark.createDataFrame([("p", 1, 0), ("p", 2, 9), ("p", 3, -1)],
                                "project string, doc_id bigint, ord bigint")
    out = sorted((r.doc_id, r.ord, r.start) for r in S.remove_span(base, req).collect())
    assert out == [(1, 0, 3), (2, 0, 0), (2, 1, 3), (3, 0, 0), (3, 1, 3)]
    upd = spark.createDataFrame([("p", 1, 1, "new", "L", 1, 4)],
                                "project string, doc_id bigint, ord bigint, text string, label string, "
                                "start bigint, `end` bigint")
    got = {(r.doc_id, r.ord): (r.text, r.start, r.end) for r in S.update_span(base, upd).collect()}
    assert got[(1, 1)] == ("new", 1, 4)  # overlaps its neighbour, still stored


def test_parse(spark):
    rows = [(0, "[]"), (1, None), (2, "not json"), (3, "[{'text': 'a', 'start': 0, 'end': 1}]"),
            (4, '{"a":1}'), (5, "5"), (6, "null"),
            (7, '[1, {"text":"x","start":"abc","end":1}, {"text":"y","label":"L","start":"2","end":3.0}]'),
            (8, "[] junk")]
    df = spark.createDataFrame([("p", d, a) for d, a in rows],
                               "project string, doc_id bigint, annotations string")
    docs, rej = I.parse_annotations(df)
    n = {r.doc_id: r.n for r in docs.select("doc_id", F.size("anns").alias("n")).collect()}
    assert n == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}
    kept = I.explode_spans(docs).where("doc_id = 7").collect()[0]
    assert (kept.text, kept.start, kept.end) == ("y", 2, 3)
    got = sorted((r.doc_id, r.elem, r.reason) for r in rej.collect())
    assert got == [(2, None, "invalid_json"), (3, None, "invalid_json"), (4, None, "not_array"),
                   (5, None, "not_array"), (6, None, "not_array"), (7, 0, "not_object"),
                   (7, 1, "bad_offset"), (8, None, "invalid_json")]


def test_normalize_mapping(spark):
    rows = [(0, None), (1, '"abc"'), (2, '["a"]'),
            (3, '{"a":"苹果","b":2023,"c":"","d":0,"e":null,"f":["x"],"g":"0","h":false}')]
    df = spark.createDataFrame(rows, "id int, mapped_value string")
    out = {r.id: r.t for r in MP.normalize_mapping(df).select(
        "id", mapping_text("mapped_value").alias("t")).collect()}
    assert out[0] == "" and out[1] == "" and out[2] == ""
    assert out[3] == "a=苹果;b=2023;c=;d=;e=;f=x;g=0;h="


def test_mapped_and_status(spark):
    maps = [{}, {"b": []}, {"b": [], "c": ["x"]}, {"b": [""]}]
    df = spark.createDataFrame([(m,) for m in maps], "m map<string,array<string>>")
    assert [r.x for r in df.select(is_mapped("m").alias("x")).collect()] == [False, False, True, True]

    docs = spark.createDataFrame([("p", 1, "q"), ("p", 2, "q"), ("p", 3, "q")], "project string, doc_id bigint, query string")
    spans = spans_df(spark, [(2, 0, 0, 1, {"a": ["x"]}), (2, 1, 1, 2, {}), (3, 0, 0, 1, {"a": ["y"]}),
                             (9, 0, 0, 1, {"a": ["z"]})])  # doc 9 is a stray store row
    st = {r.doc_id: r.status for r in MT.doc_status(docs, spans).collect()}
    assert st == {1: "not_started", 2: "mapping_incomplete", 3: "done"}
    prog = MT.mapping_progress(docs, spans).collect()[0]
    assert (prog.total_spans, prog.mapped_spans) == (3, 2)
    assert MT.annotated_docs(spans).collect()[0].annotated_rows == 3
    empty = MT.mapping_progress(docs, spans.where("false")).collect()[0]
    assert (empty.total_spans, empty.ratio) == (0, 0.0)


def test_find_mappings(spark):
    mentions = spark.createDataFrame(
        [("p", "m1", "品牌", "联想拯救者"), ("p", "m2", "品牌", "联"), ("p", "m3", "型号", "mate50"),
         ("p", "m4", "颜色", "红"), ("p", "m5", "品类", "")],
        "project string, mention_id string, key string, text string")
    out = VC.find_mappings(mentions, vocab_df(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r.mention_id, []).append((r.pos, r.term, r.matched))
    assert by["m1"] == [(0, "联想", True)] and by["m2"] == [(0, "联想", True)]
    assert sorted(by["m3"]) == [(0, "Mate50", False), (1, "MacBook Pro", False), (2, "Y9000", False),
                                (3, "4S", False)]
    assert "m4" not in by
    assert sorted(t for _, t, m in by["m5"] if m) == sorted(SAMPLE_VOCAB["品类"])


def test_candidates_default_map(spark):
    spans = spark.createDataFrame([("p", 1, 0, "重量"), ("p", 1, 1, "cpu")],
                                  "project string, doc_id bigint, ord bigint, label string")
    lm = default_label_map(spans.select("project"))
    out = MP.candidates(spans, lm, vocab_df(spark)).collect()
    assert [r.category for r in out if r.ord == 0] == [None]
    assert sorted(r.category for r in out if r.ord == 1) == sorted(
        ["cpu_brand", "cpu_series", "cpu_family", "cpu_model", "cpu_gen"])


def test_add_candidates_and_labels(spark):
    v = vocab_df(spark)
    new = spark.createDataFrame([("p", "品牌", "华为", 0), ("p", "品牌", "荣耀", 1), ("p", "品牌", "荣耀", 2),
                                 ("p", "颜色", "红", 3), ("p", "品牌", "", 4)],
                                "project string, key string, term string, seq bigint")
    out = VC.add_candidates(v, new)
    brand = [r.term for r in out.where("key = '品牌'").orderBy("pos").collect()]
    assert brand == SAMPLE_VOCAB["品牌"] + ["荣耀"]
    assert [(r.pos, r.term) for r in out.where("key = '颜色'").collect()] == [(0, "红")]

    labels = spark.createDataFrame([("p", 0, "品牌")], "project string, pos int, label string")
    new_l = spark.createDataFrame([("p", "  ", 0), ("p", "品牌", 1), ("p", " x ", 2)],
                                  "project string, label string, seq bigint")
    reg = [r.label for r in VC.add_labels(labels, new_l).orderBy("pos").collect()]
    assert reg == ["品牌", " x "]


def test_clean_vocab(spark):
    raw = {"a": ["1.0", "2.0", "3.0"], "b": ["0", "0", "a"], "c": ["16.0", "0", "8.0", "x"], "d": ["0.0"]}
    out = VC.clean_vocab(vocab_df(spark, raw)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.key, -1 if r.pos is None else r.pos)):
        if r.term is not None:
            got.setdefault(r.key, []).append(r.term)
    assert got == {"a": ["1", "2", "3"], "b": ["a"], "c": ["x", "16", "8"]}
    assert [r.term for r in out if r.key == "d"] == [None]  # key kept, list empty


def test_segments(spark):
    docs = spark.createDataFrame([("p", 1, "abcdef"), ("p", 2, "abcdef"), ("p", 3, "xyz")],
                                 "project string, doc_id bigint, query string")
    spans = spark.createDataFrame(
        [("p", 1, 0, "b", "L", 1, 2, {}), ("p", 1, 1, "e", "L", 4, 5, {}),
         ("p", 2, 0, "abcd", "L", 0, 4, {}), ("p", 2, 1, "b", "L", 1, 2, {})], SPANS)
    for skew_safe in (None, True):
        seg = V.segments(docs, spans, skew_safe=skew_safe).orderBy("doc_id", "piece").collect()
        by = {}
        for r in seg:
            by.setdefault(r.doc_id, []).append((r.piece, r.kind, r.text))
        assert by[1] == [(0, "gap", "a"), (1, "span", "b"), (2, "gap", "cd"), (3, "span", "e"),
                         (4, "gap", "f")]
        assert by[2] == [(0, "span", "abcd"), (1, "span", "b"), (2, "gap", "cdef")]
        assert by[3] == [(0, "gap", "xyz")]


def test_export_round_trip(spark):
    docs = spark.createDataFrame([("p", 1, "苹果iPhone"), ("p", 2, "none")],
                                 "project string, doc_id bigint, query string")
    spans = spark.createDataFrame(
        [("p", 1, 0, "苹果", "品牌", 0, 2, {"brand": ["苹果"]}), ("p", 1, 1, "iPhone", "型号", 2, 8, {})],
        SPANS)
    exp = V.export_annotations(docs, spans)
    rows = {r.doc_id: r.annotations for r in exp.collect()}
    assert rows[2] == "[]"
    parsed, rej = I.parse_annotations(exp)
    assert rej.count() == 0
    back = sorted(tuple(r) for r in I.explode_spans(parsed).collect())
    assert back == sorted(tuple(r) for r in spans.collect())


def test_candidates_by_label_equal_candidates(spark):
    spans = spark.createDataFrame([("p", d, 0, "t", label, 0, 1, {}) for d, label in
                                   [(1, "x"), (2, "x"), (3, "y"), (4, "none"), (5, None)]], SPANS)
    lm = spark.createDataFrame([("p", "x", 0, "c"), ("p", "x", 1, "d"), ("p", "y", 0, "c")], LABEL_MAP)
    vocab = spark.createDataFrame([("p", "c", 0, "t"), ("p", "c", 1, "u")], VOCAB)
    own, lists = MP.candidates_by_label(spans, lm, vocab)
    assert own.count() == 5 and lists.count() == 7
    joined = own.join(lists, own["project"].eqNullSafe(lists["project"]) & own["label"].eqNullSafe(lists["label"]))
    cols = ["doc_id", "category", "cat_pos", "term", "term_pos"]
    assert sorted(map(str, joined.select(cols).collect())) == sorted(
        map(str, MP.candidates(spans, lm, vocab).select(cols).collect()))
