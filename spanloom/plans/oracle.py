"""DuckDB SQL equivalents of the catalog queries, written from the rules.

Tables are the driver's views (part, events, documents, ...). Each query
re-derives its working tables from them with plain SQL; order-dependent
folds use ``list_reduce``.
"""

from __future__ import annotations

SHORT = """short AS (
  SELECT p_type AS project, p_partkey AS doc_id, p_name AS query, p_size FROM part)"""

VOC = """voc AS (
  SELECT project, key, CAST(row_number() OVER (PARTITION BY project, key ORDER BY term) - 1 AS BIGINT) AS pos, term
  FROM (SELECT DISTINCT project, key, term FROM (
      SELECT p_type AS project, 'modifier' AS key, split_part(p_name, ' ', 1) AS term FROM part
      UNION ALL SELECT p_type, 'item', split_part(p_name, ' ', 2) FROM part
      UNION ALL SELECT p_type, 'brand', p_brand FROM part
      UNION ALL SELECT p_type, 'type', p_type FROM part) u WHERE term IS NOT NULL) d)"""

LM = """lm AS (
  SELECT p.project, x.label, CAST(x.pos AS BIGINT) AS pos, x.category
  FROM (SELECT DISTINCT p_type AS project FROM part) p
  CROSS JOIN (VALUES ('MOD', 0, 'modifier'), ('ITEM', 0, 'item'), ('BRAND', 0, 'brand'),
                     ('MULTI', 0, 'brand'), ('MULTI', 1, 'type')) x(label, pos, category))"""

LABELS = """labels0 AS (
  SELECT p.project, CAST(x.pos AS BIGINT) AS pos, x.label
  FROM (SELECT DISTINCT p_type AS project FROM part) p
  CROSS JOIN (VALUES (0, 'MOD'), (1, 'ITEM'), (2, 'BRAND'), (3, 'MULTI'), (4, 'NONE')) x(pos, label))"""

ANN = SHORT + """,
ann0 AS (
  SELECT s.project, s.doc_id, s.query, s.p_size, CAST(w.ord AS BIGINT) AS ord, w.label, w.key,
         split_part(s.query, ' ', w.part_no) AS text
  FROM short s CROSS JOIN (VALUES (0, 'MOD', 'modifier', 1), (1, 'ITEM', 'item', 2)) w(ord, label, key, part_no)
  WHERE s.p_size % 7 <> 0),
annp AS (
  SELECT project, doc_id, query, p_size, ord, label, key, text,
         CAST(strpos(query, text) - 1 AS BIGINT) AS start_pos,
         CAST(strpos(query, text) - 1 + length(text) AS BIGINT) AS end_pos,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE key || '=' || text END AS mapping,
         CASE WHEN p_size % 3 = 0 THEN []::STRUCT(k VARCHAR, v VARCHAR[])[]
              ELSE [struct_pack(k := key, v := [text])] END AS m
  FROM ann0)"""

EVENTS = """ev AS (
  SELECT 'events' AS project, user_id AS doc_id, event_id AS seq,
         CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'purchase' THEN 'update'
              WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' THEN 'set_mapping' END AS op,
         k % 5 AS ord, 'w' || CAST(k AS VARCHAR) AS text, 'L' || CAST(k % 3 AS VARCHAR) AS label,
         CAST(floor(value) AS BIGINT) AS start_pos, CAST(floor(value) AS BIGINT) + 1 + k % 20 AS end_pos,
         'c' || CAST(k % 4 AS VARCHAR) AS category,
         CASE WHEN k % 10 = 0 THEN []::VARCHAR[] ELSE ['v' || CAST(k % 7 AS VARCHAR)] END AS vals
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e)"""

CORPUS = """words AS (
  SELECT DISTINCT w AS term FROM (
    SELECT unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS w FROM benchmark) t
  WHERE length(w) > 0),
cv AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS pos FROM words)"""


def mtext(m: str) -> str:
    """Canonical mapping text of a list of (k, v) structs (keys sorted)."""
    return (f"array_to_string(list_transform(list_sort({m}), "
            f"lambda kv: kv.k || '=' || array_to_string(kv.v, '|')), ';')")


def fold(props: str, struct_type: str) -> str:
    """Greedy first-wins add over an ordered list of spans with fields s, e."""
    return (f"list_reduce({props}, lambda acc, x: CASE WHEN len(list_filter(acc, "
            f"lambda a: NOT (x.e <= a.s OR x.s >= a.e))) > 0 THEN acc ELSE list_append(acc, x) END, "
            f"[]::{struct_type}[])")


CANDIDATES = """, c AS (
  SELECT s.*, CAST(w.i AS BIGINT) AS i,
         CASE w.i WHEN 0 THEN split_part(query, ' ', 1) WHEN 1 THEN split_part(query, ' ', 2)
                  WHEN 2 THEN upper(split_part(query, ' ', 1)) ELSE '' END AS text
  FROM short s CROSS JOIN (VALUES (0), (1), (2), (3)) w(i)),
f AS (SELECT *, coalesce(text <> '' AND contains(query, text), false) AS found FROM c),
l AS (
  SELECT *, CAST(CASE WHEN found THEN strpos(query, text) - 1 ELSE p_size % 5 END AS BIGINT) AS start_pos,
         CAST(CASE WHEN found THEN strpos(query, text) - 1 + length(text) ELSE p_size % 40 END AS BIGINT) AS end_pos
  FROM f)"""

REPLAY = EVENTS + """,
g AS (
  SELECT project, doc_id, list(struct_pack(seq := seq, op := op, ord := ord, text := text, label := label,
         s := start_pos, e := end_pos, cat := category, vals := vals) ORDER BY seq) AS ops
  FROM ev GROUP BY project, doc_id),
r AS (
  SELECT project, doc_id, list_reduce(ops, lambda st, x:
    CASE
      WHEN x.op = 'add' THEN
        CASE WHEN len(list_filter(st.anns, lambda a: NOT (x.e <= a.s OR x.s >= a.e))) > 0
          THEN struct_pack(anns := st.anns,
                 outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'overlap')))
          ELSE struct_pack(
                 anns := list_append(st.anns, struct_pack(text := x.text, label := x.label, s := x.s, e := x.e,
                                                          m := []::STRUCT(k VARCHAR, v VARCHAR[])[])),
                 outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'accepted')))
        END
      WHEN x.ord < 0 OR x.ord >= len(st.anns) THEN
        struct_pack(anns := st.anns,
                    outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'out_of_range')))
      WHEN x.op = 'remove' THEN
        struct_pack(anns := list_filter(st.anns, lambda a, i: i <> x.ord + 1),
                    outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'accepted')))
      WHEN x.op = 'update' THEN
        struct_pack(anns := list_transform(st.anns, lambda a, i: CASE WHEN i = x.ord + 1 THEN
                      struct_pack(text := x.text, label := x.label, s := x.s, e := x.e,
                                  m := []::STRUCT(k VARCHAR, v VARCHAR[])[]) ELSE a END),
                    outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'accepted')))
      ELSE
        CASE WHEN coalesce(list_filter(st.anns[x.ord + 1].m, lambda kv: kv.k = x.cat)[1].v, []::VARCHAR[]) = x.vals
          THEN struct_pack(anns := st.anns,
                 outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'unchanged')))
          ELSE struct_pack(
                 anns := list_transform(st.anns, lambda a, i: CASE WHEN i = x.ord + 1 THEN
                   struct_pack(text := a.text, label := a.label, s := a.s, e := a.e,
                     m := CASE WHEN len(list_filter(a.m, lambda kv: kv.k = x.cat)) > 0
                               THEN list_transform(a.m, lambda kv: CASE WHEN kv.k = x.cat
                                      THEN struct_pack(k := kv.k, v := x.vals) ELSE kv END)
                               ELSE list_append(a.m, struct_pack(k := x.cat, v := x.vals)) END)
                   ELSE a END),
                 outs := list_append(st.outs, struct_pack(seq := x.seq, op := x.op, ord := x.ord, o := 'accepted')))
        END
    END,
    struct_pack(anns := []::STRUCT(text VARCHAR, label VARCHAR, s BIGINT, e BIGINT, m STRUCT(k VARCHAR, v VARCHAR[])[])[],
                outs := []::STRUCT(seq BIGINT, op VARCHAR, ord BIGINT, o VARCHAR)[])) AS st
  FROM g),
state AS (
  SELECT project, doc_id, CAST(generate_subscripts(st.anns, 1) - 1 AS BIGINT) AS ord, unnest(st.anns) AS a FROM r)"""

REPLAY_STATE_SELECT = f"""SELECT project, doc_id, ord, a.text AS text, a.label AS label, a.s AS start_pos,
       a.e AS end_pos, {mtext('a.m')} AS mapping FROM state"""

SET_MAPPING = ANN + """,
req AS (
  SELECT project, doc_id, doc_id % 3 AS rord,
         CASE WHEN doc_id % 2 = 0 THEN 'modifier' ELSE 'extra' END AS cat,
         CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] ELSE ['x' || CAST(doc_id % 4 AS VARCHAR)] END AS vals
  FROM short),
sm AS (
  SELECT a.project, a.doc_id, a.ord, a.text, a.label, a.start_pos, a.end_pos,
         CASE WHEN r.rord IS NULL OR r.rord <> a.ord THEN a.m
              WHEN len(list_filter(a.m, lambda kv: kv.k = r.cat)) > 0
                THEN list_transform(a.m, lambda kv: CASE WHEN kv.k = r.cat THEN struct_pack(k := kv.k, v := r.vals) ELSE kv END)
              WHEN len(r.vals) > 0 THEN list_append(a.m, struct_pack(k := r.cat, v := r.vals))
              ELSE a.m END AS m2
  FROM annp a LEFT JOIN req r ON a.project = r.project AND a.doc_id = r.doc_id)"""

CLEAN_RAW = """raw AS (
  SELECT p_type AS project, 'size' AS key, p_partkey AS pos, CAST(p_size AS VARCHAR) || '.0' AS term FROM part
  UNION ALL SELECT p_type, 'sizeint', p_partkey, CAST(p_size % 10 AS VARCHAR) FROM part
  UNION ALL SELECT 'orders', 'cust', o_orderkey,
                   CAST(o_custkey % 7 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN '.0' ELSE '' END FROM orders)"""

ADDED_LABELS = LABELS + """,
newl AS (
  SELECT p_type AS project,
         CASE p_size % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'MOD'
              WHEN 2 THEN ' ' || upper(split_part(p_name, ' ', 2)) || ' ' ELSE split_part(p_name, ' ', 1) END AS label,
         p_partkey AS seq FROM part),
freshl AS (
  SELECT project, label, min(seq) AS seq FROM newl
  WHERE label IS NOT NULL AND trim(label) <> '' GROUP BY project, label),
freshl2 AS (SELECT * FROM freshl f WHERE NOT EXISTS (
  SELECT 1 FROM labels0 l WHERE l.project = f.project AND l.label = f.label)),
basel AS (SELECT project, max(pos) AS mx FROM labels0 GROUP BY project),
labels1 AS (
  SELECT project, pos, label FROM labels0
  UNION ALL
  SELECT f.project, CAST(coalesce(b.mx + 1, 0) + row_number() OVER (PARTITION BY f.project ORDER BY f.seq) - 1 AS BIGINT),
         f.label
  FROM freshl2 f LEFT JOIN basel b ON f.project = b.project)"""

EXPORT_JSON = """'[' || coalesce(string_agg('{"text":"' || a.text || '","label":"' || a.label || '","start":' ||
   CAST(a.start_pos AS VARCHAR) || ',"end":' || CAST(a.end_pos AS VARCHAR) || ',"mapped_value":' ||
   CASE WHEN a.p_size % 3 = 0 THEN '{}' ELSE '{"' || a.key || '":["' || a.text || '"]}' END || '}',
   ',' ORDER BY a.ord), '') || ']'"""

STATUS = ANN + """,
per AS (SELECT project, doc_id, count(*) AS n, count(*) FILTER (WHERE mapping <> '') AS m FROM annp GROUP BY ALL),
st AS (
  SELECT s.project, s.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_spans, CAST(coalesce(p.m, 0) AS BIGINT) AS n_mapped,
         CASE WHEN coalesce(p.n, 0) = 0 THEN 'not_started' WHEN p.m = p.n THEN 'done'
              ELSE 'mapping_incomplete' END AS status
  FROM short s LEFT JOIN per p ON s.project = p.project AND s.doc_id = p.doc_id)"""

SPANS_SELECT = "SELECT project, doc_id, ord, text, label, start_pos, end_pos, mapping FROM annp"

ORACLE: dict[str, str] = {
    "locate_first": f"""WITH {SHORT}{CANDIDATES}
SELECT project, doc_id, i, text, found,
       CAST(CASE WHEN found THEN strpos(query, text) - 1 ELSE 0 END AS BIGINT) AS start_pos,
       CAST(CASE WHEN found THEN strpos(query, text) - 1 + length(text) ELSE 0 END AS BIGINT) AS end_pos
FROM f""",
    "validate_span": f"""WITH {SHORT}{CANDIDATES},
v AS (SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'empty_text'
                     WHEN start_pos < 0 OR end_pos < 0 THEN 'bad_offset'
                     WHEN start_pos >= end_pos THEN 'start_ge_end'
                     WHEN end_pos > length(query) THEN 'end_past_text' END AS reason FROM l)
SELECT project, doc_id, i, start_pos, end_pos, reason, reason IS NULL AS valid FROM v""",
    "span_slice": f"""WITH {SHORT}{CANDIDATES},
v AS (SELECT *, CASE WHEN start_pos >= 0 AND start_pos < end_pos AND end_pos <= length(query)
                     THEN substring(query, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT)) END AS slice FROM l)
SELECT project, doc_id, i, text, slice, coalesce(slice = text, false) AS slice_matches FROM v""",
    "overlap_pairs": f"""WITH {EVENTS},
adds AS (SELECT project, doc_id, CAST(row_number() OVER (PARTITION BY project, doc_id ORDER BY seq) - 1 AS BIGINT) AS ord,
                start_pos, end_pos FROM ev WHERE op = 'add')
SELECT a.project, a.doc_id, a.ord AS ord_a, b.ord AS ord_b, a.start_pos AS start_a, a.end_pos AS end_a,
       b.start_pos AS start_b, b.end_pos AS end_b
FROM adds a JOIN adds b ON a.project = b.project AND a.doc_id = b.doc_id AND a.ord < b.ord
 AND NOT (b.end_pos <= a.start_pos OR b.start_pos >= a.end_pos)""",
}

_ADD_FOLD = f"""WITH {EVENTS},
g AS (SELECT project, doc_id, list(struct_pack(seq := seq, s := start_pos, e := end_pos, text := text, label := label)
             ORDER BY seq) AS props FROM ev WHERE op = 'add' GROUP BY project, doc_id),
f AS (SELECT project, doc_id, {fold('props', 'STRUCT(seq BIGINT, s BIGINT, e BIGINT, text VARCHAR, label VARCHAR)')} AS acc FROM g),
k AS (SELECT project, doc_id, CAST(generate_subscripts(acc, 1) - 1 AS BIGINT) AS ord, unnest(acc) AS a FROM f)"""

ORACLE["add_spans"] = _ADD_FOLD + """
SELECT project, doc_id, ord, a.text AS text, a.label AS label, a.s AS start_pos, a.e AS end_pos FROM k"""
ORACLE["add_spans_outcomes"] = _ADD_FOLD + """
SELECT e.project, e.doc_id, e.seq, k.ord IS NOT NULL AS accepted,
       CASE WHEN k.ord IS NULL THEN 'overlap' END AS reason
FROM ev e LEFT JOIN k ON e.project = k.project AND e.doc_id = k.doc_id AND e.seq = k.a.seq
WHERE e.op = 'add'"""
ORACLE["replay_edits"] = f"WITH {REPLAY}\n{REPLAY_STATE_SELECT}"
ORACLE["replay_outcomes"] = f"""WITH {REPLAY},
o AS (SELECT project, doc_id, unnest(st.outs) AS x FROM r)
SELECT project, doc_id, x.seq AS seq, x.op AS op, x.ord AS ord, x.o AS outcome FROM o"""
ORACLE["replay_edits_stream"] = ORACLE["replay_edits"]
ORACLE["progress_stream"] = f"""WITH {REPLAY},
agg AS (SELECT project, count(*) AS t,
               count(*) FILTER (WHERE len(list_filter(a.m, lambda kv: len(kv.v) > 0)) > 0) AS m FROM state GROUP BY project)
SELECT project, CAST(t AS BIGINT) AS total_spans, CAST(m AS BIGINT) AS mapped_spans,
       CASE WHEN t = 0 THEN 0.0 ELSE CAST(m AS DOUBLE) / t END AS ratio FROM agg"""

ORACLE["remove_span"] = f"""WITH {ANN},
req AS (SELECT project, doc_id, doc_id % 3 AS del FROM short)
SELECT a.project, a.doc_id, CASE WHEN a.ord > r.del THEN a.ord - 1 ELSE a.ord END AS ord, a.text, a.label,
       a.start_pos, a.end_pos, a.mapping
FROM annp a LEFT JOIN req r ON a.project = r.project AND a.doc_id = r.doc_id
WHERE r.del IS NULL OR a.ord <> r.del"""
ORACLE["update_span"] = f"""WITH {ANN}
SELECT a.project, a.doc_id, a.ord,
       CASE WHEN a.ord = a.doc_id % 3 THEN upper(a.query) ELSE a.text END AS text,
       CASE WHEN a.ord = a.doc_id % 3 THEN 'UPD' ELSE a.label END AS label,
       CASE WHEN a.ord = a.doc_id % 3 THEN 0 ELSE a.start_pos END AS start_pos,
       CASE WHEN a.ord = a.doc_id % 3 THEN CAST(length(a.query) AS BIGINT) ELSE a.end_pos END AS end_pos,
       CASE WHEN a.ord = a.doc_id % 3 THEN '' ELSE a.mapping END AS mapping
FROM annp a"""
ORACLE["set_mapping"] = f"""WITH {SET_MAPPING}
SELECT project, doc_id, ord, text, label, start_pos, end_pos, {mtext('m2')} AS mapping FROM sm"""
ORACLE["orphan_mappings"] = f"""WITH {SET_MAPPING}, {VOC},
kv AS (SELECT project, doc_id, ord, unnest(m2) AS e FROM sm),
vals AS (SELECT project, doc_id, ord, e.k AS category, CAST(generate_subscripts(e.v, 1) - 1 AS BIGINT) AS vpos,
                unnest(e.v) AS value FROM kv)
SELECT * FROM vals x WHERE NOT EXISTS (
  SELECT 1 FROM voc v WHERE v.project = x.project AND v.key = x.category AND v.term = x.value)"""

ORACLE["annotate_with_vocab"] = f"""WITH {CORPUS},
hits AS (SELECT d.source AS project, d.doc_id, cv.term, cv.pos, CAST(strpos(d.text, cv.term) - 1 AS BIGINT) AS s
         FROM documents d JOIN cv ON contains(d.text, cv.term)),
g AS (SELECT project, doc_id, list(struct_pack(s := s, e := s + length(term), text := term)
             ORDER BY s, length(term) DESC, pos) AS props FROM hits GROUP BY project, doc_id),
f AS (SELECT project, doc_id, {fold('props', 'STRUCT(s BIGINT, e BIGINT, text VARCHAR)')} AS acc FROM g),
k AS (SELECT project, doc_id, CAST(generate_subscripts(acc, 1) - 1 AS BIGINT) AS ord, unnest(acc) AS a FROM f)
SELECT project, doc_id, ord, a.text AS text, 'word' AS label, a.s AS start_pos, a.e AS end_pos FROM k"""
ORACLE["annotate_short"] = f"""WITH {SHORT}, {VOC}, {LM},
hits AS (SELECT s.project, s.doc_id, v.key, v.pos, v.term, CAST(strpos(s.query, v.term) - 1 AS BIGINT) AS st
         FROM short s JOIN voc v ON s.project = v.project AND contains(s.query, v.term) WHERE v.term <> ''),
lab AS (SELECT h.*, l.label FROM hits h JOIN lm l ON h.project = l.project AND h.key = l.category),
g AS (SELECT project, doc_id, list(struct_pack(s := st, e := st + length(term), text := term, label := label)
             ORDER BY st, length(term) DESC, label, pos, key) AS props FROM lab GROUP BY project, doc_id),
f AS (SELECT project, doc_id, {fold('props', 'STRUCT(s BIGINT, e BIGINT, text VARCHAR, label VARCHAR)')} AS acc FROM g),
k AS (SELECT project, doc_id, CAST(generate_subscripts(acc, 1) - 1 AS BIGINT) AS ord, unnest(acc) AS a FROM f)
SELECT project, doc_id, ord, a.text AS text, a.label AS label, a.s AS start_pos, a.e AS end_pos FROM k"""
ORACLE["containment_hits"] = f"""WITH {CORPUS}
SELECT d.source AS project, d.doc_id, cv.pos, cv.term, CAST(strpos(d.text, cv.term) - 1 AS BIGINT) AS start_pos
FROM documents d JOIN cv ON contains(d.text, cv.term)"""

ORACLE["explode_spans"] = f"WITH {ANN}\n{SPANS_SELECT}"
ORACLE["read_annotation_store"] = ORACLE["explode_spans"]
ORACLE["ingest_project"] = f"""WITH {ANN}
SELECT 'short' AS project, doc_id, ord, text, label, start_pos, end_pos, mapping FROM annp"""
ORACLE["get_annotations"] = f"""WITH {ANN}
SELECT s.project, s.doc_id, CAST(count(a.ord) AS BIGINT) AS n_spans,
       coalesce(string_agg(a.text, ',' ORDER BY a.ord), '') AS texts
FROM short s LEFT JOIN annp a ON s.project = a.project AND s.doc_id = a.doc_id GROUP BY s.project, s.doc_id"""
ORACLE["init_annotations"] = f"WITH {SHORT}\nSELECT project, doc_id, CAST(0 AS BIGINT) AS n_spans FROM short"
ORACLE["parse_annotations"] = f"""WITH {ANN}
SELECT project, doc_id, CASE WHEN doc_id % 11 = 7 THEN ord - 1 ELSE ord END AS ord, text, label,
       start_pos, end_pos, mapping
FROM annp WHERE doc_id % 11 IN (6, 9, 10) OR (doc_id % 11 = 7 AND ord > 0)"""
ORACLE["annotation_rejects"] = f"""WITH {ANN},
n AS (SELECT s.project, s.doc_id, s.doc_id % 11 AS r, count(a.ord) AS n
      FROM short s LEFT JOIN annp a ON s.project = a.project AND s.doc_id = a.doc_id GROUP BY ALL)
SELECT project, doc_id, CAST(NULL AS BIGINT) AS elem,
       CASE WHEN r IN (1, 2, 8) THEN 'invalid_json' ELSE 'not_array' END AS reason
FROM n WHERE r IN (2, 3, 4, 5, 8) OR (r = 1 AND n > 0)
UNION ALL SELECT project, doc_id, CAST(0 AS BIGINT), 'not_object' FROM n WHERE r = 6
UNION ALL SELECT project, doc_id, CAST(0 AS BIGINT), 'bad_offset' FROM n WHERE r = 7 AND n > 0"""
ORACLE["normalize_mapping"] = f"""WITH {ANN}
SELECT project, doc_id, ord,
       CASE (doc_id + ord) % 6 WHEN 0 THEN key || '=' || text WHEN 1 THEN key || '=' || text
            WHEN 4 THEN '' ELSE key || '=' END AS mapping
FROM annp"""

ORACLE["find_mappings"] = f"""WITH {VOC},
v AS (SELECT 'geo' AS project, 'nation' AS key, CAST(n_nationkey AS BIGINT) AS pos, n_name AS term FROM nation
      UNION ALL SELECT project, key, pos, term FROM voc),
m AS (SELECT 'geo' AS project, 'n' || CAST(n_nationkey AS VARCHAR) AS mention_id, 'nation' AS key, n_name AS text FROM nation
      UNION ALL SELECT 'geo', 'r' || CAST(r_regionkey AS VARCHAR), 'nation', r_name FROM region
      UNION ALL SELECT p_type, 'p' || CAST(p_partkey AS VARCHAR),
        CASE p_partkey % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'brand' ELSE 'type' END,
        CASE WHEN p_partkey % 3 = 1 THEN substr(p_brand, 1, 7) ELSE p_name END FROM part),
hit AS (SELECT m.project, m.mention_id, m.key, m.text, v.pos, v.term, true AS matched
        FROM m JOIN v ON m.project = v.project AND m.key = v.key
        WHERE contains(v.term, m.text) OR contains(m.text, v.term))
SELECT * FROM hit
UNION ALL
SELECT m.project, m.mention_id, m.key, m.text, v.pos, v.term, false
FROM m JOIN v ON m.project = v.project AND m.key = v.key
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.project = m.project AND h.mention_id = m.mention_id AND h.key = m.key)"""
ORACLE["candidates"] = f"""WITH {ANN}, {VOC}, {LM}
SELECT a.project, a.doc_id, a.ord, a.label, l.category, l.pos AS cat_pos, v.term, v.pos AS term_pos
FROM annp a LEFT JOIN lm l ON a.project = l.project AND a.label = l.label
LEFT JOIN voc v ON v.project = a.project AND v.key = l.category"""
ORACLE["has_vocab"] = f"""WITH {VOC},
p AS (SELECT DISTINCT p_type AS project FROM part UNION SELECT DISTINCT source FROM documents)
SELECT p.project, EXISTS (SELECT 1 FROM voc v WHERE v.project = p.project) AS has_vocab FROM p"""
ORACLE["vocab_stats"] = f"""WITH {VOC}
SELECT project, key, CAST(count(term) AS BIGINT) AS n_terms FROM voc GROUP BY project, key"""
ORACLE["vocab_from_columns"] = f"WITH {VOC}\nSELECT project, key, pos, term FROM voc"
ORACLE["read_vocab"] = ORACLE["vocab_from_columns"]
ORACLE["read_label_map"] = f"WITH {LM}\nSELECT project, label, pos, category FROM lm"
ORACLE["write_vocab"] = f"""WITH {VOC}
SELECT project, '{{"key":"' || key || '","terms":[' || string_agg('"' || term || '"', ',' ORDER BY pos) || ']}}' AS json
FROM voc GROUP BY project, key"""
ORACLE["add_candidates"] = f"""WITH {VOC},
new AS (SELECT p_type AS project, 'brand' AS key,
               CASE WHEN p_size % 4 = 0 THEN p_brand || '+' ELSE p_brand END AS term, p_partkey AS seq FROM part
        UNION ALL SELECT p_type, 'color', split_part(p_name, ' ', 1), p_partkey FROM part),
fresh AS (SELECT project, key, term, min(seq) AS seq FROM new WHERE term IS NOT NULL AND term <> '' GROUP BY ALL),
fresh2 AS (SELECT * FROM fresh f WHERE NOT EXISTS (
  SELECT 1 FROM voc v WHERE v.project = f.project AND v.key = f.key AND v.term = f.term)),
base AS (SELECT project, key, max(pos) AS mx FROM voc GROUP BY ALL)
SELECT project, key, pos, term FROM voc
UNION ALL
SELECT f.project, f.key,
       CAST(coalesce(b.mx + 1, 0) + row_number() OVER (PARTITION BY f.project, f.key ORDER BY f.seq, f.term) - 1 AS BIGINT),
       f.term
FROM fresh2 f LEFT JOIN base b ON f.project = b.project AND f.key = b.key"""
ORACLE["add_labels"] = f"WITH {ADDED_LABELS}\nSELECT project, pos, label FROM labels1"
ORACLE["remove_labels"] = f"""WITH {ADDED_LABELS},
rm AS (SELECT p_type AS project, split_part(p_name, ' ', 1) AS label FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT DISTINCT p_type, 'MULTI' FROM part),
kept AS (SELECT * FROM labels1 l WHERE NOT EXISTS (
  SELECT 1 FROM rm WHERE rm.project = l.project AND rm.label = l.label))
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY pos) - 1 AS BIGINT) AS pos, label FROM kept"""
ORACLE["clean_vocab"] = f"""WITH {CLEAN_RAW},
c AS (SELECT project, key, pos, ends_with(term, '.0') AS s,
             CASE WHEN ends_with(term, '.0') THEN left(term, length(term) - 2) ELSE term END AS t2 FROM raw)
SELECT project, key, CAST(row_number() OVER (PARTITION BY project, key ORDER BY s, pos) - 1 AS BIGINT) AS pos,
       t2 AS term
FROM c WHERE t2 IS NOT NULL AND t2 <> '0'"""

ORACLE["mapping_progress"] = f"""WITH {ANN},
agg AS (SELECT project, count(*) AS t, count(*) FILTER (WHERE mapping <> '') AS m FROM annp GROUP BY project),
p AS (SELECT DISTINCT project FROM short)
SELECT p.project, CAST(coalesce(t, 0) AS BIGINT) AS total_spans, CAST(coalesce(m, 0) AS BIGINT) AS mapped_spans,
       CASE WHEN coalesce(t, 0) = 0 THEN 0.0 ELSE CAST(m AS DOUBLE) / t END AS ratio
FROM p LEFT JOIN agg ON p.project = agg.project"""
ORACLE["doc_status"] = f"WITH {STATUS}\nSELECT project, doc_id, n_spans, n_mapped, status FROM st"
ORACLE["span_counts"] = f"WITH {STATUS}\nSELECT project, doc_id, n_spans FROM st"
ORACLE["status_summary"] = f"""WITH {STATUS}
SELECT project, CAST(count(*) FILTER (WHERE status = 'not_started') AS BIGINT) AS not_started,
       CAST(count(*) FILTER (WHERE status = 'mapping_incomplete') AS BIGINT) AS mapping_incomplete,
       CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS done
FROM st GROUP BY project"""
ORACLE["annotated_docs"] = f"""WITH {ANN}
SELECT project, CAST(count(DISTINCT doc_id) AS BIGINT) AS annotated_rows FROM annp GROUP BY project"""
ORACLE["list_projects"] = f"""WITH {ANN}, {VOC}, {LM},
d AS (SELECT project, count(*) AS n_docs FROM short GROUP BY project),
s AS (SELECT project, count(*) AS n_spans FROM annp GROUP BY project)
SELECT d.project, CAST(n_docs AS BIGINT) AS n_docs, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       EXISTS (SELECT 1 FROM voc v WHERE v.project = d.project) AS has_vocab,
       EXISTS (SELECT 1 FROM lm l WHERE l.project = d.project) AS has_label_map
FROM d LEFT JOIN s ON d.project = s.project"""
ORACLE["segments"] = f"""WITH {ANN},
s AS (SELECT a.*, lag(end_pos, 1, 0) OVER w AS last_end, lead(ord) OVER w IS NULL AS is_last,
             row_number() OVER w AS rnk
      FROM annp a WINDOW w AS (PARTITION BY project, doc_id ORDER BY start_pos, ord)),
pieces AS (
  SELECT project, doc_id, rnk, 0 AS sub, 'gap' AS kind,
         substring(query, CAST(last_end + 1 AS BIGINT), CAST(greatest(start_pos - last_end, 0) AS BIGINT)) AS text,
         CAST(NULL AS VARCHAR) AS label
  FROM s WHERE start_pos > last_end
  UNION ALL SELECT project, doc_id, rnk, 1, 'span', text, label FROM s
  UNION ALL SELECT project, doc_id, rnk, 2, 'gap',
         substring(query, CAST(end_pos + 1 AS BIGINT), CAST(greatest(length(query) - end_pos, 0) AS BIGINT)), NULL
  FROM s WHERE is_last AND end_pos < length(query)
  UNION ALL SELECT project, doc_id, 0, 0, 'gap', query, NULL FROM short d
  WHERE length(query) > 0 AND NOT EXISTS (SELECT 1 FROM annp a WHERE a.project = d.project AND a.doc_id = d.doc_id))
SELECT project, doc_id, CAST(row_number() OVER (PARTITION BY project, doc_id ORDER BY rnk, sub) - 1 AS BIGINT) AS piece,
       kind, text, label FROM pieces"""
ORACLE["preview"] = f"""WITH {ANN}
SELECT project, doc_id, string_agg(text || ' (' || label || ')', ' ' ORDER BY ord) AS preview
FROM annp GROUP BY project, doc_id"""
ORACLE["export_annotations"] = f"""WITH {ANN}
SELECT s.project, s.doc_id, s.query, {EXPORT_JSON} AS annotations
FROM short s LEFT JOIN annp a ON s.project = a.project AND s.doc_id = a.doc_id
GROUP BY s.project, s.doc_id, s.query"""
ORACLE["export_one"] = f"""WITH {ANN}
SELECT s.project, s.doc_id, s.query, {EXPORT_JSON} AS annotations
FROM short s LEFT JOIN annp a ON s.project = a.project AND s.doc_id = a.doc_id
WHERE s.doc_id = 0 GROUP BY s.project, s.doc_id, s.query"""
ORACLE["read_docs_csv"] = "SELECT 'csv' AS project, p_partkey AS doc_id, p_name AS query FROM part"
ORACLE["read_docs_json"] = "SELECT 'json' AS project, p_partkey AS doc_id, p_name AS query FROM part"
ORACLE["with_doc_id"] = """SELECT CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS BIGINT) AS doc_id,
       p_partkey, p_name FROM part"""
ORACLE["documents_csv"] = """SELECT 'csv' AS project, doc_id, ' ' || chr(9) || text || '  ' AS query FROM documents"""
ORACLE["documents_json"] = """SELECT 'json' AS project, doc_id, ' ' || chr(9) || text || '  ' AS query FROM documents"""
ORACLE["write_spans"] = ORACLE["explode_spans"]
ORACLE["replace_project"] = f"""WITH {ANN}
SELECT '007' AS project, (SELECT count(*) FROM part)::BIGINT AS n_docs, 0::BIGINT AS n_spans
UNION ALL SELECT '7', (SELECT count(*) FROM part)::BIGINT, (SELECT count(*) FROM annp)::BIGINT"""
ORACLE["read_legacy_store"] = ORACLE["explode_spans"]
ORACLE["csv_rejects"] = """SELECT 'row' AS kind, p_partkey AS doc_id,
       CASE WHEN p_size % 10 <> 1 THEN p_name || chr(10) || '"' || p_brand || '", x' END AS query
FROM part WHERE p_size % 10 <> 0
UNION ALL SELECT 'field_count', NULL, NULL FROM part WHERE p_size % 10 = 0"""
ORACLE["json_rejects"] = """SELECT 'row' AS kind, doc_id, text AS query FROM documents WHERE doc_id % 7 <> 3
UNION ALL SELECT 'invalid_line', NULL, NULL FROM documents WHERE doc_id % 7 = 3"""
ORACLE["candidates_by_label"] = f"""WITH {ANN}, {VOC}, {LM},
u AS (SELECT project, label, CAST(count(*) AS BIGINT) AS n_spans FROM annp GROUP BY project, label)
SELECT u.project, u.label, l.category, l.pos AS cat_pos, v.term, v.pos AS term_pos, u.n_spans
FROM u LEFT JOIN lm l ON u.project = l.project AND u.label = l.label
LEFT JOIN voc v ON v.project = u.project AND v.key = l.category"""
