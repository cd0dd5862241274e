"""Table schemas and the fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# One annotation: half-open [start, end) in code points of the query text.
MAPPING_TYPE = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
ANNOTATION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("mapped_value", MAPPING_TYPE),
])
ANNOTATIONS = T.ArrayType(ANNOTATION)
ANNOTATIONS_DDL = ("array<struct<text:string,label:string,start:bigint,`end`:bigint,"
                   "mapped_value:map<string,array<string>>>>")
# Parsing target: mapped_value stays VARIANT until it is normalised.
ANNOTATIONS_VARIANT_DDL = ("array<struct<text:string,label:string,start:bigint,`end`:bigint,"
                           "mapped_value:variant>>")

DOCS = "project string, doc_id bigint, query string"
SPANS = ("project string, doc_id bigint, ord bigint, text string, label string, "
         "start bigint, `end` bigint, mapped_value map<string,array<string>>")
VOCAB = "project string, key string, pos int, term string"
LABEL_MAP = "project string, label string, pos int, category string"
LABELS = "project string, pos int, label string"
EDITS = ("project string, doc_id bigint, seq bigint, op string, ord bigint, text string, "
         "label string, start bigint, `end` bigint, category string, `values` array<string>")
REJECTS = "project string, doc_id bigint, elem bigint, reason string"

SPAN_COLS = ["project", "doc_id", "ord", "text", "label", "start", "end", "mapped_value"]

# Row status values (per-row badge).
STATUS_NOT_STARTED = "not_started"
STATUS_INCOMPLETE = "mapping_incomplete"
STATUS_DONE = "done"
STATUSES = [STATUS_NOT_STARTED, STATUS_INCOMPLETE, STATUS_DONE]

# The default entity labels, in registry order, and the default
# label -> categories map. They must equal the source tool's defaults.
DEFAULT_LABELS = [
    "品类", "品牌", "型号", "年份", "价格", "cpu", "gpu", "内存", "存储", "重量",
    "颜色", "屏幕尺寸", "屏幕分辨率", "其他", "ai",
]
DEFAULT_LABEL_MAP = {
    "品类": ["category"],
    "品牌": ["brand"],
    "型号": ["model"],
    "年份": ["release_year"],
    "价格": ["price"],
    "cpu": ["cpu_brand", "cpu_series", "cpu_family", "cpu_model", "cpu_gen"],
    "gpu": ["gpu_type", "gpu_brand", "gpu_series", "gpu_model"],
    "内存": ["memory_capacity_gb"],
    "存储": ["storage_capacity_gb"],
    "屏幕尺寸": ["screen_size_inch"],
    "屏幕分辨率": ["screen_resolution"],
    "其他": ["other"],
    "颜色": ["color"],
    "ai": ["ai"],
}
