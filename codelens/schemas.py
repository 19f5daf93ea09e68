"""StructTypes of the data model."""

from pyspark.sql import types as T

# Files read from a corpus: one row per file.
FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("kind", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
])

# Content-hash state: one row per path.
FILE_STATE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), True),
])

REPO_LOCATOR = T.StructType([
    T.StructField("owner", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("path", T.StringType()),
])

# Chunks before embedding; ``ordinal`` keeps same-id symbols apart.
CHUNKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("symbol_name", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("hook_type", T.StringType()),
    T.StructField("parent_class", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
])

# Vector table: Spark has no fixed-size list, the length is checked by
# ``operators.embed.valid_vector``.
VECTOR_TABLE = T.StructType([
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("symbol_name", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("hook_type", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),
])

NODES = T.StructType([
    T.StructField("node_id", T.StringType(), False),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("doctype", T.StringType()),
    T.StructField("parent_class", T.StringType()),
    T.StructField("hook_type", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False),
    T.StructField("type", T.StringType()),
    T.StructField("key", T.IntegerType()),
])

GOLDEN = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("expected_file", T.StringType()),
    T.StructField("expected_logic", T.StringType()),
])

JUDGE_SCORES = T.StructType([
    T.StructField("accuracy", T.IntegerType()),
    T.StructField("completeness", T.IntegerType()),
    T.StructField("rationale", T.StringType()),
])

# Evaluation report as written by the reference: ``rank`` is an int or "N/A",
# so it is read as a string and cast with ``try_cast``.
EVAL_REPORT_RAW = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("found", T.BooleanType()),
    T.StructField("rank", T.StringType()),
    T.StructField("retrieval_latency", T.DoubleType()),
    T.StructField("generation_latency", T.DoubleType()),
    T.StructField("scores", JUDGE_SCORES),
])

RUN_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
])

INVOICE_ITEM = T.StructType([
    T.StructField("item_code", T.StringType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("sales_order", T.StringType()),
    T.StructField("delivery_note", T.StringType()),
    T.StructField("delivered_by_supplier", T.BooleanType()),
])

INVOICE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("is_pos", T.BooleanType()),
    T.StructField("is_return", T.BooleanType()),
    T.StructField("bypass_credit_limit_check", T.BooleanType()),
    T.StructField("grand_total", T.DoubleType()),
    T.StructField("rounded_total", T.DoubleType()),
    T.StructField("paid_amount", T.DoubleType()),
    T.StructField("write_off_amount", T.DoubleType()),
    T.StructField("items", T.ArrayType(INVOICE_ITEM)),
    T.StructField("precision", T.StructType([T.StructField("grand_total", T.IntegerType())])),
    T.StructField("update_stock", T.BooleanType()),
    T.StructField("is_internal_customer", T.BooleanType()),
    T.StructField("represents_company", T.StringType()),
    T.StructField("inter_company_ref", T.StringType()),
])

VIOLATION = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("details", T.StringType()),
])
