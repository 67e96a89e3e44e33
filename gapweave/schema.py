"""Columns of the engine's tables; every table is keyed by doc_id, and ranges are half-open bytes of the UTF-8 source."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source_name", T.StringType()), T.StructField("content", T.BinaryType())])
#: What the Markdown scanner emits.
RAW_BLOCKS = "doc_id long, block_idx int, kind string, text string, title string, heading_level int, start_byte int, end_byte int, raw binary"
#: Gold annotations, see sources.read_gold.
GOLD = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("boundaries", T.ArrayType(T.IntegerType())),
        T.StructField("params", T.StructType([T.StructField("eval_stage", T.StringType()), T.StructField("tolerance", T.IntegerType()), T.StructField("k", T.IntegerType())])),
        T.StructField("notes", T.MapType(T.StringType(), T.StringType())),
    ]
)
STATE = T.StructType([T.StructField(n, t) for n, t in (("source_name", T.StringType()), ("source_hash", T.StringType()), ("segment_id", T.StringType()), ("seg_idx", T.IntegerType()), ("start_byte", T.IntegerType()), ("end_byte", T.IntegerType()), ("hash", T.StringType()))])
CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
EMBEDDINGS = "doc_id long, block_idx int, vector array<double>"
