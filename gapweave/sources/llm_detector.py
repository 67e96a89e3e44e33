"""A boundary detector that asks a language model, one call for a document, through an injected transport."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.detect import validate
from ..operators.render import ordered_text
from .providers import Post, http_post

#: What the model is told, by whether the document has headings and similarities come along.
INSTRUCTIONS = {
    (True, True): "Find where the topic changes. Headings outline the document; prefer gaps before a heading, and use low similarity of neighbours as evidence.",
    (True, False): "Find where the topic changes. Headings outline the document; prefer gaps before a heading that opens a new topic.",
    (False, True): "Find where the topic changes. The document has no headings: judge by content, and use low similarity of neighbours as evidence.",
    (False, False): "Find where the topic changes. The document has no headings: judge by content alone.",
}
SCHEMA = {"type": "object", "properties": {"boundaries": {"type": "array", "items": {"type": "integer"}}}, "required": ["boundaries"]}


def prompts(blocks: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """doc_id, instruction, prompt, for documents of two blocks or more."""
    rows = blocks.select("doc_id", "block_idx", "kind", "heading_level", "text")
    rows = rows.join(gaps.select("doc_id", F.col("gap_idx").alias("block_idx"), "similarity"), ["doc_id", "block_idx"], "left") if gaps is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    level = F.when(F.col("kind") == "heading", F.format_string(", level %d", "heading_level")).otherwise(F.lit(""))
    near = F.when(F.col("similarity").isNotNull(), F.format_string("\nsimilarity: %.4f", "similarity")).otherwise(F.lit(""))
    part = F.concat(F.format_string("[Block %d] (%s", "block_idx", "kind"), level, F.lit(")\n"), F.col("text"), near, F.lit("\n\n"))
    doc = rows.withColumn("part", part).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind") == "heading").alias("h"), ordered_text("part", "block_idx").alias("body")).where("n > 1")
    head = F.format_string("The document has %d blocks; gap indices 0 to %d.\n\n", F.col("n"), F.col("n") - 2)
    said = F.when(F.col("h"), F.lit(INSTRUCTIONS[True, gaps is not None])).otherwise(F.lit(INSTRUCTIONS[False, gaps is not None]))
    return doc.select("doc_id", said.alias("instruction"), F.concat(head, F.col("body")).alias("prompt"))


#: Fixed value: the model asked where none is named.
DEFAULT_MODEL = "gemini-2.5-flash-lite"


def gemini_call(model: str, key: str, post: Post = http_post) -> Callable[[str, str, dict, float], str]:
    """A transport to a Gemini model, which answers in JSON of the schema."""
    url = f"https://generativelanguage.googleapis.com/v1beta/models/{model or DEFAULT_MODEL}:generateContent"

    def call(instruction: str, prompt: str, schema: dict, temperature: float) -> str:
        said = {"temperature": temperature, "responseMimeType": "application/json", "responseSchema": schema}
        payload = {"systemInstruction": {"parts": [{"text": instruction}]}, "contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": said}
        return post(url, payload, {"x-goog-api-key": key})["candidates"][0]["content"]["parts"][0]["text"]

    return call


class LlmDetector:
    """``call(instruction, prompt, schema, temperature) -> JSON text`` is run on the executors, once for a document."""

    def __init__(self, call: Callable[[str, str, dict, float], str]):
        self.call = call

    def detect(self, blocks: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
        call = self.call

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [(d, int(b)) for d, i, p in zip(part["doc_id"], part["instruction"], part["prompt"]) for b in json.loads(call(i, p, SCHEMA, 0.0))["boundaries"]]
                yield pd.DataFrame(rows, columns=["doc_id", "gap_idx"]).astype({"doc_id": "int64", "gap_idx": "int32"})

        return validate(prompts(blocks, gaps).mapInPandas(run, "doc_id long, gap_idx int"), blocks)
