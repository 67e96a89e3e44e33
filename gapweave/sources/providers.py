"""Embedding providers: a registry, offline ones as DataFrame operators, HTTP ones as Arrow batch calls, a cache.

An embedder takes blocks and gives (doc_id, block_idx, vector). HTTP providers send batches through a transport
function ``post(url, payload, headers) -> reply``, which tests replace; parallelism is the number of partitions, and a
rate limit is shared out evenly among them.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import embed
from ..schema import CACHE, EMBEDDINGS

Embed = Callable[[DataFrame], DataFrame]
Post = Callable[[str, dict, dict], dict]
_registry: dict[str, Callable[["ProviderConfig"], Embed]] = {}
BLANK = "(empty)"
#: Largest reply read, in bytes.
MAX_REPLY = 100 << 20
#: Short names of sentence-transformer models.
SENTENCE_MODELS = {
    "minilm": "all-MiniLM-L6-v2",
    "stella": "dunzhang/stella_en_400M_v5",
    "stella-400m": "dunzhang/stella_en_400M_v5",
    "e5-large": "intfloat/e5-large-v2",
    "e5-instruct": "intfloat/e5-large-instruct",
    "bge-large": "BAAI/bge-large-en-v1.5",
}


@dataclass(frozen=True)
class ProviderConfig:
    name: str = "auto"
    model: str = ""
    url: str = ""
    dimensions: int = 0
    batch: int = 0
    partitions: int = 4
    qps: float = 0.0
    task: str = "SEMANTIC_SIMILARITY"
    headers: dict = field(default_factory=dict)
    post: Post | None = None


def register(name: str, factory: Callable[[ProviderConfig], Embed]) -> None:
    if name in _registry:
        raise ValueError(f"provider {name!r} is registered already")
    _registry[name] = factory


def available() -> list[str]:
    return sorted(_registry)


def resolved(config: ProviderConfig) -> ProviderConfig:
    """``auto`` is gemini where its key is set, else tfidf."""
    return replace(config, name="gemini" if os.environ.get("GEMINI_API_KEY") else "tfidf") if config.name == "auto" else config


def create(config: ProviderConfig) -> Embed:
    """The provider of that name."""
    name = resolved(config).name
    if name not in _registry:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(available())}")
    return _registry[name](config)


def http_post(url: str, payload: dict, headers: dict) -> dict:
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not an http address: {url}")
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as reply:
        body = reply.read(MAX_REPLY + 1)
    if len(body) > MAX_REPLY:
        raise ValueError("the reply is too large")
    return json.loads(body)


def over_http(config: ProviderConfig, batch: int, ask: Callable[[list[str]], tuple[str, dict]], read: Callable[[dict], list[list[float]]]) -> Embed:
    """An embedder that sends ``ask(texts)`` for each batch and reads vectors from the reply; as many as texts, or an error."""
    post, size = config.post or http_post, config.batch or batch
    wait = config.partitions / config.qps if config.qps > 0 else 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = 0.0
        for part in parts:
            for at in range(0, len(part), size):
                rows = part.iloc[at : at + size]
                time.sleep(max(0.0, sent + wait - time.monotonic()) if sent else 0.0)
                sent = time.monotonic()
                url, payload = ask([t if t and t.strip() else BLANK for t in rows["text"]])
                vectors = read(post(url, payload, config.headers))
                if len(vectors) != len(rows):
                    raise ValueError(f"{len(vectors)} vectors came for {len(rows)} texts")
                yield rows[["doc_id", "block_idx"]].assign(vector=[[float(x) for x in v] for v in vectors])

    return lambda blocks: blocks.select("doc_id", "block_idx", "text").repartition(config.partitions, "doc_id", "block_idx").mapInPandas(run, EMBEDDINGS)


def _gemini(c: ProviderConfig) -> Embed:
    model = c.model or "gemini-embedding-001"
    url = c.url or f"https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents"
    one = lambda t: {"model": f"models/{model}", "content": {"parts": [{"text": t}]}, "taskType": c.task} | ({"outputDimensionality": c.dimensions} if c.dimensions else {})
    return over_http(c, 32, lambda texts: (url, {"requests": [one(t) for t in texts]}), lambda r: [e["values"] for e in r["embeddings"]])


def _openai(c: ProviderConfig) -> Embed:
    payload = lambda texts: {"model": c.model or "text-embedding-3-small", "input": texts} | ({"dimensions": c.dimensions} if c.dimensions else {})
    return over_http(c, 2048, lambda texts: (c.url or "https://api.openai.com/v1/embeddings", payload(texts)), lambda r: [e["embedding"] for e in sorted(r["data"], key=lambda e: e["index"])])


def _ollama(c: ProviderConfig) -> Embed:
    if c.dimensions:
        raise ValueError("ollama has no choice of dimensions")
    return over_http(c, 32, lambda texts: (f"{c.url or 'http://localhost:11434'}/api/embed", {"model": c.model or "nomic-embed-text", "input": texts}), lambda r: r["embeddings"])


def _sentence(c: ProviderConfig) -> Embed:
    return over_http(c, 32, lambda texts: (f"{c.url or 'http://localhost:8080'}/embed", {"model": SENTENCE_MODELS.get(c.model, c.model or SENTENCE_MODELS["minilm"]), "texts": texts}), lambda r: r["embeddings"])


register("tfidf", lambda c: embed.tfidf)
register("mock", lambda c: embed.charfreq)
register("gemini", _gemini)
register("openai", _openai)
register("ollama", _ollama)
register("sentencetransformer", _sentence)


def keyed(blocks: DataFrame, config: ProviderConfig) -> DataFrame:
    """Blocks with their cache key, of text, provider, model, task and dimensions."""
    return blocks.withColumn("key", T.cache_key(F.col("text"), F.lit(config.name), F.lit(config.model), F.lit(config.task), F.lit(str(config.dimensions))))


def with_cache(blocks: DataFrame, cache: DataFrame, config: ProviderConfig, provider: Embed | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of all blocks, and the cache rows (key, vector) to add: only texts not in the cache are sent, each once.

    TF-IDF vectors hang on the whole document and are never cached.
    """
    provider = provider or create(config)
    if config.name == "tfidf":
        return provider(blocks), cache.limit(0)
    rows = keyed(blocks, config)
    known = rows.join(cache, "key").select("doc_id", "block_idx", "vector")
    missing = rows.join(cache, "key", "left_anti")
    once = missing.groupBy("key").agg(F.min(F.struct("doc_id", "block_idx", "text")).alias("b")).select("key", "b.*")
    made = once.select("key", "doc_id", "block_idx").join(provider(once.select("doc_id", "block_idx", "text")), ["doc_id", "block_idx"]).select("key", "vector")
    fresh = missing.join(made, "key").select("doc_id", "block_idx", "vector")
    return known.unionByName(fresh), made


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, vector of the cache at a path, one row for each key; none where there is no cache yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("key").agg(F.min("vector").alias("vector"))


def cached(config: ProviderConfig, path: str) -> Embed:
    """The provider of that name behind a cache stored at a path: what it lacks is asked for once, in the provider's
    batches and at its rate, and appended, and all vectors are then read from it.
    """
    config = resolved(config)
    provider = create(config)
    if config.name == "tfidf":
        return provider

    def embed_blocks(blocks: DataFrame) -> DataFrame:
        spark = blocks.sparkSession
        _, made = with_cache(blocks, load_cache(spark, path), config, provider)
        made.write.mode("append").parquet(path)
        return keyed(blocks, config).join(load_cache(spark, path), "key").select("doc_id", "block_idx", "vector")

    return embed_blocks
