"""The split pipeline: sources to blocks, boundaries, segments, ids, quality and rendered text, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..operators import blocks as B, gaps as G, quality as Q, render as R, segments as S
from ..operators.detect import DepthThreshold, Detector, HeadingSplit, validate
from ..operators.evaluate import final_boundaries
from ..sources.providers import Embed

Hook = Callable[[DataFrame], DataFrame | None]


@dataclass
class Hooks:
    """Called with each stage's table; what they return, if anything, takes its place, and an error stops the run."""

    on_parse: Hook | None = None
    on_embed: Hook | None = None
    on_boundary: Hook | None = None
    on_segment: Hook | None = None
    on_render: Hook | None = None


@dataclass
class Config:
    detector: Detector = field(default_factory=HeadingSplit)
    embedder: Embed | None = None
    optimize: S.OptimizeConfig = field(default_factory=S.OptimizeConfig)
    context_style: str = "comment"
    context_depth: int = 0
    context_exclude: tuple[str, ...] = ()
    overlap: int = 0
    prefix: str | None = None
    hooks: Hooks = field(default_factory=Hooks)


@dataclass
class Result:
    """Tables of a run; ``gaps`` and ``quality`` only where an embedder was given.

    Blocks, vectors and the segmentation are kept on first use, as several tables read them; ``release`` lets them go.
    """

    blocks: DataFrame
    assigned: DataFrame
    raw_boundaries: DataFrame
    boundaries: DataFrame
    segments: DataFrame
    gaps: DataFrame | None = None
    quality: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for table in self.kept:
            table.unpersist()


def _hooked(hook: Hook | None, table: DataFrame) -> DataFrame:
    out = hook(table) if hook else None
    return table if out is None else out


def run(sources: DataFrame, config: Config | None = None) -> Result:
    """Split every source (doc_id, source_name, content). A source without blocks has no rows in any table.

    Vectors are only made where ``embedder`` is given. Confidence is that of depth over the threshold with a depth
    detector and 1 for any other detector's boundaries; coherence is null without vectors.
    """
    config = config or Config()
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    blocks = keep(_hooked(config.hooks.on_parse, B.blocks_of(sources)))
    gaps = scored = vectors = None
    if config.embedder is not None:
        vectors = keep(_hooked(config.hooks.on_embed, config.embedder(blocks)))
        gaps = G.similarities(vectors)
        detector = config.detector if isinstance(config.detector, DepthThreshold) else DepthThreshold()
        scored = G.with_confidence(detector.scored(gaps))
    raw = _hooked(config.hooks.on_boundary, validate(config.detector.detect(blocks, gaps), blocks))
    assigned = keep(S.optimize(blocks, raw, config.optimize, scored))
    final = final_boundaries(assigned)
    segments = R.with_filenames(S.with_ids(S.roll_up(assigned), sources), assigned, config.prefix)
    before = final.select("doc_id", (F.row_number().over(B.doc_order("gap_idx"))).alias("seg_idx"), "gap_idx")
    quality = None
    if scored is not None and isinstance(config.detector, DepthThreshold):
        sure = before.join(scored.select("doc_id", "gap_idx", "confidence"), ["doc_id", "gap_idx"], "left")
    else:
        sure = before.withColumn("confidence", F.lit(1.0))
    segments = segments.join(sure.select("doc_id", "seg_idx", F.col("confidence").alias("boundary_confidence")), ["doc_id", "seg_idx"], "left")
    if vectors is not None:
        near = Q.coherence(assigned, vectors)
        segments = segments.join(near, ["doc_id", "seg_idx"], "left")
        quality = Q.document_metrics(near, sure)
    segments = _hooked(config.hooks.on_segment, segments)
    rendered = R.render(segments, assigned, sources, config.context_style, config.context_depth, config.context_exclude, config.overlap)
    return Result(blocks, assigned, raw, final, _hooked(config.hooks.on_render, rendered), scored, quality, kept)
