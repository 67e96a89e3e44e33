"""Command line: split, bench and merge.

    python -m gapweave.cli split --in notes.md --out docs
    python -m gapweave.cli bench gold.json notes.md
    python -m gapweave.cli merge docs/notes --out whole.md
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import shutil
import sys

from pyspark.sql import SparkSession, functions as F

from . import __version__, ship
from .operators import detect as D, evaluate as E, links as L, render as R
from .plans.pipeline import Config, run
from .sources import files
from .sources.llm_detector import LlmDetector, gemini_call
from .sources.providers import ProviderConfig, cached, create, http_post

log = logging.getLogger("gapweave")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "msg": record.getMessage()}, ensure_ascii=False)


def set_up_log(quiet: bool, style: str, debug: bool = False) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if style == "json" else logging.Formatter("%(levelname)s: %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(logging.ERROR if quiet else logging.DEBUG if debug else logging.INFO)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("gapweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gapweave", description="Split Markdown where its topics change.")
    top.add_argument("--quiet", action="store_true")
    top.add_argument("--debug", action="store_true")
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    top.add_argument("--log-format", choices=("text", "json"), default="text")
    commands = top.add_subparsers(dest="command", required=True)
    split = commands.add_parser("split", help="split Markdown files into segments")
    split.add_argument("files", nargs="*")
    split.add_argument("--in", dest="inputs", action="append", default=[])
    split.add_argument("--out", default="docs")
    split.add_argument("--prefix")
    split.add_argument("--force", action="store_true", help="replace an output folder that exists")
    split.add_argument("--dry-run", action="store_true")
    split.add_argument("--json", action="store_true", help="print a summary of each file")
    split.add_argument("--jsonl", nargs="?", const="auto", help="write JSON lines to a path, - or the output folder")
    split.add_argument("--state-file", help="skip sources that the state has unchanged")
    split.add_argument("--refine", action="store_true", help="make vectors and split at deep gaps")
    split.add_argument("--detector", choices=("headings", "llm"), default="headings")
    split.add_argument("--llm-model", default="", help="model asked for boundaries")
    split.add_argument("--llm-refine", action="store_true", help="show the model the similarities of neighbours")
    split.add_argument("--cache", help="folder that keeps vectors between runs")
    split.add_argument("--agent-metadata", action="store_true", help="segment ids and coherence in JSON lines")
    split.add_argument("--overlap", type=int, default=0)
    split.add_argument("--context-format", default="comment", choices=("comment", "front-matter", "heading", "none"))
    split.add_argument("--context-max-depth", type=int, default=0)
    split.add_argument("--embedder", default="auto")
    split.add_argument("--embed-model", default="")
    split.add_argument("--batch-size", type=int, default=32)
    split.add_argument("--embed-concurrency", type=int, default=4)
    split.add_argument("--embed-qps", type=float, default=0.0)
    split.add_argument("--min-tokens", type=int, default=0)
    split.add_argument("--max-tokens", type=int, default=0)
    split.add_argument("--max-lines", type=int, default=0)
    split.add_argument("--barrier", type=int, default=0)
    split.add_argument("--dag-json", action="store_true")
    split.add_argument("--dag-dot", action="store_true")
    split.add_argument("--no-index", action="store_true")
    bench = commands.add_parser("bench", help="score detectors against gold boundaries")
    bench.add_argument("gold")
    bench.add_argument("markdown")
    bench.add_argument("--json", action="store_true")
    bench.add_argument("--embedder", default="tfidf")
    bench.add_argument("--tolerance", type=int)
    bench.add_argument("--k", type=int)
    bench.add_argument("--eval-stage", choices=("raw", "final", "both"))
    bench.add_argument("--no-baselines", action="store_true")
    merge = commands.add_parser("merge", help="join a folder's segments again")
    merge.add_argument("inputs", nargs="+")
    merge.add_argument("--out")
    merge.add_argument("--strip-context", action="store_true")
    return top


def config_of(args: argparse.Namespace) -> Config:
    from .operators.segments import OptimizeConfig

    refined = {}
    if args.refine or args.llm_refine:
        provider = ProviderConfig(args.embedder, args.embed_model, batch=args.batch_size, partitions=args.embed_concurrency, qps=args.embed_qps, post=http_post)
        refined["embedder"] = cached(provider, args.cache) if args.cache else create(provider)
    if args.refine:
        refined["detector"] = D.DepthThreshold()
    if args.detector == "llm" or args.llm_refine:
        if not (key := os.environ.get("GEMINI_API_KEY")):
            raise SystemExit("GEMINI_API_KEY is needed to ask a language model for boundaries")
        refined["detector"] = LlmDetector(gemini_call(args.llm_model, key, http_post))
    return Config(optimize=OptimizeConfig(args.min_tokens, args.max_tokens, args.max_lines, args.barrier), context_style=args.context_format, context_depth=args.context_max_depth, overlap=args.overlap, prefix=args.prefix, **refined)


def split(args: argparse.Namespace) -> int:
    paths = [*args.inputs, *args.files]
    if not paths:
        log.error("no input")
        return 2
    spark = session()
    from .streaming import incremental as I

    for path in paths:
        sources = files.read_markdown(spark, path).cache()
        folder = os.path.join(args.out, os.path.splitext(os.path.basename(path))[0])
        if args.state_file and I.changed_sources(sources, I.load_state(spark, args.state_file)).isEmpty():
            log.info("%s is unchanged", path)
            continue
        if os.path.exists(folder) and not args.dry_run:
            if not args.force:
                log.error("%s exists; --force replaces it", folder)
                return 1
            shutil.rmtree(files.safe_path(args.out, os.path.relpath(folder, args.out)))
        result = run(sources, config_of(args))
        segments = result.segments.cache()
        if not args.dry_run:
            files.write_segments(segments, os.path.abspath(folder))
            nodes = L.nodes(segments, result.assigned).cache()
            edges = L.edges(segments, nodes).cache()
            outputs = [] if args.no_index else [("index.md", L.index_markdown(nodes.join(segments.select("doc_id", "seg_idx", "filename"), ["doc_id", "seg_idx"]), edges), "index_md")]
            outputs += [("dag.json", L.graph_json(nodes, edges), "graph")] * args.dag_json + [("dag.dot", L.dot(nodes, edges), "dot")] * args.dag_dot
            for name, table, column in outputs:
                text = table.select(column).first()
                with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
                    out.write(text[0] if text else "")
            if args.state_file:
                others = I.load_state(spark, args.state_file).join(sources.select("source_name"), "source_name", "left_anti").cache()
                I.save_state(others.unionByName(I.build_state(segments, sources)), args.state_file)
        if args.jsonl and not (args.dry_run and args.jsonl != "-"):
            shown = segments if args.agent_metadata else segments.drop("coherence", "boundary_confidence").withColumns({c: F.lit("") for c in ("segment_id", "prev_segment_id", "next_segment_id")})
            lines = [r.line for r in R.jsonl(shown).orderBy("seg_idx").toLocalIterator()]
            target = sys.stdout if args.jsonl == "-" else open(os.path.join(folder, "metadata.jsonl") if args.jsonl == "auto" else args.jsonl, "w", encoding="utf-8")  # noqa: SIM115
            target.write("".join(f"{x}\n" for x in lines))
            if target is not sys.stdout:
                target.close()
        if args.json:
            for r in R.summary(segments, result.boundaries).collect():  # one row for the file
                print(json.dumps({"source": path, "segments": r.segments, "total_tokens": r.total_tokens, "boundaries": json.loads(r.boundaries)}))
        log.info("%s: %d segments", path, segments.count())
    return 0


def bench(args: argparse.Namespace) -> int:
    spark = session()
    gold = files.check_gold(files.read_gold(spark, args.gold)).first()
    params = gold.params.asDict() if gold.params else {}
    pick = lambda given, name, default: given if given is not None else params.get(name) if params.get(name) is not None else default
    tolerance, k, stage = pick(args.tolerance, "tolerance", 1), pick(args.k, "k", 0), pick(args.eval_stage, "eval_stage", "final")
    sources = files.read_markdown(spark, args.markdown).cache()
    result = run(sources, Config(detector=D.DepthThreshold(), embedder=create(ProviderConfig(args.embedder))))
    blocks = result.blocks.cache()
    sizes = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).cache()
    row = sizes.first()
    ref = E.strict(spark.createDataFrame([(row.doc_id, b) for b in gold.boundaries], "doc_id long, gap_idx int"), sizes).cache()
    for warning in E.warnings(row.n, k or max(1, int(row.n / (len(gold.boundaries) + 1) / 2))):
        log.warning(warning)
    methods = [(f"pipeline ({args.embedder},{s})", table) for s, table in (("raw", result.raw_boundaries), ("final", result.boundaries)) if stage in (s, "both")]
    if not args.no_baselines:
        size = max(2, row.n // (len(gold.boundaries) + 1))
        methods += [("heading-split", D.HeadingSplit().detect(blocks)), (f"fixed-{size}", D.FixedSplit(size).detect(blocks)), (f"random (n={len(gold.boundaries)})", D.RandomSplit(len(gold.boundaries)).detect(blocks))]
    rows = [E.evaluate(sizes, ref, hyp, name, k, tolerance).first().asDict() for name, hyp in methods]
    print(json.dumps({"doc_id": gold.doc_id, "results": rows}) if args.json else E.format_table(rows))
    return 0


def merge(args: argparse.Namespace) -> int:
    spark, texts = session(), []
    for path in args.inputs:
        found = files.segment_files(spark, path).toLocalIterator() if os.path.isdir(path) else files.read_markdown(spark, path).select(F.col("content").cast("string").alias("text")).toLocalIterator()
        texts += [r.text for r in found]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id long, seg_idx int, rendered string")
    merged = R.with_glue(rows, args.strip_context).first()
    text = merged.merged if merged else ""
    if args.out:
        with open(args.out, "w", encoding="utf-8", newline="") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    set_up_log(args.quiet, args.log_format, args.debug)
    return {"split": split, "bench": bench, "merge": merge}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
