"""The whole pipeline, incremental runs, providers, files and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from gapweave import cli
from gapweave.operators import detect as D, embed, links as L, render as R
from gapweave.operators.evaluate import final_boundaries
from gapweave.plans.pipeline import Config, Hooks, run
from gapweave.sources import files
from gapweave.sources.llm_detector import LlmDetector, prompts
from gapweave.sources.providers import ProviderConfig, available, create, register, with_cache
from gapweave.schema import CACHE, SOURCES
from gapweave.streaming import incremental as I

TEXT = "# Guide\n\nIntro with [two](#part-two).\n\n## Part one\n\nAlpha beta.\n\n## Part two\n\nGamma é delta.\n\n```\n# code\n```\n"


def sources(spark, docs):
    return spark.createDataFrame([(i, f"d{i}.md", bytearray(t.encode())) for i, t in docs.items()], SOURCES)


def test_split_is_lossless_and_linked(spark):
    src = sources(spark, {1: TEXT, 2: "", 3: "\n\nlate start\n"})
    result = run(src, Config(embedder=embed.tfidf))
    rows = result.segments.orderBy("doc_id", "seg_idx").collect()
    assert [(r.doc_id, r.filename) for r in rows] == [(1, "01-guide.md"), (1, "02-part-one.md"), (1, "03-part-two.md"), (3, "01-segment.md")]
    assert b"".join(bytes(r.raw) for r in rows if r.doc_id == 1).decode() == TEXT
    assert rows[0].next_segment_id == rows[1].segment_id == rows[2].prev_segment_id and rows[0].prev_segment_id is None
    assert R.with_glue(result.segments, strip=True).where("doc_id = 1").first().merged == TEXT
    nodes = L.nodes(result.segments, result.assigned)
    assert [tuple(r)[:3] for r in L.edges(result.segments, nodes).select("from_seg", "to_seg", "type").collect()] == [(0, 2, "link")]
    graph = json.loads(L.graph_json(nodes, L.edges(result.segments, nodes)).where("doc_id = 1").first().graph)
    assert graph["edges"] == [{"from": 0, "to": 2, "type": "link"}] and graph["nodes"][2]["anchors"] == ["part-two"]
    assert {r.doc_id: r.min_coherence <= r.avg_coherence for r in result.quality.collect()} == {1: True, 3: True}


def test_table_detector_and_hooks(spark):
    src, order = sources(spark, {1: TEXT}), []
    cut = spark.createDataFrame([(1, 2), (1, 99)], "doc_id long, gap_idx int")
    hooks = Hooks(**{f"on_{s}": (lambda df, s=s: order.append(s)) for s in ("parse", "boundary", "segment", "render")})
    result = run(src, Config(detector=D.TableDetector(cut), hooks=hooks))
    assert order == ["parse", "boundary", "segment", "render"]
    assert [r.gap_idx for r in final_boundaries(result.assigned).collect()] == [1]  # snapped off the heading

    def fails(_):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        run(src, Config(hooks=Hooks(on_segment=fails)))


def test_model_detector_with_fake_transport(spark):
    blocks = run(sources(spark, {1: TEXT, 2: "one\n"})).blocks
    shown = prompts(blocks).collect()
    assert [r.doc_id for r in shown] == [1] and "gap indices 0 to 6" not in shown[0].prompt and "[Block 0] (heading, level 1)" in shown[0].prompt
    found = LlmDetector(lambda instruction, prompt, schema, temperature: json.dumps({"boundaries": [1, 1, 77, -2, 3]})).detect(blocks)
    assert sorted(r.gap_idx for r in found.collect()) == [1, 3]


def test_http_providers_and_cache(spark):
    blocks = run(sources(spark, {1: TEXT, 2: TEXT})).blocks

    def post(url, payload, headers):
        texts = payload["input"]
        assert url.endswith("/api/embed") and len(texts) <= 3
        return {"embeddings": [[float(len(t)), 1.0] for t in texts]}

    config = ProviderConfig("ollama", batch=3, post=post)
    vectors, new = with_cache(blocks, spark.createDataFrame([], CACHE), config)
    assert vectors.count() == blocks.count() and new.count() == blocks.select("text").distinct().count()
    assert with_cache(blocks, new, config)[1].count() == 0
    with pytest.raises(Exception, match="vectors came for"):
        create(ProviderConfig("openai", post=lambda *a: {"data": []}))(blocks).collect()
    with pytest.raises(ValueError):
        create(ProviderConfig("nowhere"))
    with pytest.raises(ValueError):
        register("tfidf", lambda c: embed.tfidf)
    assert available() == sorted(["tfidf", "mock", "gemini", "openai", "ollama", "sentencetransformer"])


def test_incremental_changes(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = I.update(spark, sources(spark, {1: TEXT, 2: "# A\n\nb\n"}), state).collect()
    assert {r.change for r in first} == {"added"} and len(first) == 4
    assert I.update(spark, sources(spark, {1: TEXT, 2: "# A\n\nb\n"}), state).collect() == []
    changed = I.update(spark, sources(spark, {1: TEXT + "\n## New\n", 2: "# A\n\nb\n"}), state).collect()
    assert sorted(r.change for r in changed) == ["added", "added", "removed", "unchanged", "unchanged"]
    assert I.load_state(spark, state).select("source_name").distinct().count() == 2


def test_streaming_takes_in_new_files(spark, tmp_path):
    folder, paths = tmp_path / "in", [f"file://{tmp_path}/{n}" for n in ("state", "changes", "checkpoint")]
    sources(spark, {1: TEXT}).coalesce(1).write.parquet(str(folder))
    I.stream(spark, str(folder), *paths).awaitTermination(120)
    sources(spark, {2: "# B\n"}).coalesce(1).write.mode("append").parquet(str(folder))
    I.stream(spark, str(folder), *paths).awaitTermination(120)
    assert spark.read.parquet(paths[1]).groupBy("source_name").count().orderBy("source_name").collect() == [("d1.md", 3), ("d2.md", 1)]


def test_paths_stay_inside():
    assert files.safe_path("/a", "b/c.md") == "/a/b/c.md"
    for name in ("../x.md", "/etc/x", ".", "b/../../x"):
        with pytest.raises(ValueError):
            files.safe_path("/a", name)


def test_command_line_round_trip(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    note, out = tmp_path / "note.md", tmp_path / "docs"
    note.write_text(TEXT, encoding="utf-8")
    assert cli.main(["split", "--in", str(note), "--out", str(out), "--json", "--jsonl", "--dag-dot", "--state-file", f"{tmp_path}/state"]) == 0
    assert json.loads(capsys.readouterr().out)["segments"] == 3
    names = sorted(p.name for p in (out / "note").iterdir())
    assert names == ["01-guide.md", "02-part-one.md", "03-part-two.md", "dag.dot", "index.md", "metadata.jsonl"]
    lines = [json.loads(x) for x in (out / "note/metadata.jsonl").read_text(encoding="utf-8").splitlines()]
    assert lines[1]["metadata"]["heading_path"] == ["Guide"] and lines[0]["metadata"]["byte_range"][0] == 0
    assert cli.main(["split", "--in", str(note), "--out", str(out), "--state-file", f"{tmp_path}/state"]) == 0  # unchanged: nothing to do
    note.write_text(TEXT + "more\n", encoding="utf-8")
    assert cli.main(["--quiet", "split", "--in", str(note), "--out", str(out)]) == 1
    note.write_text(TEXT, encoding="utf-8")
    assert cli.main(["merge", str(out / "note"), "--strip-context", "--out", str(tmp_path / "whole.md")]) == 0
    assert (tmp_path / "whole.md").read_text(encoding="utf-8") == TEXT
    gold = tmp_path / "gold.json"
    gold.write_text(json.dumps({"doc_id": "note", "unit": "block", "boundaries": [3, 1], "params": {"tolerance": 0}}))
    assert cli.main(["bench", str(gold), str(note), "--json"]) == 0
    results = {r["method"]: r for r in json.loads(capsys.readouterr().out)["results"]}
    assert results["heading-split"]["f1"] == 1.0 and set(results) >= {"pipeline (tfidf,final)", "fixed-2"}
    gold.write_text(json.dumps({"unit": "line", "boundaries": []}))
    with pytest.raises(Exception, match="unknown gold unit"):
        cli.main(["bench", str(gold), str(note)])


def test_segments_without_index_follow_numbers(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"x{n}.md").write_text(f"{n}\n")
    assert [r.name for r in files.segment_files(spark, str(tmp_path)).collect()] == ["x1.md", "x2.md", "x10.md"]
    (tmp_path / "index.md").write_text("[a](x10.md) [b](x1.md) [c](gone.md) [d](x10.md)")
    assert [r.name for r in files.segment_files(spark, str(tmp_path)).collect()] == ["x10.md", "x1.md"]


def test_entry_and_queries_have_matching_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 60


def test_a_run_again_gives_its_own_changes(spark, tmp_path):
    state, given = f"file://{tmp_path}/state", {1: TEXT, 2: "# A\n\nb\n"}
    first = I.update(spark, sources(spark, given), state, run_name="one")
    again = I.update(spark, sources(spark, given), state, run_name="one")
    assert sorted(first.collect()) == sorted(again.collect()) != []
    I.save_state(I.load_state(spark, state), state)
    assert sorted(first.collect()) == sorted(again.collect())  # the version before the last is still there
    (tmp_path / "state" / "v-9").mkdir()  # a run that failed before its marker
    assert I.load_state(spark, state).count() > 0 and [n for n, _ in I.versions(spark, state)] == [1, 2]


def test_model_and_cache_on_the_command_line(spark, tmp_path, monkeypatch, capsys):
    from gapweave import cli
    from gapweave.sources import providers

    note, asked = tmp_path / "note.md", f"{tmp_path}/asked"
    note.write_text("# One\n\nalpha\n\nbeta\n\ngamma\n")

    def post(url, payload, headers):
        with open(asked, "a") as out:
            out.write(url.rsplit(":", 1)[1] + "\n")
        if "generateContent" in url:
            return {"candidates": [{"content": {"parts": [{"text": '{"boundaries": [1]}'}]}}]}
        return {"embeddings": [{"values": [1.0, float(len(r["content"]["parts"][0]["text"]))]} for r in payload["requests"]]}

    monkeypatch.setenv("GEMINI_API_KEY", "k")
    monkeypatch.setattr(cli, "http_post", post)
    batches = []
    for n in (1, 2):
        said = ["split", str(note), "--out", f"{tmp_path}/out{n}", "--llm-refine", "--cache", f"{tmp_path}/cache", "--json", "--jsonl", "-"]
        assert cli.main(said) == 0
        out = capsys.readouterr().out
        assert '"boundaries": [1]' in out and "segment_id" not in out
        batches.append(open(asked).read().split().count("batchEmbedContents"))
    assert batches[0] == batches[1] > 0 and providers.load_cache(spark, f"{tmp_path}/cache").count() == 4
