"""The command line over a small cache."""

import io

from cuewright.__main__ import main
from cuewright.shared import scratch_folder


def load():
    return lambda prompts: ["Steel [1]."] * len(prompts)


def test_index_ask_and_cache(spark, capsys, monkeypatch):
    monkeypatch.setenv("CUEWRIGHT_MIN_SCORE", "0.05")
    monkeypatch.setenv("CUEWRIGHT_RETRIEVER", "sparse")
    base, vid = scratch_folder(spark), "abcdefghijk"
    spark.createDataFrame([(vid, 0, 0.0, 4.0, "The bridge is made of steel.")], "video_id string, idx int, start_s double, duration_s double, text string").write.parquet(f"{base}/rows")
    spark.createDataFrame([(vid, "T", None, None, "en", "manual")], "video_id string, title string, channel string, duration_s double, language string, transcript_kind string").write.parquet(f"{base}/videos")
    run = lambda *a: main(["--folder", f"{base}/cache", *a], spark)
    assert run("index", "--captions", f"{base}/rows", "--videos", f"{base}/videos") == 0
    assert run("ask", f"https://youtu.be/{vid}", "What is the bridge made of?", "--model", "test_cli:load") == 0
    assert run("ask", vid, "qqq zzz yyy xxx", "--model", "test_cli:load") == 1
    assert run("cache", "stats") == 0
    out = capsys.readouterr().out
    assert "Steel [1]." in out and "0:00" in out and "segments: 1" in out
    assert run("cache", "clear", vid) == 0 and "segments: 0" in capsys.readouterr().out


def test_chat_draft_calibrate_eval_and_exit_codes(spark, capsys, monkeypatch, tmp_path):
    monkeypatch.setenv("CUEWRIGHT_MIN_SCORE", "0.05")
    monkeypatch.setenv("CUEWRIGHT_RETRIEVER", "sparse")
    base, vid = scratch_folder(spark), "abcdefghijk"
    spark.createDataFrame([(vid, 0, 0.0, 4.0, "The bridge is made of steel.")], "video_id string, idx int, start_s double, duration_s double, text string").write.parquet(f"{base}/rows")
    spark.createDataFrame([(vid, "T", None, None, "en", "manual")], "video_id string, title string, channel string, duration_s double, language string, transcript_kind string").write.parquet(f"{base}/videos")
    run = lambda *a: main(["--folder", f"{base}/cache", *a], spark)
    assert run("draft", vid, "Which bridge?") == 3
    assert run("index", "--captions", f"{base}/rows", "--videos", f"{base}/videos") == 0
    assert run("draft", "not a locator", "q") == 2 and run("cache", "empty") == 2
    assert run("draft", vid, "What is the bridge made of?") == 0
    assert "['0:00', '0:04']" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("/sources\nWhat is the bridge made of?\n/sources\n/debug\n/history\n/compare bridge\n/retriever odd\n/retriever hybrid\n/video\n/clear\n/history\n/help\n\n/exit\nnever asked\n"))
    assert run("chat", vid, "--model", "test_cli:load") == 0
    out = capsys.readouterr().out
    assert out.startswith("no answer yet\n") and "Steel [1]." in out and "confidence: " in out and "user: What is the bridge made of?" in out and "hybrid 1" in out
    assert "unknown retriever: odd" in out and "retriever: hybrid" in out and "passages: 1" in out and "forgotten" in out and "/compare QUESTION" in out and "never asked" not in out
    monkeypatch.setenv("CUEWRIGHT_RETRIEVER", "odd")
    assert run("ask", vid, "Which bridge?", "--model", "test_cli:load") == 7
    monkeypatch.setenv("CUEWRIGHT_RETRIEVER", "dense")
    monkeypatch.setenv("CUEWRIGHT_EMBEDDER", "odd")
    assert run("ask", vid, "Which bridge?", "--model", "test_cli:load") == 6
    monkeypatch.setenv("CUEWRIGHT_EMBEDDER", "hashing")
    monkeypatch.setenv("CUEWRIGHT_TOP_K", "many")
    assert run("cache", "stats") == 9
    monkeypatch.delenv("CUEWRIGHT_TOP_K")
    monkeypatch.setenv("CUEWRIGHT_RETRIEVER", "sparse")
    (tmp_path / "b.yaml").write_text("name: n\ncases:\n- {id: a, question: 'What is the bridge made of?', relevant_spans: [[0, 4]]}\n- {id: b, question: 'Quantum zeta?', answerable: false}\n")
    assert run("calibrate", str(tmp_path / "b.yaml"), vid) == 0
    assert "recommended" in capsys.readouterr().out
    assert run("eval", str(tmp_path / "b.yaml"), vid, "--out", f"{base}/out", "--retrievers", "sparse,hybrid") == 0
    out = capsys.readouterr().out
    assert "| sparse |" in out and "| hybrid |" in out
