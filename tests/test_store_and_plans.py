"""Cache, staged indexing, chat, evaluation, files and streams."""

import pytest
from pyspark.sql import functions as F

from cuewright.operators import answers, cases, dense, metrics
from cuewright.plans import evaluate, index
from cuewright.plans.chat import ChatSession
from cuewright.shared import scratch_folder
from cuewright.sources import benchmarks, captions, reports
from cuewright.sources.settings import Settings
from cuewright.sources.store import Store
from cuewright.streaming import cues as stream

ROWS = "video_id string, idx int, start_s double, duration_s double, text string"
VIDEOS = "video_id string, title string, channel string, duration_s double, language string, transcript_kind string"
SETTINGS = Settings(max_chars=80, overlap_chars=20, min_chars=20, dim=64, top_k=2, min_score=0.05, retriever="sparse")


def talk(spark, second=" Then came spring."):
    texts = ["The bridge is made of steel.", "It was built in winter." + second, "Many ships pass the bridge.", "Ships carry grain and coal."]
    rows = [(v, i, 4.0 * i, 4.0, t) for v in ("a", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([(v, v.upper(), None, None, "en", "manual") for v in ("a", "b")], VIDEOS), spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def store(spark):
    out = Store(spark, scratch_folder(spark), 2)
    videos, rows = talk(spark)
    assert index.ensure_indexed(out, videos, rows, SETTINGS) == {"transcripts": 2, "passages": 2, "vectors": 2}
    return out


def test_stages_do_only_what_is_missing(spark, store):
    videos, rows = talk(spark)
    assert index.ensure_indexed(store, videos, rows, SETTINGS) == {"transcripts": 0, "passages": 0, "vectors": 0}
    other = Settings(**{**SETTINGS.__dict__, "max_chars": 60})
    assert index.ensure_indexed(store, videos, rows, other) == {"transcripts": 0, "passages": 2, "vectors": 2}
    wide = Settings(**{**SETTINGS.__dict__, "dim": 32})
    assert index.ensure_indexed(store, videos, rows, wide) == {"transcripts": 0, "passages": 0, "vectors": 2}
    before = {r.table_name: r.n for r in store.stats().collect()}
    assert index.ensure_indexed(store, videos.filter("video_id = 'a'"), rows, SETTINGS, force=True) == {"transcripts": 1, "passages": 1, "vectors": 1}
    after = {r.table_name: r.n for r in store.stats().collect()}
    assert after["segments"] == before["segments"] and after["chunk_sets"] == before["chunk_sets"] - 1 and after["embedding_sets"] == before["embedding_sets"] - 2


def test_vectors_are_read_with_their_passages(store):
    from cuewright.operators import embed

    got = store.embeddings(SETTINGS.packing.fingerprint(), embed.model_id("hashing", 64)).collect()
    assert got and all(len(r.vector) == 64 and abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in got)


def test_version_mismatch_is_an_error(spark):
    folder = scratch_folder(spark)
    spark.createDataFrame([(99, 1)], "version int, parts int").write.parquet(f"{folder}/_version")
    with pytest.raises(ValueError, match="version 99"):
        Store(spark, folder)


def test_chat_remembers_and_cites(store):
    script = ["stands alone -> What is the bridge made of?", "made of? -> Steel [1].", "Steel [9]."]
    chat = ChatSession(store, "a", answers.scripted(script), SETTINGS)
    first = chat.ask("What is the bridge made of?")
    assert first["text"] == "Steel [1]." and not first["refused"] and [c["marker"] for c in first["citations"]] == [1]
    second = chat.ask("Why?")
    assert second["search_text"] == "What is the bridge made of?" and second["layer"] == "C" and second["text"] == answers.REFUSAL
    assert chat.history().count() == 4
    assert chat.ask("zzz qqq xxx yyy")["layer"] == "A"


def test_evaluation_with_a_model(spark, store):
    chunks = store.chunks(SETTINGS.packing.fingerprint()).filter("video_id = 'b'")
    own = chunks.select(F.lit("b").alias("scope"), F.col("chunk_id").alias("passage_id"), "video_id", "start_s", "end_s", "text")
    rows = [("t", "c1", "What is the bridge made of?", "steel", True, ["x"], None, [(0.0, 4.0)], 1), ("t", "c2", "Quantum qubits zeta?", None, False, [], None, [], 0)]
    asked = spark.createDataFrame(rows, benchmarks.CASES)
    script = ['Reply {"faithfulness" -> {"faithfulness": 0.75, "correctness": 0.5, "reason": "r"}', "Steel [1]."]
    got = evaluate.evaluate("sparse", asked, own, SETTINGS, load=answers.scripted(script))
    by = {r.case_id: r for r in got.collect()}
    assert by["c1"].recall_at_k == 1 and not by["c1"].refused and by["c1"].correctness == 0.5 and by["c1"].citation_hit_rate == 1
    assert by["c2"].refused and by["c2"].faithfulness == 1 and by["c2"].correctness is None and by["c2"].top_confidence == 0
    path = scratch_folder(spark)
    reports.write_csv(got, path)
    back = reports.read_csv(spark, [path, path + "-missing"]).collect()
    assert {(r.case_id, r.refused, r.correctness) for r in back} == {("c1", False, 0.5), ("c2", True, None)}
    text = reports.markdown(got, evaluate.calibrate(got))
    assert "## Retrievers" in text and "| sparse |" in text


def test_benchmark_file(spark, tmp_path):
    good = tmp_path / "good.yaml"
    good.write_text("name: n\ncases:\n- {id: a, question: q, relevant_spans: [['0:40', 1:35], '2:00-2:30', {start: 5, end: 6}]}\n- {id: b, question: r, answerable: false, followup_to: a}\n")
    got = benchmarks.read_benchmark(spark, str(good)).orderBy("case_id").collect()
    assert [tuple(s) for s in got[0].spans] == [(40.0, 95.0), (120.0, 150.0), (5.0, 6.0)] and got[1].followup_to == "a"
    bad = tmp_path / "bad.yaml"
    bad.write_text("name: n\ncases:\n- {id: a, question: q}\n- {id: a, question: q, answerable: false, relevant_spans: [[1, 2]], followup_to: z}\n")
    with pytest.raises(ValueError, match="duplicate id.*unanswerable with spans.*unknown follow-up"):
        benchmarks.read_benchmark(spark, str(bad))
    with pytest.raises(ValueError, match="before it begins"):
        benchmarks.span([3, 2])


def test_settings_order():
    env = {"CUEWRIGHT_TOP_K": "7", "CUEWRIGHT_RERANK": "true", "CUEWRIGHT_LANGUAGES": "de, fr"}
    got = Settings.load(env, top_k=None, alpha=0.2)
    assert (got.top_k, got.rerank, got.languages, got.alpha) == (7, True, ("de", "fr"), 0.2)


def test_settings_of_a_file(tmp_path):
    held = tmp_path / ".env"
    held.write_text("# mine\nCUEWRIGHT_TOP_K = 9\nexport CUEWRIGHT_ALPHA='0.25'\nCUEWRIGHT_RETRIEVER=dense # not hybrid\nOTHER=x\nnot a line\nCUEWRIGHT_FOLDER=\"a # b\"\nCUEWRIGHT_RRF_K=1\nCUEWRIGHT_RRF_K=2\n")
    got = Settings.load({"CUEWRIGHT_TOP_K": "7"}, str(held), min_score=0.5)
    assert (got.top_k, got.alpha, got.retriever, got.folder, got.rrf_k, got.min_score) == (7, 0.25, "dense", "a # b", 2, 0.5)
    assert Settings.load({}, str(tmp_path / "none")) == Settings()
    with pytest.raises(ValueError, match="CUEWRIGHT_DIM"):
        Settings.load({"CUEWRIGHT_DIM": "wide"}, None)


def test_cycles_have_no_depth(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "nowhere")]
    got = {r.case_id: r.depth for r in cases.with_depth(spark.createDataFrame(rows, "case_id string, followup_to string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_long_conversations_keep_their_order(spark):
    turns = 300
    rows = [(f"t{i}", f"t{i - 1}" if i else None) for i in range(turns)] + [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("tail", "c0"), ("lost", "nowhere"), ("branch", "t40"), ("after lost", "lost")]
    got = {r.case_id: r.depth for r in cases.with_depth(spark.createDataFrame(rows, "case_id string, followup_to string")).collect()}
    assert got == {f"t{i}": i for i in range(turns)} | {f"c{i}": None for i in range(5)} | {"tail": None, "lost": None, "branch": 41, "after lost": None}


def test_unknown_kind_is_an_error(spark):
    with pytest.raises(Exception, match="unknown kind"):
        captions.prefer_track(spark.createDataFrame([("v", "en", "odd")], "video_id string, language string, kind string")).collect()


def test_dense_edges(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-2.0, 0.0]), (5, [3.0, 0.0])], "passage_id long, vector array<float>")
    probe = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.passage_id, r.score, r["rank"]) for r in dense.retrieve(vectors, probe, 9).orderBy("rank").collect()] == [(1, 1.0, 0), (5, 1.0, 1), (2, 0.0, 2), (4, -1.0, 3)]
    assert dense.retrieve(vectors, probe, 0).count() == 0 and dense.retrieve(vectors, probe.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="numbers"):
        dense.retrieve(vectors, spark.createDataFrame([(9, [1.0])], "query_id long, vector array<float>"), 1).collect()


def test_ndcg_is_at_most_one(spark):
    judged = spark.createDataFrame([("c", i, i % 3 == 0) for i in range(9)], "case_id string, rank int, relevant boolean")
    row = metrics.ranking_scores(judged, spark.createDataFrame([("c",), ("none",)], "case_id string"), 5).orderBy("case_id").collect()
    assert 0 < row[0].ndcg_at_k <= 1 and row[0].mrr == 1 and row[1].ndcg_at_k == 0


def test_queue_skips_finished_jobs(spark, tmp_path):
    jobs, done = str(tmp_path / "jobs"), []
    spark.createDataFrame([("a",), ("b",), ("b",)], "job_id string").write.parquet(jobs)
    finished = lambda: spark.createDataFrame([("a",)], "job_id string")
    run = stream.run_queue(spark.readStream.schema("job_id string").parquet(jobs), finished, lambda part: done.extend(r.job_id for r in part.collect()), str(tmp_path / "at"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert done == ["b"]


def some_segments(spark):
    videos, rows = talk(spark)
    return videos, rows.select("video_id", "idx", "start_s", (F.col("start_s") + F.col("duration_s")).alias("end_s"), "text")


def test_a_replacement_that_broke_off_changes_nothing(spark, monkeypatch):
    folder = scratch_folder(spark)
    videos, segments = some_segments(spark)
    first = Store(spark, folder, 4)
    first.save_videos(videos, segments)
    before = {r.table_name: r.n for r in first.stats().collect()}
    monkeypatch.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("the machine stopped")))
    with pytest.raises(OSError):
        first.save_videos(videos, segments.withColumn("text", F.upper("text")))
    monkeypatch.undo()
    again = Store(spark, folder)
    assert {r.table_name: r.n for r in again.stats().collect()} == before
    assert not any(r.text == r.text.upper() for r in again.read("segments").collect())
    assert again.vacuum(0) == 0 and {r.table_name: r.n for r in again.stats().collect()} == before
    assert len(again._names(f"{folder}/segments")) == 1  # what the broken run wrote is gone


def test_readers_see_old_or_new_and_tables_change_together(spark):
    folder = scratch_folder(spark)
    videos, segments = some_segments(spark)
    own = Store(spark, folder, 2)
    own.save_videos(videos, segments)
    old, at = own.read("segments"), own.version()
    own.save_videos(videos.withColumn("title", F.lit("new")), segments.filter("idx < 2").withColumn("text", F.lit("new")))
    assert old.count() == 8 and "new" not in {r.text for r in old.collect()}
    assert own.read("videos", at).filter("title = 'new'").count() == 0 and own.read("segments", at).count() == 8
    assert {r.text for r in own.read("segments").collect()} == {"new"} and {r.title for r in own.read("videos").collect()} == {"new"}
    assert own.vacuum(3600) == 0 and old.count() == 8
    assert own.vacuum(0) == 1 and own.read("segments").count() == 4
    with pytest.raises(Exception):
        old.count()


def test_two_writers(spark):
    folder = scratch_folder(spark)
    videos, segments = some_segments(spark)
    own, other = Store(spark, folder, 1), Store(spark, folder)
    own.save_videos(videos, segments)
    runs = []

    def change(c):
        runs.append(1)
        if len(runs) == 1:  # another writer is faster: it adds to a table that this one does not touch, and changes one that it does
            other.append("conversations", spark.createDataFrame([("a", "c")], "video_id string, conversation_id string"))
            other.replace("segments", segments.filter("video_id = 'a' AND idx = 0"), videos.filter("video_id = 'a'"), ["video_id"])
        c.replace("segments", segments.filter("video_id = 'b' AND idx < 2"), videos.filter("video_id = 'b'"), ["video_id"])

    own.commit(change)
    assert len(runs) == 2
    assert {(r.video_id, r.idx) for r in own.read("segments").collect()} == {("a", 0), ("b", 0), ("b", 1)}
    assert own.read("conversations").count() == 1
    runs.clear()

    def append(c):
        runs.append(1)
        other.append("messages", spark.createDataFrame([("a", "c", 1, "user", "x", None)], "video_id string, conversation_id string, message_id long, role string, content string, citations string"))
        c.append("conversations", spark.createDataFrame([("b", "d")], "video_id string, conversation_id string"))

    own.commit(append)  # what is only added goes on top of the other's version
    assert len(runs) == 1 and own.read("conversations").count() == 2 and own.read("messages").count() == 1


def test_videos_without_passages_keep_none(spark):
    own = Store(spark, scratch_folder(spark), 2)
    videos, rows = talk(spark)
    index.ensure_indexed(own, videos, rows, SETTINGS)
    assert own.chunks(SETTINGS.packing.fingerprint()).filter("video_id = 'a'").count() > 0
    own.save_chunks(own.chunks(SETTINGS.packing.fingerprint()).filter("video_id = 'b'").drop("chunk_set_id", "chunk_id"), SETTINGS.packing.fingerprint(), videos)
    assert {r.video_id for r in own.chunks(SETTINGS.packing.fingerprint()).collect()} == {"b"}


def test_many_rows_of_one_part_get_several_writers(spark):
    store = Store(spark, scratch_folder(spark), 1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store.append("segments", spark.range(60_000).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), F.sha2(F.col("id").cast("string"), 256).alias("text")))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert store.read("segments").select(F.input_file_name()).distinct().count() > 4


def test_cached_transcripts(spark, store):
    videos, rows = talk(spark)
    own = Store(spark, scratch_folder(spark), 2)
    own.save_videos(videos.withColumn("language", F.lit(None).cast("string")), rows.select("video_id", "idx", "start_s", (F.col("start_s") + F.col("duration_s")).alias("end_s"), "text").orderBy(F.col("idx").desc()))
    got = [(r.language, r.idx, r.duration_s) for r in own.transcript(["a"]).collect()]
    assert got == [("en", i, 4.0) for i in range(4)]


def test_cached_vectors_of_another_width_are_an_error(spark):
    own = Store(spark, scratch_folder(spark), 2)
    own.append("embedding_sets", spark.createDataFrame([("v", 1, 2, "m", 3)], "video_id string, chunk_set_id long, embedding_set_id long, model_id string, dim int"))
    own.append("embeddings", spark.createDataFrame([("v", 2, 5, [1.0])], "video_id string, embedding_set_id long, chunk_id long, vector array<float>"))
    own.append("chunk_sets", spark.createDataFrame([("v", 1, "f", 1)], "video_id string, chunk_set_id long, fingerprint string, n_chunks int"))
    own.append("chunks", spark.createDataFrame([("v", 1, 5, 0, "t", 0.0, 1.0, 0, 0, 1)], "video_id string, chunk_set_id long, chunk_id long, idx int, text string, start_s double, end_s double, seg_start int, seg_end int, n_chars int"))
    with pytest.raises(Exception, match="width"):
        own.embeddings("f", "m").collect()


def test_dense_in_passes_equals_one_pass(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "passage_id long, vector array<double>").repartition(5)
    asked = vectors.filter("passage_id % 10 = 0").withColumnRenamed("passage_id", "query_id")
    rows = lambda df: sorted((r.query_id, r["rank"], r.passage_id, r.score) for r in df.collect())
    one, many = rows(dense.retrieve(vectors, asked, 7)), rows(dense.retrieve(vectors, asked, 7, block_bytes=100))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, dense.DIGITS)
    want = sorted((q, k, int(p), float(near[q, p])) for q in range(0, 300, 10) for k, p in enumerate(np.lexsort((np.arange(300), -near[q]))[:7]))
    assert one == many and [r[:3] for r in one] == [r[:3] for r in want]


def test_dense_hands_on_k_rows_of_a_task(spark):
    vectors = spark.range(0, 5000, 1, 2).select(F.col("id").alias("passage_id"), F.array(F.rand(1), F.rand(2)).alias("vector"))
    asked = [(1, [1.0, 0.5]), (2, [0.2, 0.9])]
    import numpy as np

    got = dense._one_pass(vectors, [a for a, _ in asked], np.array([v for _, v in asked]), 4)
    assert got.count() == 2 * 2 * 4


def replying(spark, rows, reply, **more):
    """The rows of call_model over (id, prompt) with a model made of reply(prompts)."""
    df = spark.createDataFrame(rows, "id int, prompt string").coalesce(1)
    got = answers.call_model(df, "prompt", lambda: reply, "reply", failure="failure", took_ms="ms", patience=answers.Patience(3, 0.01, 0.02), **more)
    return {r.id: (r.reply, r.failure) for r in got.collect()}


def test_a_failing_prompt_costs_no_other_its_reply(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("invalid request")
        return [p.upper() for p in prompts]

    got = replying(spark, [(1, "a"), (2, "bad"), (3, None), (4, "b")], model)
    assert got == {1: ("A", None), 2: (None, "ValueError invalid request"), 3: (None, None), 4: ("B", None)}


def test_passing_failures_are_tried_again_and_others_not():
    calls = []

    def model(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise OSError("503 overloaded")
        return ["ok"] * len(prompts)

    caller = answers._Caller(model, answers.Patience(3, 0.001, 0.002))
    assert caller.replies(["p", "q"]) == [("ok", None)] * 2 and calls == [2, 2, 2]
    spent = []

    def exhausted(prompts):
        spent.append(1)
        raise OSError("rate limit: tokens per day")

    assert answers._Caller(exhausted, answers.Patience(3, 0.001)).replies(["p", "q"]) == [(None, "OSError rate limit: tokens per day")] * 2 and len(spent) == 1


def test_a_rewrite_that_fails_searches_for_the_question(spark):
    def load():
        def model(prompts):
            raise RuntimeError("no such model")

        return model

    questions = spark.createDataFrame([(1, "c", "Why?")], "question_id long, conversation_id string, text string")
    history = spark.createDataFrame([("c", "User: x")], "conversation_id string, history string")
    row = answers.rewrite(questions, history, load).first()
    assert (row.search_text, row.was_rewritten) == ("Why?", False)


GIVEN = "question_id long, question string, context string, text string, refused boolean, expected string"


@pytest.mark.parametrize("combined", [True, False])
def test_judgements(spark, combined):
    rows = [(1, "q", "c", "good", False, "e"), (2, "q", "c", "none", True, None), (3, "q", "c", "odd", False, "e"), (4, "q", "c", "down", False, "e")]

    def load():
        def model(prompts):
            if any("ANSWER:\ndown" in p for p in prompts):
                raise RuntimeError("gone")
            told = '{"faithfulness": 7, "answer_relevance": 0.25, "context_relevance": null, "correctness": 0.5, "reason": "so"}' if combined else '{"score": 0.25, "reason": "so"}'
            return ["what?" if "ANSWER:\nodd" in p else told for p in prompts]

        return model

    got = {r.question_id: r for r in answers.judge(spark.createDataFrame(rows, GIVEN).coalesce(1), load, combined).collect()}
    assert (got[1].faithfulness, got[1].answer_relevance, got[1].correctness) == ((1.0, 0.25, 0.5) if combined else (0.25, 0.25, 0.25)) and got[1].reasons["correctness"] == "so"
    assert got[2].faithfulness == 1 and got[2].correctness is None and "refusal" in got[2].reasons["faithfulness"]
    assert (got[3].faithfulness, got[3].correctness) == (0, 0) and "what?" in got[3].reasons["faithfulness"]
    assert (got[4].faithfulness, got[4].answer_relevance, got[4].correctness) == (0, 0, 0) and "no judgement: RuntimeError gone" in got[4].reasons["answer_relevance"]


def test_follow_ups_are_asked_with_their_history(spark, store):
    chunks = store.chunks(SETTINGS.packing.fingerprint()).filter("video_id = 'b'")
    own = chunks.select(F.lit("b").alias("scope"), F.col("chunk_id").alias("passage_id"), "video_id", "start_s", "end_s", "text")
    rows = [("t", "c3", "And then?", None, True, [], "c2", [(0.0, 4.0)], 1), ("t", "c2", "Why that?", None, True, [], "c1", [(0.0, 4.0)], 1), ("t", "c1", "What is the bridge made of?", "steel", True, ["x"], None, [(0.0, 4.0)], 1), ("t", "d1", "Why that?", None, True, [], None, [(0.0, 4.0)], 1)]
    script = ['Reply {"faith -> {"faithfulness": 1}', "User: What is the bridge made of? -> bridge steel", "stands alone -> nothing of use zzz", "Steel [1]."]
    got = {r.case_id: r for r in evaluate.evaluate("sparse", spark.createDataFrame(rows, benchmarks.CASES), own, SETTINGS, load=answers.scripted(script)).collect()}
    assert not got["c1"].refused and not got["c2"].refused and not got["c3"].refused and got["c3"].recall_at_k == 1
    assert got["d1"].refused and got["c1"].latency_ms >= 0 and got["d1"].latency_ms is None
    alone = {r.case_id: r for r in evaluate.evaluate("sparse", spark.createDataFrame(rows, benchmarks.CASES), own, SETTINGS).collect()}
    assert alone["c2"].top_confidence == 0 and alone["c2"].latency_ms is None


def test_sizes_of_passages_with_what_retrieval_reaches(spark):
    from cuewright.operators import timeline

    videos, rows = talk(spark)
    line = timeline.spans(rows.withColumn("end_s", F.col("start_s") + F.col("duration_s")))
    asked = spark.createDataFrame([("t", "c1", "Many ships pass", None, True, [], None, [(8.0, 12.0)], 1), ("t", "c2", "zeta", None, False, [], None, [], 0)], benchmarks.CASES)
    got = {(r.max_chars, r.retriever): r for r in evaluate.sweep_retrieval(line, asked, SETTINGS, (30, 1500)).collect()}
    assert set(got) == {(30, "dense"), (30, "hybrid"), (1500, "dense"), (1500, "hybrid")}
    assert got[1500, "dense"].n_passages == 2 and got[1500, "dense"].mean_s == 16 and got[1500, "dense"].citation_iou == pytest.approx(0.25)
    assert got[30, "hybrid"].recall_at_k == 1 and got[30, "hybrid"].citation_iou > 0.25


def test_passage_iou(spark):
    hits = spark.createDataFrame([("a", 0, 0.0, 4.0), ("a", 1, 10.0, 14.0), ("b", 0, 0.0, 1.0)], "case_id string, rank int, start_s double, end_s double")
    spans = spark.createDataFrame([("a", 0.0, 4.0), ("a", 2.0, 6.0)], "case_id string, gold_start double, gold_end double")
    cases_ = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert {r.case_id: r.citation_iou for r in metrics.passage_iou(hits, spans, cases_).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}


def letters():
    """A small model: shares of letters, and how the text begins."""
    import numpy as np

    return lambda texts: np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] + [10.0 * t.startswith("query: "), 10.0 * t.startswith("passage: ")] for t in texts])


def test_a_real_model_is_wired_with_its_prefixes(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    settings = Settings(**{**SETTINGS.__dict__, "embedder": "model", "embedding_model": "some/e5-small", "embedding_loader": f"{__name__}:letters", "dim": 28, "retriever": "dense"})
    own = Store(spark, scratch_folder(spark), 2)
    videos, rows = talk(spark)
    assert index.ensure_indexed(own, videos, rows, settings)["vectors"] == 2
    held = own.embeddings(settings.packing.fingerprint(), settings.model_id).collect()
    assert held and all(r.vector[27] > 0 and r.vector[26] == 0 and abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in held)
    query = settings.embed(spark.createDataFrame([(1, "bridge")], "passage_id long, text string"), query=True).first()
    assert query.vector[26] > 0 and query.vector[27] == 0
    other = Settings(**{**settings.__dict__, "embedding_model": "other/plain"})
    assert other.model_id != settings.model_id and "plain" in other.model_id
    with pytest.raises(ValueError, match="loader"):
        Settings(embedder="model").embed(spark.createDataFrame([], "passage_id long, text string"))


def test_given_rows_stand_in_for_sources(spark):
    schema = "video_id string, language string, kind string"
    first = benchmarks.static_rows(spark, [("v", "en", "manual")], schema)
    second = benchmarks.static_rows(spark, [("v", "de", "generated"), ("w", "de", "generated")], schema)
    got = captions.first_available([first, second])
    assert {(r.video_id, r.language) for r in got.collect()} == {("v", "en"), ("w", "de")}


def test_a_cross_encoder_ranks_anew(spark):
    import pandas as pd
    from pyspark.sql import types as T

    from cuewright.operators import rerank

    @F.pandas_udf(T.DoubleType())
    def longer(query: pd.Series, passage: pd.Series) -> pd.Series:
        return passage.str.len() - query.str.len() * 1.0

    hits = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.8, 1), (1, 12, 0.7, 2)], "query_id long, passage_id long, score double, rank int")
    texts = spark.createDataFrame([(10, "ab"), (11, "abcd"), (12, "abc")], "passage_id long, text string")
    got = rerank.rerank(hits, spark.createDataFrame([(1, "ab")], "query_id long, text string"), texts, 2, 3, longer).orderBy("rank").collect()
    assert [(r.passage_id, r.score, r.base_rank) for r in got] == [(11, 2.0, 1), (12, 1.0, 2)] and got[0].confidence == pytest.approx(1 / (1 + 2.718281828**-2), 1e-6)


def test_track_files(spark, tmp_path):
    from cuewright.sources import tracks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "abc.en-US.vtt").write_text("WEBVTT - talk\r\n\r\nNOTE 00:01 --> nothing\r\n\r\nSTYLE\r\n::cue {}\r\n\r\n1\r\n00:01.500 --> 00:03.000 align:start\r\nOne\r\ntwo\r\n\r\n\r\n1:00:00.000 --> 1:00:01.250\r\nlate\r\n")
    (tmp_path / "in" / "x.y.de.generated.srt").write_text("1\n00:00:00,000 --> 00:00:02,000\nHallo\n\n2\n00:00:02,000 --> 00:00:02,500\n\n")
    (tmp_path / "in" / "empty.en.vtt").write_text("WEBVTT\n")
    want = [("abc", "en-US", "unknown", 0, 1.5, 1.5, "One\ntwo"), ("abc", "en-US", "unknown", 1, 3600.0, 1.25, "late"), ("x.y", "de", "generated", 0, 0.0, 2.0, "Hallo"), ("x.y", "de", "generated", 1, 2.0, 0.5, "")]
    clean = lambda df: sorted((*tuple(r)[:-1], r.text.strip()) for r in df.collect())
    assert clean(tracks.read_tracks(spark, str(tmp_path / "in"), flat=True)) == want
    query = tracks.read_tracks(spark, str(tmp_path / "in"), flat=True, stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert clean(spark.read.parquet(f"{tmp_path}/out")) == want
    cues = spark.createDataFrame([("v 1", "en", "manual", 0, 0.0, 1.0, "a\n\n\nb"), ("v 1", "en", "manual", 1, 359999.0, 360001.0016, None), ("v 1", "de", "manual", 0, 5.0, 6.0, "c")], "video_id string, language string, kind string, idx int, start_s double, end_s double, text string")
    tracks.write_tracks(cues, f"{tmp_path}/made")
    back = tracks.read_tracks(spark, f"{tmp_path}/made")
    assert clean(back) == [("v 1", "de", "manual", 0, 5.0, 1.0, "c"), ("v 1", "en", "manual", 0, 0.0, 1.0, "a\nb"), ("v 1", "en", "manual", 1, 359999.0, 2.002, "")]
    assert "PartitionFilters: [isnotnull(language" in back.filter("language = 'de'")._jdf.queryExecution().executedPlan().toString()


def test_indexing_makes_passages_once(spark, tmp_path, monkeypatch):
    made, pack = spark.sparkContext.accumulator(0), index.passages_of

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(index, "passages_of", lambda *a: (lambda df: df.mapInArrow(seen, df.schema))(pack(*a)))
    store = Store(spark, f"file://{tmp_path}/cache")
    videos = spark.createDataFrame([("v", "t")], "video_id string, title string").selectExpr("*", "CAST(NULL AS string) channel", "CAST(NULL AS double) duration_s", "'en' language", "'manual' transcript_kind")
    rows = spark.createDataFrame([("v", i, 2.0 * i, 2.0, f"sentence number {i} ends here.") for i in range(200)], "video_id string, idx int, start_s double, duration_s double, text string")
    index.ensure_indexed(store, videos, rows)
    assert made.value == store.read("chunks").count() > 5
