"""Command line: index captions, ask about a video, look at the cache, evaluate a benchmark.

    python -m cuewright index --captions rows.parquet --videos videos.parquet
    python -m cuewright ask LOCATOR QUESTION --model package.module:load
    python -m cuewright chat LOCATOR --model package.module:load
    python -m cuewright cache stats | clear LOCATOR
    python -m cuewright eval BENCHMARK.yaml LOCATOR --out folder [--retrievers dense,sparse,hybrid] [--model package.module:load]
    python -m cuewright calibrate BENCHMARK.yaml LOCATOR
    python -m cuewright draft LOCATOR QUESTION

A model is a function without arguments that gives the function from prompts to replies. Exit codes: 0 done, 1 the
answer was a refusal, 2 wrong arguments, locators or benchmarks, 3 nothing indexed for the video, 5 a cache that
cannot be read, 6 vectors, 7 retrieval, 8 the model, 9 settings.
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NoTranscript, Problem
from .functions.scalars import format_timestamp, parse_locator, quote
from .operators.calibrate import best_threshold
from .plans import evaluate, index
from .plans.chat import ChatSession
from .plans.retrieve import retrieve
from .shared import materialize
from .shipping import named
from .sources import benchmarks, reports
from .sources.settings import Settings
from .sources.store import Store


def _video(spark: SparkSession, locator: str) -> str:
    found = spark.createDataFrame([(locator,)], "l string").select(parse_locator(F.col("l"))).first()[0]
    if found is None:
        raise Problem(f"no video in {locator!r}")
    return found


class _Index:
    """Passages and vectors of one indexed video."""

    def __init__(self, store: Store, video: str, settings: Settings) -> None:
        key = settings.packing.fingerprint()
        chunks = store.chunks(key).filter(F.col("video_id") == video)
        self.passages = chunks.select(F.col("video_id").alias("scope"), F.col("chunk_id").alias("passage_id"), "video_id", "start_s", "end_s", "text")
        self.vectors = store.embeddings(key, settings.model_id).filter(F.col("video_id") == video).select(F.col("chunk_id").alias("passage_id"), "vector")
        if self.passages.isEmpty():
            raise NoTranscript(f"nothing is indexed for {video}; run index first")


def _print_answer(told: dict) -> None:
    print(told["text"], *(f"[{c['marker']}] {c['timestamp']}  {c['url']}" for c in told["citations"]), sep="\n")


TALK = """/ask QUESTION (or the question alone), /sources and /debug of the last answer, /history, /retriever NAME,
/compare QUESTION, /video, /clear (forget what was said), /help, /exit"""


def _command(session: ChatSession, name: str, rest: str) -> None:
    told = session.told
    if name == "/ask" and rest:
        _print_answer(session.ask(rest))
    elif name == "/sources":
        print(*((f"[{c['marker']}] {c['timestamp']}  {c['url']}\n    {c['quote']}" for c in told["citations"]) if told else ["no answer yet"]), sep="\n")
    elif name == "/debug":
        print(*(f"{k}: {told[k]}" for k in ("search_text", "confidence", "refused", "layer")) if told else ["no answer yet"], sep="\n")
    elif name == "/history":
        print(*(f"{r.role}: {r.text}" for r in session.history().orderBy("turn").collect()), sep="\n")
    elif name in ("/retriever", "/change-retriever"):
        session.use(rest)
        print(f"retriever: {rest}")
    elif name == "/compare" and rest:
        rows = session.store.spark.createDataFrame(session.compare(rest)).select("retriever", "rank", "confidence", format_timestamp(F.col("start_s")).alias("at"), quote(F.col("text"), 70).alias("text"))
        print(*(f"{r.retriever} {r['rank'] + 1}  {r.confidence}  {r['at']}  {r.text}" for r in rows.collect()), sep="\n")
    elif name == "/video":
        held = session.store.table("videos", [session.video_id]).first()
        print(f"{held.title}\nchannel: {held.channel}\nseconds: {held.duration_s}\ncaptions: {held.transcript_kind} ({held.language})\ncues: {held.n_segments}\npassages: {session.passages()[0].count()}\nvectors: {session.settings.model_id}")
    elif name == "/clear":
        session.begin()
        print("forgotten")
    else:
        print(TALK)


def _chat(session: ChatSession) -> int:
    """Questions and commands from standard input, a line each; the end of the input, /exit or `quit` ends the talk."""
    for line in map(str.strip, sys.stdin):
        name, _, rest = line.partition(" ")
        if line == "quit" or name.lower() in ("/exit", "/quit", "/q"):
            break
        try:
            if line.startswith("/"):
                _command(session, name.lower(), rest.strip())
            elif line:
                _print_answer(session.ask(line))
        except Problem as problem:
            print(problem)
    return 0


def _draft(spark: SparkSession, index_: _Index, question: str, settings: Settings, k: int = 3) -> None:
    """A benchmark case to be checked by hand: the question with the spans of its best passages."""
    asked = spark.createDataFrame([(0, question)], "query_id long, text string")
    hits = retrieve("hybrid", index_.passages, asked, settings, index_.vectors).filter(F.col("rank") < k).join(index_.passages, "passage_id")
    rows = hits.orderBy("rank").select(format_timestamp(F.col("start_s")), format_timestamp(F.col("end_s")), F.round("confidence", 2), quote(F.col("text"), 70)).collect()
    print(f"- id: TODO\n  question: {question!r}\n  expected_answer: TODO\n  relevant_spans:", *(f"  - ['{a}', '{b}']  # confidence {c}, check: {t}" for a, b, c, t in rows), sep="\n")


COMMANDS = {
    "index": ["--captions", "--videos"], "ask": ["locator", "question", "--model"], "chat": ["locator", "--model"], "cache": ["action"],
    "eval": ["benchmark", "locator", "--out"], "calibrate": ["benchmark", "locator"], "draft": ["locator", "question"],
}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("cuewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--folder")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a, **({"required": True} if a.startswith("--") else {}))
        if name == "cache":
            sub.add_argument("locator", nargs="?")
        if name == "index":
            sub.add_argument("--force", action="store_true")
        if name == "eval":
            sub.add_argument("--model")
            sub.add_argument("--retrievers", default="dense,sparse,hybrid")
    return parser.parse_args(argv)


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    settings = Settings.load(folder=args.folder)
    store = Store(spark, settings.folder)
    if args.command == "index":
        print(index.ensure_indexed(store, spark.read.parquet(args.videos), spark.read.parquet(args.captions), settings, args.force))
        return 0
    if args.command == "cache":
        if args.action not in ("stats", "clear") or (args.action == "clear") != bool(args.locator):
            raise Problem("cache takes stats, or clear and a locator")
        if args.action == "clear":
            store.clear(spark.createDataFrame([(_video(spark, args.locator),)], "video_id string"))
        print(*(f"{r.table_name}: {r.n}" for r in store.stats().collect()), sep="\n")
        return 0
    video = _video(spark, args.locator)
    held = _Index(store, video, settings)
    if args.command in ("ask", "chat"):
        session = ChatSession(store, video, named(args.model), settings)
        if args.command == "chat":
            return _chat(session)
        told = session.ask(args.question)
        _print_answer(told)
        return 1 if told["refused"] else 0
    if args.command == "draft":
        _draft(spark, held, args.question, settings)
        return 0
    cases = benchmarks.read_benchmark(spark, args.benchmark)
    if args.command == "calibrate":
        sweep = materialize(evaluate.calibrate(evaluate.evaluate(settings.retriever, cases, held.passages, settings, held.vectors)))
        best = best_threshold(sweep).first()
        print(*(f"{r.threshold:.2f}  correct refusal {r.correct_refusal_rate or 0:.2f}  false refusal {r.false_refusal_rate or 0:.2f}" for r in sweep.orderBy("threshold").collect()), sep="\n")
        print(f"recommended CUEWRIGHT_MIN_SCORE={best.threshold:.2f}" if best else "no threshold")
        return 0
    load = named(args.model) if args.model else None
    results = materialize(reduce(DataFrame.unionByName, (evaluate.evaluate(n.strip(), cases, held.passages, settings, held.vectors, load) for n in args.retrievers.split(","))))
    reports.write_csv(results, args.out)
    print(reports.markdown(results, evaluate.calibrate(results)))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("cuewright").getOrCreate()
    try:
        return _run(args, spark)
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return getattr(problem, "code", 2)


if __name__ == "__main__":
    sys.exit(main())
