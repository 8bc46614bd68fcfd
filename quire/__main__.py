"""python -m quire ingest FOLDER INDEX [--rebuild] | answer INDEX [QUESTION] [-i] | retrieve INDEX QUESTION | query NAME DATA_FOLDER"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from quire import registry
from quire.config import EngineConfig
from quire.operators import dialog
from quire.plans import answer, ingest, retrieve
from quire.session import clear, ship

TURN = "turn_id bigint, conv_id bigint, turn int, role string, content string, sources array<string>, unknown boolean"


def _asked(spark: SparkSession, found: retrieve.Corpus, history: list[tuple], question: str, config: EngineConfig):
    """Answers one question after the messages of a conversation."""
    turns = spark.createDataFrame([(i, 1, i, *t) for i, t in enumerate([*history, ("user", question, [], False)])], TURN)
    queries = dialog.conversation_queries(turns, config).filter(f"turn = {len(history)}").selectExpr("1L AS question_id", "position AS turn", "query")
    past = dialog.answers_from_history(turns, config).selectExpr("1L AS question_id", "answer", "sources") if history else None
    asked = spark.createDataFrame([(1, question)], "question_id bigint, question string")
    return answer.answers(found, asked, config, queries=queries, history=past).first()


def _corpus(spark: SparkSession, index: str, config: EngineConfig) -> retrieve.Corpus:
    blocks: DataFrame = ingest.indexed(spark, index)
    return retrieve.corpus(blocks, config=config)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("folder")
    one.add_argument("index")
    one.add_argument("--rebuild", action="store_true")
    for name in ("answer", "retrieve"):
        two = commands.add_parser(name)
        two.add_argument("index")
        two.add_argument("question", nargs="?" if name == "answer" else None)
        two.add_argument("-k", "--top-k", type=int)
        two.add_argument("-t", "--threshold", type=float)
    commands.choices["answer"].add_argument("-i", "--interactive", action="store_true")
    three = commands.add_parser("query")
    three.add_argument("name", choices=sorted(registry.queries()))
    three.add_argument("folder")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    config = EngineConfig.from_session(spark)
    if args.command == "ingest":
        print(ingest.ingest(spark, args.folder, args.index, args.rebuild, config), "chunks added")
    elif args.command == "query":
        registry.queries()[args.name](spark, args.folder).show(20, 80)
    else:
        config = replace(config, **{k: v for k, v in (("top_k", args.top_k), ("score_threshold", args.threshold)) if v is not None})
        found = _corpus(spark, args.index, config)
        if args.command == "retrieve":
            asked = spark.createDataFrame([(1, args.question)], "question_id bigint, question string")
            hits, _ = retrieve.retrieve(found, asked, config=config)
            hits.join(found.blocks, "block_id").orderBy("position").select("position", "source", "page", "tier", "path", "text").show(50, 60)
        else:
            history: list[tuple] = []
            question = args.question
            while question or args.interactive:
                if question:
                    got = _asked(spark, found, history, question, config)
                    print(got["answer"], *[f"  [{s}]" for s in got["sources"]], sep="\n")
                    history = [*history, ("user", question, [], False), ("assistant", got["answer"], got["sources"], got["unknown"])][-config.history_messages :]
                if not args.interactive:
                    break
                try:
                    question = input("> ").strip()
                except EOFError:
                    break
    clear(spark)


if __name__ == "__main__":
    main()
