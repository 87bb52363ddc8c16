"""Commands: python -m quarry.plans.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json
import os

from quarry.operators.answers import extractive_generator
from quarry.plans import index as plans


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, object]) -> None:
        c = sub.add_parser(name)
        for option, default in options:
            c.add_argument(f"--{option}", type=type(default) if default is not None else str, default=default, required=default is None)

    where = ("index_dir", "data/index")
    command("index", ("max_chunk_size", 2000), ("raw_dir", "data/raw"), ("root", ""), where)
    command("index_incremental", ("max_chunk_size", 2000), ("raw_dir", "data/raw"), ("root", ""), where)
    command("index_semantic", where)
    for name in ("search", "search_hybrid"):
        command(name, ("query", None), ("k", 5), where, ("cache_dir", ""))
    for name in ("search_dataset", "search_hybrid_dataset"):
        command(name, ("dataset_path", None), ("k", 10), ("save_directory", "data/results"), where)
    command("answer", ("query", None), ("k", 5), where)
    command("answer_dataset", ("results_path", None), ("save_directory", "data/answers"), where)
    command("evaluate", ("results_path", None), ("dataset_path", None))
    command("serve", ("host", "127.0.0.1"), ("port", 8000), where)
    return p


def run(argv: list[str] | None = None, spark=None) -> int:
    """Paths of files are kept relative to --root, or else to the working directory, when they lie below it."""
    a = parser().parse_args(argv)
    spark = spark or session()
    try:
        if a.command == "index":
            plans.index(spark, a.raw_dir, a.index_dir, a.max_chunk_size, a.root or os.getcwd())
            print(f"Indexed {plans.load(spark, a.index_dir).lexical.chunks.count()} chunks")
        elif a.command == "index_incremental":
            print(json.dumps(plans.index_incremental(spark, a.raw_dir, a.index_dir, a.max_chunk_size, a.root or os.getcwd())[1]))
        elif a.command == "index_semantic":
            print(f"Embedded {plans.index_semantic(spark, a.index_dir)} chunks")
        elif a.command in ("search", "search_hybrid"):
            if not a.query.strip() or a.k <= 0:
                raise ValueError("the query must not be blank and k must be positive")
            for s in plans.search(spark, a.query, a.k, a.index_dir, a.command == "search_hybrid", cache_dir=a.cache_dir or None):
                print(f"{s['file_path']} [{s['first_character_index']}:{s['last_character_index']}]")
        elif a.command in ("search_dataset", "search_hybrid_dataset"):
            print("Saved", plans.search_dataset(spark, a.dataset_path, a.save_directory, a.index_dir, a.k, a.command == "search_hybrid_dataset"))
        elif a.command == "answer":
            print(plans.answer(spark, a.query, extractive_generator(), a.k, a.index_dir)["answer"])
        elif a.command == "answer_dataset":
            print("Saved", plans.answer_dataset(spark, a.results_path, a.save_directory, a.index_dir, extractive_generator()))
        elif a.command == "evaluate":
            for k, recall in plans.evaluate_results(spark, a.results_path, a.dataset_path).items():
                print(f"Recall@{k}: {recall:.3f}")
        else:
            from quarry.plans.server import serve

            serve(spark, a.index_dir, a.host, a.port)
    except (FileNotFoundError, ValueError) as e:
        print(f"Error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
