"""python -m lodestar.cli COMMAND DIR: evaluations over the tables of a folder, printed as JSON lines; ``load`` makes an index of them and ``embed`` fills an embedding cache."""

from __future__ import annotations

import argparse
import json
import os
import shlex

from pyspark.sql import SparkSession

from lodestar.operators.embedcache import Batches, Child, EmbeddingCache, LocalHash, Ollama, OpenAI
from lodestar.operators.segments import Index
from lodestar.plans.engine import BOOSTS
from lodestar.sources import corpora

COMMANDS = {
    "evaluate": ["metrics_aggregate", "failure_groups", "failure_examples"],
    "compare": ["metric_deltas", "group_deltas", "query_deltas", "decision"],
    "tune": ["prf_grid"],
    "cache": ["collection_pool", "lexical_cases"],
    "vector": ["knn_exact", "knn_label_metrics"],
    "hybrid": ["hybrid_sweep"],
    "ltr": ["pool_recall", "ltr_report", "ltr_against_hybrid"],
    "boosted": ["ltr_boosted_trees"],
    "export": ["tagged_collection", "tagged_queries", "qrels_lines"],
    "prepare": ["bulk_payload"],
    "report": ["baseline_matrix", "technique_classification"],
    "profile": ["dataset_profile_counts"],
}


def loaded(spark: SparkSession, sf_dir: str, to: str) -> dict:
    """Makes the index at ``to`` if there is none, and loads the documents once."""
    docs = corpora.table_documents(corpora.read_table(spark, f"{sf_dir}/documents.parquet"), "lang")
    index = Index.create(spark, to, list(BOOSTS)).load(docs, batch=sf_dir)
    return {"index": to, "version": index.version, "documents": index.count()}


def provider(name: str, model: str, host: str | None) -> LocalHash | Batches:
    if name == "openai":
        return OpenAI(model, os.environ["OPENAI_API_KEY"], *([host] if host else [])).provider()
    if name == "ollama":
        return Ollama(model, *([host] if host else [])).provider()
    if name == "child":
        return Child(model, tuple(shlex.split(host or ""))).provider()
    return LocalHash()


def embedded(spark: SparkSession, sf_dir: str, to: str, by: LocalHash | Batches) -> dict:
    docs = corpora.table_documents(corpora.read_table(spark, f"{sf_dir}/documents.parquet"))
    return {"cache": to, "space": by.space, "made": EmbeddingCache(spark, to).fill(docs, by)}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=[*COMMANDS, "query", "load", "embed"])
    parser.add_argument("dir", help="folder with documents.parquet, benchmark.parquet, labels.parquet")
    parser.add_argument("--name", help="with query: the registered query to run")
    parser.add_argument("--to", help="write Parquet below this folder instead of printing; with load and embed: the index or the cache")
    parser.add_argument("--provider", choices=["local-hash", "openai", "ollama", "child"], default="local-hash", help="with embed: who makes the vectors")
    parser.add_argument("--model", default="", help="with embed: the provider's model")
    parser.add_argument("--host", help="with embed: the service's address, or the program to start")
    given = parser.parse_args(args)
    if given.command in ("load", "embed") and not given.to:
        parser.error(f"{given.command} needs --to")
    from lodestar.plans.queries import QUERIES

    spark = SparkSession.builder.getOrCreate()
    if given.command in ("load", "embed"):
        print(json.dumps(loaded(spark, given.dir, given.to) if given.command == "load" else embedded(spark, given.dir, given.to, provider(given.provider, given.model, given.host))))
        return
    for name in [given.name] if given.command == "query" else COMMANDS[given.command]:
        rows = QUERIES[name](spark, given.dir)
        if given.to:
            rows.write.mode("errorifexists").parquet(f"{given.to}/{name}")
        else:
            for line in rows.toJSON().toLocalIterator():
                print(f'{{"query":"{name}","row":{line}}}')


if __name__ == "__main__":
    main()
