"""Loads corpus records, embeds what has no vector, and answers one question with hybrid retrieval.

    python examples/retrieve.py CORPUS.jsonl "a question" --top-k 5 --vectors /shared/vectors

Vectors are committed in batches under --vectors, so a second run embeds nothing.  The embedder here is the deterministic
stand-in of the package; another one is passed to ``run``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernlake.functions.text import query_variants
from quernlake.operators import answering, corpus_store
from quernlake.session import build_session
from quernlake.sources.corpus import read_records

DIMENSION = 64


def run(spark: SparkSession, corpus: str, query: str, vectors: str, top_k: int = 5, embedder: corpus_store.Embedder | None = None, dimension: int = DIMENSION) -> dict:
    """What was loaded and embedded, the readings of the question, and its ranked results."""
    embedder = embedder or corpus_store.hash_embedder(dimension)
    records = read_records(spark, corpus).withColumn("embedding", F.lit(None).cast("array<float>"))
    before = corpus_store.committed_vectors(spark, vectors, records).count()
    began = time.perf_counter()
    corpus_store.embed_in_batches(records, vectors, embedder, dimension)
    seconds = time.perf_counter() - began
    chunks = corpus_store.with_vectors(records, vectors)
    asked = spark.createDataFrame([(0, query)], "query_id int, query string")
    found = answering.retrieve(chunks, asked, embedder, dimension, top_k).join(chunks.select("id", "cite_url"), "id").orderBy("rank")
    return {
        "loaded_records": records.count(), "embedded_chunks": corpus_store.committed_vectors(spark, vectors, records).count() - before, "embedding_wall_seconds": round(seconds, 4),
        "query": query, "query_variants": asked.select(query_variants(F.col("query"))).first()[0],
        "results": [{c: r[c] for c in ("rank", "id", "cite_url", "score", "dense_rank", "lexical_rank")} for r in found.collect()],
    }


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("corpus")
    parser.add_argument("query")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--vectors", help="folder of committed vectors; on a cluster a shared one")
    args = parser.parse_args()
    spark = build_session("retrieve")
    print(json.dumps(run(spark, args.corpus, args.query, args.vectors or tempfile.mkdtemp(prefix="vectors-"), args.top_k), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
