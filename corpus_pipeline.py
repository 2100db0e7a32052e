"""A corpus pipeline: quality, near duplicates, source mix, sampled segmentation.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again for the next one.  All but the last return the columns of ``documents``.

Defined cases, as those of the operators: null and empty texts are scored as such by the classifier, of those it keeps one
is left by the near-duplicate stage and none by the mix, which takes words alone; texts of any length go whole; rows alike
in id and text are one from the near-duplicate stage on; ties go to the smaller id, then to the smaller digest; a null id
or source is a value of its own; further columns, whatever their names, pass through all stages but the last; an empty
table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernlake.llm import mixing, near_dup, piece_sampling, quality
from quernlake.llm.common import fresh_name, table, written
from quernlake.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    return mixing.repeat(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, piece_ids, lossless) of each document of the mix; copies of a document are sampled apart."""
    copy = fresh_name(docs, "copy")
    pieces = piece_sampling.both_ways(piece_sampling.numbered_copies(docs, copy), vocabulary("piece_bpe_32k.model"), ("source",), copy=copy)
    return pieces.select("doc_id", "source", "n_pieces", "piece_ids", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("sampled pieces", sampled_pieces),
]

#: SQL expresses neither the classifier nor the sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
