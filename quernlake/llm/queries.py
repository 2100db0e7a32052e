"""The contract queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernlake.llm import forest_search, html_text, id_files, media_chunks, mixing, near_dup, piece_sampling, quality, spelling, token_counts, url_filter, vector_search, wand
from quernlake.llm.common import table


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.read_ids(id_files.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op11_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search.nearest(table(spark, sf_dir, "embeddings"))


def op12_wand_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media_chunks, op2_url_filter, op3_near_duplicates, op4_source_mix, op5_quality, op6_html_text, op7_token_counts, op8_id_files, op9_piece_sampling, op10_vector_search, op11_forest_search, op12_wand_ranking, op13_spelling_groups)
}
ORACLES: dict[str, str] = {"op2_url_filter": url_filter.ORACLE, "op4_source_mix": mixing.ORACLE, "op10_vector_search": vector_search.ORACLE, "op12_wand_ranking": wand.ORACLE}
