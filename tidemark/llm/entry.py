"""The queries of this subpackage and the SQL that some can be compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 8)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import digest

    return digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), end_id=2)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_planes import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def _sent(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    every = (
        op1_sharding,
        op2_piece_codec,
        op3_license_scan,
        op4_quality_rules,
        op5_embedding_dedup,
        op6_line_dedup,
        op7_token_planes,
        op8_url_filter,
        op9_packing,
        op10_near_duplicates,
    )
    return {f.__name__: _sent(f) for f in every}


def oracle_sql() -> dict[str, str]:
    from . import embedding_dedup, minhash_dedup, url_filter

    return {"op5_embedding_dedup": embedding_dedup.ORACLE, "op8_url_filter": url_filter.ORACLE, "op10_near_duplicates": minhash_dedup.ORACLE}
