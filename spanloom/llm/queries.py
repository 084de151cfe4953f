"""The driver queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, minhash, mixing, quality_mil, quality_rules, sharding, token_counts, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(names: str, f: Callable[..., DataFrame]) -> Query:
    """f of the whole tables named."""
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names.split()])


QUERIES: dict[str, Query] = {
    "op1_token_counts": over("documents", token_counts.query),
    "op2_quality_mil": over("documents labels", quality_mil.query),
    "op3_quality_rules": over("documents", quality_rules.query),
    "op4_decontamination": over("documents benchmark", decontaminate.query),
    "op5_minhash_dedup": over("documents", minhash.query),
    "op6_url_filter": over("pages labels", url_filter.query),
    "op7_mixing": over("documents", mixing.query),
    "op8_warc": over("pages", warc.query),
    "op9_toxicity": over("documents labels", toxicity.query),
    "op10_sharding": over("documents", sharding.query),
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle(),
    "op6_url_filter": url_filter.oracle(),
    "op7_mixing": mixing.oracle(),
    "op8_warc": warc.oracle(),
}
