"""The operators' queries and SQL for their rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curriculum, ivfpq, language, lines, merkle, minhash, near, packing, ring, toxicity, url_rules, variants, wrappers

from .common import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def settled(query: Query) -> Query:
    """A query as a program of its own, which may settle its session's Arrow batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_html_extraction": wrappers.query,
    "op2_line_dedup": lines.query,
    "op3_document_fingerprints": minhash.query,
    "op4_packing": packing.query,
    "op5_nearest_neighbours": ivfpq.query,
    "op6_url_filters": url_rules.query,
    "op7_toxicity": toxicity.query,
    "op8_source_mixing": curriculum.query,
    "op9_sharding": ring.query,
    "op10_minhash_near_dedup": near.query,
    "op11_language_id": language.query,
    "op12_spelling_variants": variants.query,
    "op13_merkle_manifest": merkle.query,
}
QUERIES = {name: settled(q) for name, q in QUERIES.items()}
ORACLES = {
    "op2_line_dedup": lines.ORACLE,
    "op6_url_filters": url_rules.ORACLE,
    "op8_source_mixing": curriculum.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
