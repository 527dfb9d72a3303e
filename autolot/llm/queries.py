"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from autolot.llm import hosts, knn, language, licenses, mixing, neardup, negatives, packing, private, quality, sharding, tools, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": language.query,
        "op2_private_data": private.query,
        "op3_tool_calls": tools.query,
        "op4_quality_rules": quality.query,
        "op5_packing": packing.query,
        "op6_near_duplicates": neardup.query,
        "op7_poisson_mixing": mixing.query,
        "op8_voronoi_knn": knn.query,
        "op9_jump_sharding": sharding.query,
        "op10_host_reputation": hosts.query,
        "op11_license_scan": licenses.query,
        "op12_hard_negatives": negatives.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_tool_calls": tools.SQL, "op7_poisson_mixing": mixing.SQL, "op8_voronoi_knn": knn.SQL, "op9_jump_sharding": sharding.SQL, "op10_host_reputation": hosts.SQL,
        "op12_hard_negatives": negatives.SQL,
    }
