"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoflow.llm import ann, exact_dedup, fill_middle, jaccard_join, langid, license_scan, mixing, packing, prefix_trie, quality, secret_scan, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_quality": quality.op2_quality,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_language_id": langid.op4_language_id,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_ann_search": ann.op6_ann_search,
        "op7_mixing": mixing.op7_mixing,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.OP3_SQL, "op5_url_filter": url_filter.OP5_SQL, "op7_mixing": mixing.OP7_SQL,
        "op9_license_scan": license_scan.OP9_SQL, "op10_jaccard_join": jaccard_join.OP10_SQL,
        "op11_fill_in_middle": fill_middle.OP11_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
