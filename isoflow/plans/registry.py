"""All registered queries of the assay operators and their SQL."""

from __future__ import annotations

from isoflow.plans import base, contrast_queries, count_queries, design_queries, sequence_queries, stat_queries  # noqa: F401  (importing registers)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
