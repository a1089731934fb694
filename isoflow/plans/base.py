"""Registration of queries: an operator over derived tables and the equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoflow.plans import derive

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; ``nudge`` settles exact halves."""
    return df.select(*[F.round(F.col(f"`{n}`") + nudge, digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def ctes(*names: str) -> str:
    """``WITH`` clause of derived tables for DuckDB."""
    texts = {
        "counts": derive.COUNTS, "file_counts": derive.FILE_COUNTS, "molecules": derive.MOLECULES, "psi_counts": derive.PSI_COUNTS, "satmut": derive.SATMUT,
        "expression": derive.EXPRESSION_DUCKDB, "imaging": derive.IMAGING, "sequences": derive.SEQUENCES_DUCKDB, "lines": derive.NATION,
        "rates": "SELECT s_suppkey AS sample, CAST(s_suppkey % 20 AS DOUBLE) / 100 AS rate FROM {supplier}",
    }
    return "WITH " + ", ".join(f"{n} AS ({derive.sql(texts[n])})" for n in names)


def pieces_cte(size: int) -> str:
    """The table ``pieces (doc_id, lang, piece, seq)`` after ``sequences``."""
    return f", pieces AS ({derive.PIECES_DUCKDB.format(size=size)})"


PSI_CTE = ", psi AS (SELECT *, included / (included + skipped)::DOUBLE AS psi FROM psi_counts WHERE included + skipped >= 30)"
MEANS_CTE = PSI_CTE + ", means AS (SELECT event, condition, avg(psi) AS psi FROM psi GROUP BY ALL HAVING count(psi) >= 2)"
