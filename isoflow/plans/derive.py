"""Assay-shaped tables derived from the star-schema tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a source table; :func:`load` runs a text on Spark, :func:`sql` names it for
DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COUNTS = """
SELECT l_suppkey AS sample, s_nationkey AS condition, p_brand AS idx,
  CASE l_returnflag WHEN 'A' THEN 'INCLUDED' WHEN 'N' THEN 'SKIPPED' ELSE 'UNSPLICED' END AS mode,
  CAST(CASE WHEN l_returnflag='A' THEN l_linenumber-4 ELSE 0 END AS INT) AS up_off,
  CAST(CASE WHEN l_returnflag='A' THEN l_orderkey%5-2 ELSE 0 END AS INT) AS down_off,
  CAST(SUM(l_quantity) AS BIGINT) AS cnt
FROM {lineitem} JOIN {supplier} ON s_suppkey=l_suppkey JOIN {part} ON p_partkey=l_partkey
GROUP BY 1,2,3,4,5,6"""

FILE_COUNTS = """
SELECT l_suppkey AS sample, s_nationkey AS condition, p_brand AS idx, CAST(l_shipdate AS STRING) AS file,
  CASE l_returnflag WHEN 'A' THEN 'INCLUDED' WHEN 'N' THEN 'SKIPPED' ELSE 'UNSPLICED' END AS mode,
  CAST(l_linenumber-4 AS INT) AS up_off, CAST(l_orderkey%5-2 AS INT) AS down_off, CAST(l_quantity AS BIGINT) AS cnt
FROM {lineitem} JOIN {supplier} ON s_suppkey=l_suppkey JOIN {part} ON p_partkey=l_partkey"""

MOLECULES = """
SELECT CONCAT('r', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS read_id, p_brand AS idx,
  l_returnflag AS mode, CAST(l_partkey AS BIGINT) AS cb, CAST(l_orderkey%64 AS BIGINT) AS umi
FROM {lineitem} JOIN {part} ON p_partkey=l_partkey"""

PSI_COUNTS = """
SELECT l_suppkey AS sample, s_nationkey AS condition, p_brand AS event,
  CAST(SUM(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END) AS BIGINT) AS included,
  CAST(SUM(CASE WHEN l_returnflag='N' THEN l_quantity ELSE 0 END) AS BIGINT) AS skipped
FROM {lineitem} JOIN {supplier} ON s_suppkey=l_suppkey JOIN {part} ON p_partkey=l_partkey GROUP BY 1,2,3"""

SATMUT = """
SELECT l_suppkey AS sample, s_nationkey AS condition, p_brand AS idx, CAST(l_orderkey%30 AS INT) AS position,
  substr('ACGT', CAST(l_partkey%4 AS INT)+1, 1) AS nucleotide,
  CAST(SUM(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END) AS BIGINT) AS included,
  CAST(SUM(CASE WHEN l_returnflag='N' THEN l_quantity ELSE 0 END) AS BIGINT) AS skipped
FROM {lineitem} JOIN {supplier} ON s_suppkey=l_suppkey JOIN {part} ON p_partkey=l_partkey GROUP BY 1,2,3,4,5"""

EXPRESSION_SPARK = """
SELECT label AS cell_line, g+1 AS gene, avg(CAST(v AS DOUBLE)) AS value
FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS g, v GROUP BY 1,2"""
EXPRESSION_DUCKDB = """
SELECT label AS cell_line, CAST(g AS INT) AS gene, avg(CAST(embedding[g] AS DOUBLE)) AS value FROM embeddings, range(1,65) t(g) GROUP BY 1,2"""

IMAGING = """
SELECT user_id AS well, event_type AS channel, value AS area,
  CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS intensity FROM {events}"""

_LETTERS_SPARK = "regexp_replace(lower(text),'[^a-z]','')"
_LETTERS_DUCKDB = "regexp_replace(lower(text),'[^a-z]','','g')"
_SEQUENCES = """
SELECT doc_id, lang, source, translate(upper(<letters>),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC') AS seq
FROM {documents}"""  # whole texts
SEQUENCES_SPARK = _SEQUENCES.replace("<letters>", _LETTERS_SPARK)
SEQUENCES_DUCKDB = _SEQUENCES.replace("<letters>", _LETTERS_DUCKDB)
_LIBRARY = """
SELECT item_id, translate(upper(<letters>),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {benchmark}"""
LIBRARY_SPARK, LIBRARY_DUCKDB = _LIBRARY.replace("<letters>", _LETTERS_SPARK), _LIBRARY.replace("<letters>", _LETTERS_DUCKDB)
PIECES_DUCKDB = """
SELECT doc_id, lang, CAST(w AS INT) AS piece, substr(seq, w * {size} + 1, {size}) AS seq
FROM (SELECT doc_id, lang, seq, unnest(range(0, CAST(ceil(len(seq) / {size}.0) AS BIGINT))) AS w FROM sequences)"""  # consecutive windows of every sequence

NATION = "SELECT n_nationkey AS condition, n_name AS name, n_regionkey AS lineage FROM {nation}"


def load(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A derived table on Spark."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def sql(text: str) -> str:
    """The same text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
