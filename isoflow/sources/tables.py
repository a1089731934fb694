"""Readers and writers of the assay's files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoflow.sources.fastq import SPLIT_BYTES, FastqSource


def read_fastq(spark: SparkSession, paths, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``read_id, seq, qual, file`` of FASTQ files: files, folders or patterns, plain, block-gzipped or gzipped.

    Plain and block-gzipped files are read in splits of ``split_bytes``; a file of ordinary gzip is one task.
    """
    spark.dataSource.register(FastqSource)
    named = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("fastq").option("paths", json.dumps(named)).option("splitBytes", split_bytes).load()


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """``id, seq``: lines of a record are joined, the id is the header's first word."""
    rows = spark.read.option("lineSep", ">").text(paths).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\n")
    return rows.select(
        F.split(F.get(lines, F.lit(0)), r"\s").getItem(0).alias("id"),
        F.translate(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), "\r", "").alias("seq"),
    )


def write_fasta(df: DataFrame, path: str, id_column: str = "id", seq_column: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), id_column, F.lit("\n"), seq_column)).write.text(path)


def library_regions(
    library: DataFrame, regions=("librarySequence", "upstreamIntronSeq", "skippedExonSeq", "downstreamIntronSeq"),
    id_column: str = "ID",
) -> dict[str, DataFrame]:
    """One ``id, seq`` table for each region of a library."""
    return {r: library.select(F.col(id_column).alias("id"), F.col(r).alias("seq")) for r in regions}


def read_counts(spark: SparkSession, paths, schema: StructType | str, separator: str = ",", suffix: str | None = None) -> DataFrame:
    """Many delimited files with a header, by name, with the file each row came from."""
    reader = spark.read.option("header", True).option("sep", separator).option("recursiveFileLookup", True).schema(schema)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.csv(paths).select("*", F.col("_metadata.file_name").alias("filename"))


def sample_stats(spark: SparkSession, paths, metrics: list[str]) -> DataFrame:
    """Key/value logs ``metric,value`` as one row per file, a column for each listed metric."""
    rows = spark.read.option("header", False).schema("metric string, value double").csv(paths).select("*", F.col("_metadata.file_name").alias("filename"))
    return rows.groupBy("filename").pivot("metric", metrics).agg(F.first("value"))


def combine_results(spark: SparkSession, path: str, schema: StructType | str, max_fdr: float = 0.01) -> DataFrame:
    """Result files of many folders in one table: significant rows and the folder they came from."""
    rows = spark.read.option("header", True).option("sep", "\t").schema(schema).csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select("*", folder.alias("folder")).where(F.col("FDR") < max_fdr)


def write_table(df: DataFrame, path: str, partition_by=(), format: str = "parquet") -> None:
    writer = df.write.format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def reads_for_barcodes(reads: DataFrame, barcodes: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` reads with different UMIs of each listed barcode, by read id."""
    kept = reads.join(barcodes.select("cb").distinct(), "cb", "left_semi")  # the list can be as long as the reads
    one = kept.withColumn("r", F.row_number().over(Window.partitionBy("cb", "umi").orderBy("read_id"))).where("r = 1")
    return one.withColumn("r", F.row_number().over(Window.partitionBy("cb").orderBy("read_id"))).where(F.col("r") <= n).drop("r")
