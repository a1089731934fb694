"""Columns from packed names: event keys, offsets, samples, element ids, designs, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_event_key(df: DataFrame, names, key: str = "index", separator: str = "__") -> DataFrame:
    """Parts of a packed key as columns; missing parts are null."""
    parts = F.split(key, separator)
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def split_offset(df: DataFrame, offset: str = "offset", names=("up_off", "down_off", "const_off")) -> DataFrame:
    """``a:b:c`` as integers; what is no number is null."""
    parts = F.split(offset, ":")
    return df.withColumns({n: F.get(parts, F.lit(i)).try_cast("int") for i, n in enumerate(names)})


def with_event_id(df: DataFrame, index: str = "index", offset: str = "offset", name: str = "index_offset") -> DataFrame:
    return df.withColumn(name, F.concat_ws("__", index, offset))


def drop_near_offsets(df: DataFrame, up: str = "up_off", down: str = "down_off") -> DataFrame:
    """Without events one base off the reference on either side."""
    return df.where((F.abs(up) != 1) & (F.abs(down) != 1))


def unpack_name(df: DataFrame, name: str = "name") -> DataFrame:
    """``name_mode_offset``: the last two parts are mode and offset, the rest the name."""
    parts = F.split(name, "_")
    n = F.size(parts)
    return df.select(
        "*",
        F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), "_").alias("base_name"),
        F.when(n >= 2, F.get(parts, n - 2)).alias("name_mode"),
        F.get(parts, n - 1).alias("name_offset"),
    )


def parse_sample_name(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Condition and replicate of names that end in ``-rep1`` or ``_rep1``; names without one are a condition."""
    rep = F.regexp_extract(sample, r"(?<=[-_])(rep\d+)$", 1)
    return df.withColumns({"condition": F.regexp_replace(sample, r"[-_]rep\d+$", ""), "rep": F.when(rep != "", rep)})


def normalise_conditions(df: DataFrame, rules: list[tuple[str, str]], drop=(), condition: str = "condition") -> DataFrame:
    """Apply (pattern, replacement) rules in turn and drop listed conditions."""
    out = F.col(condition)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    named = df.withColumn(condition, out)
    return named.where(~F.col(condition).isin(list(drop))) if drop else named


def remap_reps(df: DataFrame, by: int = 3, rep: str = "rep") -> DataFrame:
    """Replicates above ``by`` continue from 1: rep4 to rep6 become rep1 to rep3."""
    number = F.regexp_extract(rep, r"(\d+)$", 1).try_cast("int")
    return df.withColumn(rep, F.when(number > by, F.concat(F.lit("rep"), (number - by).cast("string"))).otherwise(F.col(rep)))


def filter_samples(meta: DataFrame, min_reads: int = 1_000_000) -> DataFrame:
    return meta.where(F.col("total_aligned_reads").try_cast("long") >= min_reads)


def good_samples(stats: DataFrame, min_reads: int = 500_000, max_chimera: float = 0.15) -> DataFrame:
    return stats.where((F.col("total_reads") > min_reads) & (F.col("chimera_rate") < max_chimera))


def parse_element_id(df: DataFrame, element: str = "index") -> DataFrame:
    """``ENSG;gene;chr-coords``: gene id, gene and the parts of the coordinates."""
    parts = F.split(element, ";")
    place = F.split(F.get(parts, F.lit(2)), "-")
    return df.withColumns({"gene_id": F.get(parts, F.lit(0)), "gene": F.get(parts, F.lit(1)), "chromosome": F.get(place, F.lit(0)), "coordinates": F.slice(place, 2, F.greatest(F.size(place) - 1, F.lit(0)))})


def frameshift_candidates(df: DataFrame, exon: str = "exon_seq", min_length: int = 0) -> DataFrame:
    """Exons whose loss shifts the reading frame."""
    return df.where((F.length(exon) % 3 != 0) & (F.length(exon) >= min_length))


def blacklist_filter(df: DataFrame, listed: DataFrame, on, keep: bool = False) -> DataFrame:
    """Rows whose key is (``keep``) or is not on a list."""
    return df.join(listed, on, "left_semi" if keep else "left_anti")


def except_rows(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows of ``a`` whose key ``b`` does not hold."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def parse_design(name):
    """``(category, number)`` of a design name such as ``vae_0_to_10_7``; null number for a parent."""
    number = F.regexp_extract(name, r"(\d+)$", 1)
    return F.regexp_replace(name, r"_?\d+$", ""), number.try_cast("int")


def parse_mutation(label):
    """``(position, nucleotide)`` of a label such as ``17A``."""
    base = F.regexp_extract(label, r"([A-Z])$", 1)
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int"), F.when(base != "", base)


def strand_coordinates(df: DataFrame) -> DataFrame:
    """Exon and flanking intron lengths of skipped-exon events in the order of transcription."""
    minus = F.col("strand") == "-"
    first, second = F.col("exonStart_0base") - F.col("upstreamEE"), F.col("downstreamES") - F.col("exonEnd")
    return df.withColumns({"exon_length": F.col("exonEnd") - F.col("exonStart_0base"), "up_intron": F.when(minus, second).otherwise(first), "down_intron": F.when(minus, first).otherwise(second)})


def common_ids(tables: list[DataFrame], key: str) -> DataFrame:
    """Distinct values of ``key`` that all tables have."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_semi")
    return out


def all_ids(tables: list[DataFrame], key: str) -> DataFrame:
    """Distinct values of ``key`` of any table."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def table_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """``only_first, only_second``: rows, repeats counted, that the other variant lacks; both 0 for equal tables."""
    gone, new = first.exceptAll(second), second.exceptAll(first)
    both = gone.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("only_first"), F.coalesce(F.sum("b"), F.lit(0)).alias("only_second"))
