"""The run's manifest: one genome for each line of a list, and side files whose line k belongs to genome k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.signature import NO_MAX

SHORT = 10
#: The frequency band that reads get if none is given.
READ_BAND = (15, 256)


def lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(genome_idx, name): the lines of a small text file in order; a final line feed adds none, carriage returns go."""
    whole = spark.read.text(path, wholetext=True)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n+$", "")
    return whole.where(text != "").select(F.posexplode(F.split(text, "\n")).alias("genome_idx", name))


def _side(manifest: DataFrame, side: DataFrame, path: str) -> DataFrame:
    """Join a side file on; every genome needs its line and every line its genome."""
    odd = manifest.select("genome_idx").join(side.select(F.col("genome_idx").alias("_k")), F.col("genome_idx") == F.col("_k"), "full").where("genome_idx is null or _k is null")
    if n := odd.count():
        raise ValueError(f"{path} and the manifest differ in {n} lines")
    return manifest.join(side, "genome_idx")


def manifest(spark: SparkSession, paths: str, names: str | None = None, min_cc: int | str | None = None, max_cc: int | str | None = None, outputs: str | None = None, reads: bool = False) -> DataFrame:
    """(genome_idx, in_path, short_name, min_cc, max_cc, out_path) of a list of input files.

    ``min_cc`` and ``max_cc`` are numbers or paths of threshold files. Short names are cut to ten characters
    and, without a file, are the start of the input path; see distinct_names for trees. Numbers that don't fit an unsigned 32-bit integer are refused.
    """
    out = lines(spark, paths, "in_path")
    if names:
        out = _side(out, lines(spark, names, "name"), names)
    else:
        out = out.withColumn("name", F.col("in_path"))
    for name, given, default in (("min_cc", min_cc, READ_BAND[0] if reads else 0), ("max_cc", max_cc, READ_BAND[1] if reads else NO_MAX)):
        if isinstance(given, str):
            side = lines(spark, given, "_t").select("genome_idx", F.try_to_number(F.trim("_t"), F.lit("9" * 10)).cast("bigint").alias(name))
            out = _side(out, side, given)
            if bad := out.where(F.col(name).isNull() | ~F.col(name).between(0, NO_MAX)).count():
                raise ValueError(f"{given}: {bad} lines are no unsigned 32-bit numbers")
        else:
            value = default if given is None else given
            if not 0 <= value <= NO_MAX:
                raise ValueError(f"{name} is {value}, not an unsigned 32-bit number")
            out = out.withColumn(name, F.lit(value).cast("bigint"))
    out = _side(out, lines(spark, outputs, "out_path"), outputs) if outputs else out.withColumn("out_path", F.lit(None).cast("string"))
    return out.withColumn("short_name", short_name(F.col("name"))).select("genome_idx", "in_path", "short_name", "min_cc", "max_cc", "out_path")


def short_name(name):
    return F.substring(name, 1, SHORT)


def distinct_names(genomes: DataFrame) -> DataFrame:
    """``genomes(genome_idx, short_name)`` with names that occur more than once made distinct by the genome's number."""
    many = F.count("*").over(Window.partitionBy("short_name")) > 1
    number = F.col("genome_idx").cast("string")
    marked = F.concat(F.left("short_name", SHORT - 1 - F.length(number)), F.lit("_"), number)
    return genomes.withColumn("short_name", F.when(many, marked).otherwise(F.col("short_name")))
