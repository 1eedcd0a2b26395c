"""PHYLIP square matrices: names of ten characters, then a row of distances. One file, as many rows as genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.signature import checked_mode
from ..session import stored

METRICS = ("dice", "jaccard", "jc")


def file_name(prefix: str, mode: str, metric: str, level: int) -> str:
    return f"{prefix}.{checked_mode(mode)}.{metric}.lvl{level}.phy"


def matrix_lines(matrix: DataFrame, names: DataFrame, metric: str) -> DataFrame:
    """(nr, line) of the matrix ``matrix(i, j, …)`` in long form; names are ``names(genome_idx, short_name)``.

    Line 0 is the number of genomes. A row is the name, right-aligned to ten, then every distance with 15 decimals; a
    missing one is ``nan``.
    """
    cell = F.coalesce(F.format_string(" %.15f", F.col(metric)), F.lit(" nan"))
    rows = matrix.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.when(F.col(metric).isNull(), " nan").otherwise(cell).alias("t")))).alias("row"))
    named = rows.join(names.select(F.col("genome_idx").alias("i"), "short_name"), "i")
    line = F.concat(F.format_string("%10s", F.col("short_name")), F.array_join(F.transform("row", lambda r: r["t"]), ""))
    head = names.agg(F.count("*").cast("string").alias("line")).select(F.lit(-1).cast("long").alias("i"), "line")
    return head.union(named.select(F.col("i").cast("long").alias("i"), line)).select((F.col("i") + 1).alias("nr"), "line")


def write_matrices(matrix: DataFrame, names: DataFrame, prefix: str, mode: str, level: int) -> list[str]:
    """Write the three matrices as text; the result is n lines each, so one task writes a file. Returns the folders."""
    out = []
    for metric in METRICS:
        out.append(file_name(prefix, mode, metric, level))
        matrix_lines(matrix, names, metric).coalesce(1).sortWithinPartitions("nr").select("line").write.mode("overwrite").text(out[-1])
    return out


def read_matrix(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """(i, j, name_i, name_j, d): the lower triangle, diagonal included, of a PHYLIP file.

    ``nan`` is read as null and plays no part in the largest distance, by which ``normalize`` divides; that must be over 0.
    """
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    raw = stored(raw.where("trim(line) <> ''"), "matrix")
    # Blocks count their lines, and sums of blocks give every line its number; no task holds the file.
    before = Window.orderBy("path", "at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("path", "at").agg(F.count("*").alias("n")).select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("path", "at").orderBy("id"))
    rows = raw.withColumn("in_block", inside).join(F.broadcast(blocks), ["path", "at"]).select((F.col("before") + F.col("in_block") - 1).cast("int").alias("nr"), "line").where("nr > 0")
    cells = rows.select((F.col("nr") - 1).alias("i"), F.trim(F.substring("line", 1, 10)).alias("name_i"), F.posexplode(F.split(F.trim(F.expr("substring(line, 11)")), r"\s+")).alias("j", "t"))
    names = rows.select((F.col("nr") - 1).alias("j"), F.trim(F.substring("line", 1, 10)).alias("name_j"))
    low = cells.where("j <= i").join(names, "j").select("i", "j", "name_i", "name_j", F.when(F.lower("t") != "nan", F.col("t").cast("double")).alias("d"))
    if normalize:
        top = low.agg(F.max("d")).first()[0]
        if not top or top <= 0:
            raise ValueError("a matrix without a distance over 0 can't be normalised")
        low = low.withColumn("d", F.col("d") / F.lit(top))
    return low
