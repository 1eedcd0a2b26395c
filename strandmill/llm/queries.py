"""The registered corpus queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import fim, hard_negatives, html_wrapper, langid, line_dedup, media, minhash, mixing, packing, quality, topk, url_filter, warc
from .common import fold


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    at = lambda k: F.try_element_at("positions", F.lit(k))
    return plan.select(*plan.columns[:-1], F.size("positions").alias("uses"), at(1).alias("position"), at(-1).alias("last_position"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(warc.stamped(table(spark, sf_dir, "pages"))).drop("part", "place")


def tokenizer_files() -> dict[str, str]:
    """Where the public tokenizer's files lie on this machine; every executor has them at the same place."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


#: Target token proportions of the sources by code point, in turn.
PACKING_WEIGHTS = (3.0, 1.0, 2.0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files(), weights=PACKING_WEIGHTS).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_mixing, op4_line_dedup, op5_langid, op6_media, op7_packing, op8_minhash, op9_topk, op10_html, op11_hard_negatives, op12_fim, op13_warc)}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.oracle(),
    "op3_mixing": mixing.oracle(),
    "op4_line_dedup": line_dedup.oracle(),
    "op9_topk": topk.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
    "op12_fim": fim.oracle(),
    "op13_warc": warc.oracle(),
}
