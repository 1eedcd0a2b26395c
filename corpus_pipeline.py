"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet to the shared folder and read again, so stages start from files and a lost executor
costs no more than a part of the running stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import line_dedup, minhash, mixing, packing, quality
from strandmill.llm.common import spool
from strandmill.llm.queries import tokenizer_files
from strandmill.session import table


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of these names renamed, and its columns under their own names again."""
    renamed = {c: f"__sm_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(renamed), [F.col(renamed.get(c, c)).alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote accepts. Labels of documents in the held-out fold are not learned from.

    Null and empty texts have no vector and go by label 1's share of the labelled rows; whole texts are scored, however long. Equal texts are kept or
    dropped together, repeated rows each. Without labels everything stays. Columns of any name stay as they are.
    """
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    kept, back = _set_aside(docs, "score", "predicted")
    return quality.score_quality(kept, model).where("predicted = 1").select(*back)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that spread over many sites; documents of which nothing else is left go, those that were blank stay.

    Null texts stay null; null source is a site; of equal lines the first stays (least id, null ids last, then place, then text); rows that repeat
    an id and text are cut alike. n_chars, if there, is counted anew. Columns named n_lines or n_removed stay as they are.
    """
    kept, back = _set_aside(docs, "n_lines", "n_removed")
    cleaned = line_dedup.dedup_lines(kept).where("not (n_removed > 0 and trim(translate(text, '\\n\\t\\r', '   ')) = '')")
    n_chars = F.char_length("text").cast("long").alias("n_chars")
    return cleaned.select(*[n_chars if c == "n_chars" else x for c, x in zip(docs.columns, back)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Texts that are null or have no words, and rows with a null id, stay; so do rows that repeat an id that stays. Texts are compared whole.
    """
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks for, each time at that use's own place.

    Null source is a source; documents without words (null and empty texts) stay once, at the end. Rows are repeated one by one, whatever
    ids they share or lack. The order is that of the files written and of rows in them.
    """
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their place in the training sequences.

    Documents are taken in the training order that the mix left in its files, and each window keeps the proportions that sources have
    there. Null text is one token, the end of a document; long texts span sequences; repeated rows are packed each; further columns are ignored.
    """
    return packing.pack(docs, **tokenizer_files(), follow=True)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Votes of neighbours in a fitted space, near-duplicate components and tokenisation are beyond SQL;
#: tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, name)
    return docs
