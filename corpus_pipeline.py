"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup,
mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet in the folder that the executors share and read again as
the next stage's ``docs``. All but the last return the columns of documents.
After mixing a row is one part of a document in one block; a document that is cut at
the end of a block, or whose source is drawn more than once, has several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatrix.llm import common, langid, line_dedup, mixing, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go.

    Null texts and texts without letters go; null ids and labels pass. Rows that
    repeat get the same answer. All columns stay. Where no row has a label all go; no rows: no rows."""
    return langid.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; emptied ones go.

    Rows with null id or text and empty texts pass as they are; rows that repeat
    whole get the same decision. All columns stay; no rows: no rows."""
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Rows with null id, null text or no words stay; rows that share an id are one
    document. All columns stay; no rows: no rows."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources, drawn to the target weights.

    Null and empty texts have no part; a null source is the source ''; a null id
    stays null. The columns are those of documents, further ones end here; no rows: no rows."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row lies in the training windows.

    A row of more tokens than a window is several pieces; rows that repeat or
    share an id are packed each. No rows: no rows."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained model, fingerprints, token counts and online packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
