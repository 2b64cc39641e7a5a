"""The corpus pipeline: quality rules, near duplicates, repeated paragraphs, secrets, packing.

Each stage takes all rows that the one before kept. Stages but the last return the columns of ``documents``; the
last returns the packed pieces. SQL can't express the stages' tokenizers, grammars and set joins, so
``ORACLE_SQL`` is None and the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, dropped, ids_of, stored, table
from gridweave.llm.ngram_join import ngram_join
from gridweave.llm.packing import pack
from gridweave.llm.paragraphs import without_duplicates
from gridweave.llm.quality import quality_cascade
from gridweave.llm.secrets import redacted

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; repeated rows are judged alike, ids
    play no part."""
    return quality_cascade(docs).where("rejected_by is null").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles from 0.8 on: the one with the smallest id.

    Rows that share an id are taken for one document; of those that share their text, too, one stays. A null id counts as one made of the
    text, larger than ordinary ids, so that null copies leave one row, or none beside a copy that has an id. Texts without words are linked with nothing.
    """
    names, t = docs.columns, Tables()
    made = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    docs = docs.withColumn("_gridweave_id", F.coalesce(F.col("doc_id").cast("bigint"), made))
    found = t.kept(ngram_join(docs.select(F.col("_gridweave_id").alias("doc_id"), "text"), width=5, percent=80))
    gone = ids_of(found.where("doc_id <> component_id"), "near-duplicates", t)
    again = ids_of(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated-ids", t)
    kept = docs.join(gone.withColumnRenamed("doc_id", "_gridweave_id"), "_gridweave_id", "left_anti")
    again = again.withColumnRenamed("doc_id", "_gridweave_id")
    once = kept.join(again, "_gridweave_id", "left_anti").select(*names)
    more = kept.join(again, "_gridweave_id", "left_semi").dropDuplicates(["_gridweave_id", "text"]).select(*names)
    return once.union(more)


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that an earlier document keeps; of ties the smallest id. Null texts, null ids and repeated rows
    are treated as in ``without_duplicates``."""
    return without_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blanked; null texts stay, repeated rows are blanked alike."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences. Null and empty texts are one end token; each repeated row
    is packed; ties go by the rows' order."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_paragraphs", repeated_paragraphs),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each stage's rows are written and read again, and dropped when the next one's are there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(done)
    return docs
