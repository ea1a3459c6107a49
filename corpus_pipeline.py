"""The corpus pipeline: language identification, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet and reads
again as the next one's documents. All but the last give the columns of documents.

Defined cases: documents without text or letter go in the first stage, as they have no language. Where no document
has both a label and a text, no language can be learned, and that stage keeps all. A null source is a
site of its own. A document with a null id is like no other; its repeated rows become one. An id with several texts
keeps those that are the smallest of their group. Of copies with the same id, one stays. Long texts are read whole, extra
columns are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm import language_id, line_dedup, near_dup, packing
from rasterflow.llm.common import materialize
from rasterflow.session import read_table, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, no letter) or between two; sets ``lang`` to the predicted one."""
    ship(spark)
    model = language_id.fit(docs.select("text", "lang"))
    if model is None:  # no label, no language to tell: that is no fault of the documents
        return docs.select(*COLUMNS)
    known = language_id.identify(docs, model, ["doc_id", "text", "source", "n_chars"])
    kept = known.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source, and documents of which nothing else is left; copies of a page count once."""
    ship(spark)
    cut = line_dedup.line_dedup(docs.select(*COLUMNS), count_col="_dropped", copies_once=True)
    left = cut.where((F.col("_dropped") == 0) | (F.trim(F.col("text")) != ""))
    return left.withColumn("n_chars", F.when(F.col("_dropped") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, in one row.

    Groups are of texts: an id that holds two different texts doesn't make these duplicates.
    """
    ship(spark)
    found = near_dup.near_duplicates(docs, by_row=True)
    first = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("row_component"))
    # texts of the same id in one group: the one with the smallest mark; texts without a shingle are groups of their own
    alone = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("text_mark"))
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    kept = found.where(first).groupBy(*key, alone.alias("_alone")).agg(F.min("text_mark").alias("_mark")).drop("_alone")
    rows = docs.select(*COLUMNS, *key, near_dup.text_mark("text").alias("_mark"))
    return rows.join(kept, ["_id", "_none", "_mark"]).dropDuplicates(["_id", "_none", "_mark"]).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs tokenized documents into sequences: a row for each piece."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: Language identification and packing can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
