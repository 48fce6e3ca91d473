"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, repeated passages are cut, what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their input, so
extra columns of any name pass through. Null texts count as empty and are kept until packing, where each gives its end
id alone. Every row is a document of its own, rows that repeat a doc_id or have none too. No documents: no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import table, written
from loomgrid.llm.op05_toxicity import without_toxic
from loomgrid.llm.op07_suffix_dedup import repeats
from loomgrid.llm.op09_jaccard import one_of_each
from loomgrid.llm.op10_packing import packed


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the models call toxic; labels of the held-out fold are not looked at. Texts in which nothing speaks for either class, null and empty ones among them, stay whatever share of the labels is toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least doc_id (null is the least) of each group linked by 0.8 or more of five-word shingles; rows without words stay."""
    return one_of_each(docs, k=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that start earlier; n_chars follows the text. Null and empty texts stay as they are; of rows with equal ids one counts as the earlier."""
    out = repeats(docs, length=100, cut=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids. A null or empty text is its end id alone; each row is packed, rows that repeat too; other columns are not read."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", one_of_near_copies), ("suffix-array dedup", without_repeats), ("packing", packing)]

#: No stage can be told in SQL: a learned score, components, suffix sorting and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
