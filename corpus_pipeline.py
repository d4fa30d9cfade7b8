"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. All but the last return the columns of ``documents``; the last
returns the packed pieces. Rows that share a doc_id are one document: they
stay or go together. Rows with a null doc_id pass all filters but those that
judge their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovec.llm import decontaminate, near_copies, packing, pii
from chronovec.llm import toxicity as toxicity_model
from chronovec.llm.common import materialize, perhaps_among, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier calls toxic."""
    model = toxicity_model.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_model.score(docs.select(*COLUMNS), model, score_col="_toxicity")
    return scored.where("_toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies: SimHash over five-word shingles, Jaccard similarity 0.8."""
    found = near_copies.near_copies(docs.select("doc_id", "text"))
    gone = found.where("node <> root").select(F.col("node").alias("doc_id"))
    marked = perhaps_among(docs.select(*COLUMNS), "doc_id", gone)  # texts that stay for certain need no shuffle
    stays = marked.where("not _perhaps").select(*COLUMNS)
    return stays.unionByName(marked.where("_perhaps").join(gone, "doc_id", "left_anti").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=["lang", "source", "n_chars"])
    return found.where("n_hit = 0").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    found = pii.find_pii(docs.select(*COLUMNS))
    changed = F.size("pii") > 0
    return found.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]

#: Learned and tokenizing stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        read, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if n:
            release(read)
    return STAGES[-1][1](spark, docs, sf_dir)
