"""From raw documents to packed sequences: quality, near copies, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  What a stage returns is written as Parquet and
read again as the next one's documents; what a later stage has read is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.llm import dart, mixing, packing, secrets, subword
from tesselite.llm._util import discard, materialise, table, whole_row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below one half)."""
    model = subword.fit(docs, table(spark, sf_dir, "labels"))
    inner = docs.select(whole_row(docs).alias("_doc"), F.col("text"))
    return subword.score(inner, model, keep=("_doc",)).filter("score >= 0.5").select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return dart.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; n_chars follows the text."""
    columns = docs.columns
    inner = docs.select(whole_row(docs).alias("_doc"), F.col("text"))
    found = secrets.find_secrets(inner, keep=("_doc",))
    changed, doc = F.size("spans") > 0, F.col("_doc")
    new = {"text": F.when(changed, F.col("redacted")).otherwise(doc["text"]), "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(doc["n_chars"])}
    return found.select(*[new[c].alias(c) if c in new else doc[c].alias(c) for c in columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its hash take it."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of near-equal windows."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", redact_secrets), ("mix", mix), ("pack", pack)]

#: Trained weights, signatures and tokenizers have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
