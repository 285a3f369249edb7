"""From raw documents to token ids: filter, deduplicate, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of docs, whatever further columns those have and whatever they are
called: a document travels as one struct beside what a stage computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, prepare, workspace, written
from quarry.llm.decontam import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.minhash import near_duplicates
from quarry.llm.pieces import default_model, encode_pieces
from quarry.llm.toxicity import THRESHOLD, fit, score_toxicity


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold stay."""
    prepare(spark)
    grammar = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(_carried(docs), grammar, keep=["row"]).where(F.col("score") < THRESHOLD).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the row with the largest doc_id stays."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    both = _carried(docs).withColumn("sha", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    return both.join(kept, both["doc_id"].eqNullSafe(kept["kept_id"]) & (both["sha"] == kept["kept_sha"]), "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    both = _carried(docs)
    return both.join(gone, both["doc_id"] == gone["gone_id"], "left_anti").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    found = decontaminate(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return found.where("NOT contaminated").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with their digests."""
    return encode_pieces(docs, default_model(), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece_encoding", encoded),
]

#: The toxicity stage is learned and the encoding is a library's: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
