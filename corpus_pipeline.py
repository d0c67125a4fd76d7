"""Corpus preparation: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir), works on all rows that its predecessor
kept, and but for the last returns the columns of ``documents``. Rows with null or empty
texts fall to the quality rules, as documents of fewer than ten words do. An empty table goes
through all stages and comes out without pieces.

A stage's input is stored, so each begins by deleting the scratch tables of those before it
that its input doesn't read. Those of other runs, and of operators called by themselves, stay.
"""

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._spark import Scratch, clean, owned
from lodestone.llm.decontaminate import remove_contaminated
from lodestone.llm.neardup import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.quality import quality_rules
from lodestone.llm.queries import byte_bpe
from lodestone.llm.substring import remove_repeats

#: Words of a passage that may not be repeated from an earlier document.
REPEATED_WORDS = 25


def _stage(work):
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned("stages"):
            clean(docs)
            return work(spark, docs, sf_dir)

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    judged = quality_rules(docs.select("text", "lang", F.struct(*docs.columns).alias("row")), keep=("row",))
    return judged.where("kept").select("row.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that a document with a smaller doc_id has too."""
    out = remove_repeats(docs, width=REPEATED_WORDS, keep=tuple(c for c in docs.columns if c != "text"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("kept_row")[c].alias(c) for c in docs.columns))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no item of the benchmark."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, percent=80)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return pack(docs, byte_bpe(), capacity=2048, end_id=1)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The stages hash, score and tokenise in ways that SQL has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written to the shared folder and read
    again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with owned(f"pipeline-{uuid.uuid4().hex}"):
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = Scratch(spark).put(docs, name)
    return docs
