"""The corpus pipeline: each stage works on all documents that the one before it kept.

Defined cases: null texts pass every filter but have no tokens; near_duplicates lets null, empty and wordless texts
through and drops only rows whose text is linked to that of an earlier row (smaller id, nulls last; then row of the
stage's saved table), so that rows with equal or null ids and other texts stay; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.llm.common import saved, table
from stratarc.llm.jaccard import without_copies
from stratarc.llm.leaks import decontaminate
from stratarc.llm.passages import dedup_passages
from stratarc.llm.pieces import sentencepiece_round_trip
from stratarc.llm.toxicity import fit, score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches their language's threshold."""
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), score="__score", threshold="__threshold")
    return scored.where("__score < __threshold").drop("__score", "__threshold")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of texts linked by five-word Jaccard similarity 0.8 or more the row with the smallest id.

    Candidates come from BK-trees over SimHash fingerprints and from a prefix filter that misses none; whole sets decide.
    """
    return without_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has; drops documents of which nothing is left."""
    cut = dedup_passages(docs, spans="__spans", kept_text="__kept", as_text=True).where("size(__spans) = 0 OR trim(__kept) <> ''")
    changed = F.size("__spans") > 0
    return cut.select(
        *(
            F.when(changed, F.col("__kept")).otherwise(F.col("text")).alias("text")
            if c == "text"
            else F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        )
    )


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text, their number, and whether they decode to the text again."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        coded = sentencepiece_round_trip(docs, f.read())
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("exact", F.col("decoded_text") == F.coalesce("text", F.lit(""))).drop("decoded_text")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("passages", passages), ("decontamination", benchmark), ("sentencepiece", tokens)]

#: No stage of the pipeline can be written in SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
