"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, pieces.

run() applies the stages to documents; what each returns is written as Parquet in the shared folder and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, near_dup, pieces, substring, toxicity
from barloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the chain on the labelled documents that are left; documents at or above its threshold go."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("p_toxic") < toxicity.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays."""
    classes = near_dup.near_duplicates(docs, size=5)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id"), F.col("_key").alias("_gone_key"))
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_key"]), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; documents left without a word go.

    A text that loses nothing stays as it is; n_chars follows the text.
    """
    cut = substring.remove_repeats(docs, carry=docs.columns, layout=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return found.where("n_hit = 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with whether they decode to it."""
    out = pieces.encode_texts(docs, carry=["doc_id", "lang", "source"])
    return out.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encode", encode),
]

#: Classifiers, components and merges are beyond SQL: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        written = scratch.put(out)
        if i:
            scratch.drop(docs)
        docs = written
    return docs
