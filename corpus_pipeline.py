"""A corpus pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes what the one before it kept, written as Parquet and read again, and its decisions take effect. The
stages keep the columns of ``documents``, the last returns pieces of packed sequences with their ids. Rows without a
doc_id leave at the second stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiflow.llm.common import materialise, table, unused
from lexiflow.llm.crf import fit_quality, quality_scores
from lexiflow.llm.decontaminate import without_spans
from lexiflow.llm.minhash import near_duplicates
from lexiflow.llm.packing import first_line, packed
from lexiflow.llm.substrings import remove_repeats

#: Documents with a lower score than this are rejected: well below the 0.7 of op10, so that doubtful ones stay.
REJECT_BELOW = 0.5
#: Benchmark passages of more words than this are cut from documents that stay.
LONGEST_SPAN = 50


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _cut(rows: DataFrame, docs: DataFrame, shorter: Column, text: Column) -> DataFrame:
    """Columns of ``docs`` from ``carried``, with the ``text`` given and, where it is ``shorter``, its length in n_chars."""
    change = {"text": text}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(shorter, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried.n_chars"))
    return rows.select(*(change[c].alias(c) if c in change else F.col(f"carried.`{c}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier finds bad; labels are learned from rows that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    score = unused("quality_score", docs.columns)
    return quality_scores(docs, model, carry=tuple(docs.columns), out=score).where(F.col(score) >= REJECT_BELOW).select(_all(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8), that with the smallest doc_id."""
    kept = near_duplicates(docs, size=5, percent=80).where("kept").select("doc_id").distinct()
    one, copy = W.partitionBy("doc_id").orderBy("text"), unused("copy", docs.columns)
    return docs.join(kept, "doc_id", "left_semi").withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).select(_all(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all but the first occurrence of strings of 100 bytes, by whole characters; texts of which nothing is left go."""
    null = unused("no_text", docs.columns)
    cut = remove_repeats(docs.withColumn(null, F.col("text").isNull()), length=100, characters=True, carry=(*(c for c in docs.columns if c != "text"), null))
    shorter = F.size("starts") > 0
    rows = cut.where(~shorter | (F.length("kept_text") > 0))
    return _cut(rows, docs, shorter, F.when(~F.col(f"carried.{null}"), F.col("kept_text").cast("string")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth stands in 13-word windows of benchmark items, and cuts passages of more than LONGEST_SPAN words from the others."""
    found = without_spans(docs, table(spark, sf_dir, "benchmark"), max_words=LONGEST_SPAN, max_share=0.05)
    return _cut(found.where("not contaminated"), docs, F.col("n_cut") > 0, F.col("kept_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, 64 pieces and 1,984 tokens with loss (all but the first line), with their ids."""
    return packed(docs, max_tokens=2048, max_segments=64, max_loss=1984, prompt=first_line(), special=True)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else materialise(out)
    return docs
