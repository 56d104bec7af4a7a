"""Numbered lines of text files that several tasks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import shared_table


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (file, line_no from 0, line) of files of any size, split where Spark splits them.

    A split's lines are numbered as they come, and the numbers of lines of the splits before it in its file are added; a file
    has few splits. Line ends are ``\\n`` or ``\\r\\n``.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("line"))
    held = shared_table(lines)  # numbers must be those of one reading
    blocks = held.groupBy("file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = held.join(blocks.select("file", "_block", "_low", before.alias("_before")), ["file", "_block"])
    return found.select("file", (F.col("_at") - F.col("_low") + F.col("_before")).alias("line_no"), "line")
