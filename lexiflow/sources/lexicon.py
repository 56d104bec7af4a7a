"""Pronunciation lexicons: word, numbers, phones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines

SILENT = ["sil", "sp", "spn", "<eps>"]


def read_lexicon(spark: SparkSession, path: str | list[str], policy: str = "append", first_phone: int | None = None) -> DataFrame:
    """Lines of a lexicon, by one of three policies for several lines of one word.

    ``append``: (word, phones, line_no, prob, file) for each line, numbers and silences dropped (A17). ``best``: the line with
    the largest first number, the first on ties (A18). ``last``: the last line, phones from column ``first_phone`` on (A19).
    Several files follow each other by their names; a large one is read by several tasks.
    """
    files = numbered_lines(spark, path)
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = files.select("file", "line_no", parts.alias("parts")).where("size(parts) > 1")
    number = r"^-?\d+(\.\d+)?([eE]-?\d+)?$"
    phones = F.filter(F.slice("parts", 2, F.size("parts")), lambda p: ~p.rlike(number) & ~F.lower(p).isin(SILENT))
    if policy == "last":
        phones = F.slice("parts", first_phone or 2, F.size("parts"))
    prob = F.coalesce(F.get(F.filter(F.slice("parts", 2, F.size("parts")), lambda p: p.rlike(number)), F.lit(0)).cast("double"), F.lit(1.0))
    out = rows.select(F.col("parts")[0].alias("word"), phones.alias("phones"), "file", "line_no", prob.alias("prob"))
    if policy == "append":
        return out.select("word", "phones", "line_no", "prob", "file")
    first = F.min_by("phones", F.struct(-F.col("prob"), "file", "line_no")) if policy == "best" else F.max_by("phones", F.struct("file", "line_no"))
    return out.groupBy("word").agg(first.alias("phones"))
