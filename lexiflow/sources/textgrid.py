"""TextGrid annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TIER = re.compile(r'class\s*=\s*"IntervalTier"\s*name\s*=\s*"((?:[^"]|"")*)"')
_INTERVAL = re.compile(r'xmin\s*=\s*([-\d.eE+]+)\s*xmax\s*=\s*([-\d.eE+]+)\s*text\s*=\s*"((?:[^"]|"")*)"')


def intervals_of(text: str) -> Iterator[tuple[str, int, float, float, str]]:
    """(tier, place, start, end, label) of every interval tier of a file in the long format."""
    tiers = list(_TIER.finditer(text))
    for i, tier in enumerate(tiers):
        body = text[tier.end() : tiers[i + 1].start() if i + 1 < len(tiers) else len(text)]
        for k, m in enumerate(_INTERVAL.finditer(body)):
            yield tier[1].replace('""', '"'), k, float(m[1]), float(m[2]), m[3].replace('""', '"').strip()


def read_textgrids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Intervals of all tiers of all files (file, tier, place, start, end, label); one file is one row to begin with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *x) for f, t in zip(pdf["file"], pdf["value"], strict=True) for x in intervals_of(t or "")]
            yield pd.DataFrame(rows, columns=["file", "tier", "place", "start", "end", "label"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, "file string, tier string, place int, start double, end double, label string")


def pick_tier(intervals: DataFrame, wanted: str) -> DataFrame:
    """Of each file the tier of that name, else one that contains it, else the first."""
    name = F.lower("tier")
    rank = F.when(name == wanted.lower(), 0).when(name.contains(wanted.lower()), 1).otherwise(2)
    best = intervals.groupBy("file").agg(F.min_by("tier", F.struct(rank, "tier")).alias("tier"))
    return intervals.join(best, ["file", "tier"], "left_semi")
