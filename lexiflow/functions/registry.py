"""Functions of the library by name in SQL (J1, J3, J4): scalar functions, and table functions for LATERAL and TABLE arguments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, NullType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.align import needleman_wunsch
from .numbers import CLEANERS, VARIANTS


def clean_text(texts: pd.Series, names: pd.Series) -> pd.Series:
    """``clean_text(text, 'lowercase,collapse')``: a chain of cleaners by name, from left to right; nulls stay."""

    def one(text: str | None, chain: str) -> str | None:
        for name in chain.split(",") if text is not None else ():
            text = CLEANERS[name.strip()](text)
        return text

    return pd.Series([one(t, n) for t, n in zip(texts, names, strict=True)])


def say_numbers(texts: pd.Series, variants: pd.Series) -> pd.Series:
    """``say_numbers(text, 'speech')``: numbers of a text in words by a variant's name; nulls stay."""
    return pd.Series([VARIANTS[v](t) if t is not None else None for t, v in zip(texts, variants, strict=True)])


class AlignPairs:
    """``align_pairs(ref, hyp, gap, mismatch)``: a row (place, ri, hj) for each pair of a best alignment of two arrays, -1 for a gap; null is empty."""

    @staticmethod
    def analyze(ref: AnalyzeArgument, hyp: AnalyzeArgument, gap: AnalyzeArgument, mismatch: AnalyzeArgument) -> AnalyzeResult:
        for x in (ref, hyp):
            if not isinstance(x.dataType, ArrayType) or not isinstance(x.dataType.elementType, (StringType, NullType)):
                raise ValueError(f"align_pairs needs arrays of strings, not {x.dataType.simpleString()}")
        return AnalyzeResult(StructType([StructField(n, LongType()) for n in ("place", "ri", "hj")]))

    def eval(self, ref: list[str] | None, hyp: list[str] | None, gap, mismatch) -> Iterator[tuple[int, int, int]]:
        pairs, _ = needleman_wunsch(list(ref or ()), list(hyp or ()), float(gap), float(mismatch))
        for place, (i, j) in enumerate(pairs):
            yield place, i, j


class LabelRuns:
    """``label_runs(TABLE(t), key => 'k', label => 'l', order => 'a,b')``: runs of equal labels of each key in order.

    The table is dealt by the key and sorted, as the call says by names; rows are (key, run, label, first_place, last_place), as text and
    numbers. A task keeps the run it is in. Null labels are equal; a null key is a key.
    """

    def __init__(self):
        self.place = self.run = 0
        self.now = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, label: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in rows.dataType.fields}
        wanted = [key.value, label.value, *order.value.split(",")]
        if missing := [n for n in wanted if n not in names]:
            raise ValueError(f"label_runs: the table has no column {missing[0]}")
        schema = StructType([StructField("key", StringType()), StructField("run", LongType()), StructField("label", StringType()), StructField("first_place", LongType()), StructField("last_place", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(n) for n in wanted[2:]])

    def eval(self, row: Row, key: str, label: str, order: str) -> Iterator[tuple]:
        self.place += 1
        if self.now is not None and self.now[1] == row[label]:
            self.now[3] = self.place
            return
        if self.now is not None:
            yield self._made()
        self.run += 1
        self.now = [row[key], row[label], self.place, self.place]

    def _made(self) -> tuple:
        k, label, first, last = self.now
        return None if k is None else str(k), self.run, None if label is None else str(label), first, last

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None:
            yield self._made()


def register(spark: SparkSession) -> None:
    """All functions under their names in the session's SQL."""
    spark.udf.register("clean_text", F.pandas_udf(clean_text, "string"))
    spark.udf.register("say_numbers", F.pandas_udf(say_numbers, "string"))
    spark.udtf.register("align_pairs", F.udtf(AlignPairs))
    spark.udtf.register("label_runs", F.udtf(LabelRuns))
