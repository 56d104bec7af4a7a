"""JSON lines, CSV, listings and reports."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
CORRUPT = "_corrupt_record"


def read_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows that parse; blank and broken lines are skipped (A1)."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_strict(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows, or an error at the first broken line (A2)."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_marked(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """All rows with the text of broken lines and the file they stand in (A3): count or filter by ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(wide).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).withColumn("_file", F.input_file_name())


def drop_counts(marked: DataFrame) -> DataFrame:
    """Rows read and broken lines of each file (A3)."""
    # The reader must be asked for other columns too, or it doesn't parse.
    broken = F.when(F.col(CORRUPT).isNotNull(), F.struct(*(c for c in marked.columns if c != "_file")))
    return marked.groupBy("_file").agg(F.count("*").alias("n"), F.count(broken).alias("broken"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, characters as they are (A4); ``append`` adds files in one commit."""
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines; readers never see half of them."""
    write_jsonl(df, path, "append")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header, all strings."""
    return spark.read.csv(path, header=True, encoding="UTF-8")


def _renamed(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Columns by any of their names, whatever the case, spaces and byte order mark; the first filled one counts."""
    plain = {c: c.strip().lstrip("﻿").lower() for c in df.columns}
    out: list[Column] = []
    for name, known in synonyms.items():
        found = [F.col(f"`{c}`") for k in known for c, p in plain.items() if p == k]
        if found:
            out.append(F.coalesce(*found).alias(name))
    return df.select(*out, *(F.col(f"`{c}`").alias(p) for c, p in plain.items() if not any(p in k for k in synonyms.values())))


#: Names that columns of alignments go by.
ALIGNMENT = {"begin": ["begin", "start"], "end": ["end", "finish"], "label": ["label", "text", "value"], "type": ["type", "tier"], "speaker": ["speaker"]}


def read_alignment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment rows (begin, end, label, type, speaker) of CSV files; missing required columns are an error, no speaker is ``corpus``."""
    df = _renamed(read_csv(spark, path), ALIGNMENT)
    missing = {"begin", "end", "label", "type"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    speaker = F.coalesce("speaker", F.lit("corpus")) if "speaker" in df.columns else F.lit("corpus")
    return df.select(F.col("begin").try_cast("double").alias("begin"), F.col("end").try_cast("double").alias("end"), F.coalesce("label", F.lit("")).alias("label"), F.lower(F.trim("type")).alias("type"), speaker.alias("speaker"), F.input_file_name().alias("file"))


def path_column(df: DataFrame, names: tuple[str, ...] = ("slice_path", "path", "audio", "wav", "file", "filepath"), prefix: tuple[str, str] | None = None) -> DataFrame:
    """``path`` from the first column of a manifest that holds one, with a prefix replaced."""
    found = [F.when(F.trim(c) != "", F.trim(c)) for c in names if c in df.columns]
    if not found:
        raise ValueError("no path column")
    path = F.coalesce(*found)
    return df.withColumn("path", path if prefix is None else F.when(path.startswith(prefix[0]), F.concat(F.lit(prefix[1]), F.substr(path, F.lit(len(prefix[0]) + 1)))).otherwise(path))


def list_files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """Path, stem, size and time of files below a folder (A13); no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "length", "modificationTime")


def pairs_by_stem(audio: DataFrame, notes: DataFrame) -> DataFrame:
    """Audio files with their annotation of the same stem."""
    return audio.select("stem", F.col("path").alias("audio")).join(notes.select("stem", F.col("path").alias("notes")), "stem")


def read_filelist(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of a pipe-separated list; lines with another number of fields are skipped."""
    parts = F.split("value", r"\|", len(fields))
    return spark.read.text(path).where(F.size(parts) == len(fields)).select(*(parts[i].alias(f) for i, f in enumerate(fields)))


def write_filelist(df: DataFrame, path: str, fields: list[str]) -> None:
    """A pipe-separated list."""
    df.select(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("value")).write.text(path)


def read_levels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Levels of whole-file JSON with their items."""
    item = "struct<text:string,ipa:string,audioUrl:string,notes:string>"
    return spark.read.schema(f"level int, focus string, items array<{item}>").json(path, multiLine=True)


def level_list(levels: DataFrame) -> DataFrame:
    """Level and focus alone, in order."""
    return levels.select("level", "focus").orderBy("level")


def keyed_shards(rows: DataFrame, content: str) -> DataFrame:
    """Rows with the SHA-1 of their content, the two-step folder of it, and whether they have any."""
    key = F.sha1(F.col(content).cast("binary"))
    return rows.withColumn("key", key).withColumn("shard", F.concat(F.substring(key, 1, 2), F.lit("/"), F.substring(key, 3, 2))).withColumn("ok", F.coalesce(F.length(content) > 0, F.lit(False)))


def write_shards(rows: DataFrame, path: str) -> None:
    """Each key's rows in the folder of its shard."""
    rows.where("ok").repartition("shard").write.partitionBy("shard").json(path)


def merge_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifests of any columns as one, with their file, in the order of files."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.json(p).withColumn("file", F.lit(p.rsplit("/", 1)[-1])) for p in sorted(paths)])


def write_report(df: DataFrame, path: str) -> None:
    """CSV with columns in sorted order."""
    df.select(sorted(df.columns)).write.csv(path, header=True)


def blob_key(*columns: str) -> Column:
    """Fingerprint under which a derived file would be kept."""
    return F.sha1(F.to_json(F.struct(*sorted(columns))))
