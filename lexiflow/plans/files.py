"""Queries that write tables as the files of a source, read them back and give the rows, each with its SQL.

Files stand in the shared folder; broken and blank lines are put among them where a reader has to pass over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import jsonl, lexicon, store, textgrid
from ..sources.tables import shared_path
from ..streaming import sessions
from .catalogue import query, table

PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")


def _lines(df: DataFrame, path: str) -> str:
    df.write.mode("append").text(path)
    return path


@query("SELECT p_partkey, p_name || ' 한글' AS p_name, p_size FROM part")
def jsonl_tolerant(spark, sf_dir):
    """JSON lines written in two commits, with blank and broken lines among them, that are skipped."""
    p, path = _part(spark, sf_dir).withColumn("p_name", F.concat("p_name", F.lit(" 한글"))), shared_path(spark, "jsonl")
    jsonl.write_jsonl(p.where("p_partkey % 2 = 0"), path)
    jsonl.append_jsonl(p.where("p_partkey % 2 = 1"), path)
    _lines(p.where("p_partkey % 5 = 0").select(F.when(F.col("p_partkey") % 2 == 0, "").otherwise('{"p_partkey": 1, "p_na').alias("value")), path)
    return jsonl.read_tolerant(spark, path, PART)


@query("SELECT p_partkey, p_name, p_size FROM part")
def jsonl_strict(spark, sf_dir):
    """JSON lines that all parse (A2)."""
    path = shared_path(spark, "jsonl")
    jsonl.write_jsonl(_part(spark, sf_dir), path)
    return jsonl.read_strict(spark, path, PART)


@query("SELECT sum(n)::BIGINT AS n, sum(broken)::BIGINT AS broken FROM (SELECT count(*) AS n, 0 AS broken FROM part UNION ALL SELECT count(*), count(*) FROM part WHERE p_partkey % 5 = 0)")
def jsonl_drop_counts(spark, sf_dir):
    """Rows read and broken lines (A3)."""
    path = shared_path(spark, "jsonl")
    jsonl.write_jsonl(_part(spark, sf_dir), path)
    _lines(_part(spark, sf_dir).where("p_partkey % 5 = 0").select(F.lit("{broken").alias("value")), path)
    return jsonl.drop_counts(jsonl.read_marked(spark, path, PART)).agg(F.sum("n").alias("n"), F.sum("broken").alias("broken"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def csv_rows(spark, sf_dir):
    """CSV with a header, all strings; the report's columns are sorted."""
    path = shared_path(spark, "csv")
    jsonl.write_report(_part(spark, sf_dir), path)
    return jsonl.read_csv(spark, path)


@query("SELECT p_partkey::DOUBLE AS begin, p_partkey + 0.5::DOUBLE AS \"end\", CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS label, 'words' AS type, 'corpus' AS speaker FROM part")
def csv_alignments(spark, sf_dir):
    """Alignment rows by synonyms of their headers, whatever the case, with casts and a default speaker."""
    path = shared_path(spark, "csv")
    p = _part(spark, sf_dir)
    p.select(F.col("p_partkey").alias("START"), (F.col("p_partkey") + 0.5).alias(" Finish"), F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("Text"), F.lit(" Words").alias("Tier")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return jsonl.read_alignment(spark, path).drop("file")


@query("SELECT p_partkey, '/data/' || p_partkey || '.wav' AS path FROM part")
def manifest_paths(spark, sf_dir):
    """The path of manifest rows from the first column that holds one, with a prefix replaced."""
    p = _part(spark, sf_dir)
    at = F.concat(F.lit("/old/"), F.col("p_partkey").cast("string"), F.lit(".wav"))
    rows = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, " ").otherwise(at).alias("audio"), at.alias("file"))
    return jsonl.path_column(rows, prefix=("/old", "/data")).select("p_partkey", "path")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING p_brand IN (SELECT p_brand FROM part WHERE p_size > 25)")
def paired_files(spark, sf_dir):
    """Files below a folder by their extension, and pairs of one stem (A13, A14): a folder for each brand, notes for some."""
    root = shared_path(spark, "files")
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("value"))
    p.write.partitionBy("p_brand").text(f"{root}/audio")
    table(spark, sf_dir, "part").where("p_size > 25").select("p_brand", F.col("p_name").alias("value")).write.partitionBy("p_brand").text(f"{root}/notes")
    # Part files have names of their own; the stem is that of their folder.
    stem = lambda df: df.withColumn("stem", F.regexp_extract("path", r"Brand(?:%23|#)?(\d+)/[^/]*$", 1)).groupBy("stem").agg(F.min("path").alias("path"))
    pairs = jsonl.pairs_by_stem(stem(jsonl.list_files(spark, f"{root}/audio", "txt")), stem(jsonl.list_files(spark, f"{root}/notes", "txt")))
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.withColumn("stem", F.regexp_extract("p_brand", r"(\d+)", 1)).join(pairs, "stem").select("p_brand", "n")


@query("""SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS place, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::DOUBLE AS "start", (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::DOUBLE AS "end", p_name || ' "q"' AS label FROM part""")
def textgrid_tiers(spark, sf_dir):
    """Intervals of the tier asked for of a TextGrid file for each brand, quotes unescaped."""
    from pyspark.sql import Window as W

    path = shared_path(spark, "grids")
    p = table(spark, sf_dir, "part").withColumn("k", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    k = F.col("k").cast("string")
    interval = F.concat(F.lit("        intervals ["), k, F.lit("]:\n            xmin = "), k, F.lit("\n            xmax = "), (F.col("k") + 1).cast("string"), F.lit('\n            text = "'), "p_name", F.lit(' ""q"""'))
    tier = lambda name: F.lit(f'    item []:\n        class = "IntervalTier"\n        name = "{name}"')
    rows = p.select(number.alias("brand"), F.lit(3).alias("part"), "k", interval.alias("value"))
    heads = p.select(number.alias("brand")).distinct().select("brand", F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(-1).alias("k"), v.alias("value")) for i, v in ((0, F.lit('File type = "ooTextFile"')), (1, tier("phones")), (2, tier("my words")))))).alias("h")).select("brand", "h.*")
    rows.unionByName(heads).repartition("brand").sortWithinPartitions("brand", "part", "k").select("brand", "value").write.partitionBy("brand").text(path)
    found = textgrid.pick_tier(textgrid.read_textgrids(spark, f"{path}/*"), "words")
    return found.select(F.concat(F.lit("Brand#"), F.regexp_extract("file", r"brand=(\d+)/", 1)).alias("p_brand"), "place", "start", "end", "label")


LINES = """WITH l AS (SELECT p_name, p_partkey, p_size, p_type, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)"""


@query(f"""{LINES} SELECT replace(p_name, ' ', '-') AS word, string_agg(p_size || ':' || p_type, '|' ORDER BY n) AS every, max_by(p_type, {{'p': p_size, 'n': -n}}) AS best, max_by(p_size || '.5 sil ' || p_type, n) AS last FROM l GROUP BY p_name""")
def lexicon_policies(spark, sf_dir):
    """One lexicon by its three policies: all variants, the most probable one, the last one."""
    path = shared_path(spark, "lexicon")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("\t"), F.col("p_size").cast("string"), F.lit(".5 sil "), "p_type").alias("value"))
    # Files whose names follow each other as their ranges do: the policies go by files and lines.
    p.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(path)
    every = lexicon.read_lexicon(spark, path, "append").select("word", F.struct("file", "line_no", F.concat(F.floor("prob").cast("string"), F.lit(":"), F.array_join("phones", " ")).alias("x")).alias("v"))
    every = every.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["x"]), "|").alias("every"))
    best = lexicon.read_lexicon(spark, path, "best").select("word", F.array_join("phones", " ").alias("best"))
    last = lexicon.read_lexicon(spark, path, "last", 2).select("word", F.array_join("phones", " ").alias("last"))
    return every.join(best, "word").join(last, "word")


@query("SELECT p_partkey::VARCHAR AS id, p_size::VARCHAR AS speaker, upper(p_name) AS text FROM part WHERE p_partkey % 7 <> 0")
def pipe_filelists(spark, sf_dir):
    """A pipe-separated list, rewritten through a cleaner and read back; lines with other fields are skipped."""
    first, second = shared_path(spark, "list"), shared_path(spark, "list")
    p = _part(spark, sf_dir)
    jsonl.write_filelist(p.where("p_partkey % 7 <> 0"), first, ["p_partkey", "p_size", "p_name"])
    jsonl.write_filelist(p.where("p_partkey % 7 = 0"), f"{first}/other", ["p_partkey", "p_size"])
    rows = jsonl.read_filelist(spark.newSession(), first, ["id", "speaker", "text"]).unionByName(jsonl.read_filelist(spark.newSession(), f"{first}/other", ["id", "speaker", "text"]))
    jsonl.write_filelist(rows.withColumn("text", F.upper("text")), second, ["id", "speaker", "text"])
    return jsonl.read_filelist(spark, second, ["id", "speaker", "text"])


@query("SELECT n_regionkey AS level, 'focus ' || n_regionkey AS focus, count(*)::INT AS n_items, min(n_name) AS first_item FROM nation GROUP BY n_regionkey")
def level_files(spark, sf_dir):
    """Whole-file JSON of levels with their items, and the light list of levels."""
    path = shared_path(spark, "levels")
    item = F.struct(F.col("n_name").alias("text"), F.lit("x").alias("ipa"))
    levels = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("level")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    levels.select("level", F.concat(F.lit("focus "), F.col("level").cast("string")).alias("focus"), "items", F.col("level").alias("k")).repartition("k").write.partitionBy("k").json(path)
    read = jsonl.read_levels(spark, f"{path}/*")
    light = jsonl.level_list(read)
    return read.select("level", F.size("items").alias("n_items"), F.col("items")[0]["text"].alias("first_item")).join(light, "level").select("level", "focus", "n_items", "first_item")


@query("SELECT p_partkey, sha1(p_name) AS key, sha1(p_name)[1:2] || '/' || sha1(p_name)[3:4] AS shard FROM part WHERE p_partkey % 9 <> 0")
def sharded_files(spark, sf_dir):
    """Rows in folders by the SHA-1 of their content; rows without any are counted as failed and not written."""
    path = shared_path(spark, "shards")
    p = _part(spark, sf_dir).withColumn("p_name", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")))
    jsonl.write_shards(jsonl.keyed_shards(p, "p_name"), path)
    return spark.read.option("recursiveFileLookup", True).schema("p_partkey long, key string").json(path).withColumn("shard", F.concat(F.substring("key", 1, 2), F.lit("/"), F.substring("key", 3, 2)))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS p_size, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS file FROM part")
def merged_manifests(spark, sf_dir):
    """Manifests of different columns as one, with their file."""
    root = shared_path(spark, "manifests")
    p = _part(spark, sf_dir)
    p.where("p_partkey % 2 = 0").select("p_partkey", "p_name").write.json(f"{root}/a")
    p.where("p_partkey % 2 = 1").select("p_partkey", "p_size").write.json(f"{root}/b")
    return jsonl.merge_manifests(spark, [f"{root}/b", f"{root}/a"])


@query("SELECT event_id, user_id, event_type FROM events")
def streamed_events(spark, sf_dir):
    """Append-only JSON lines as a stream, each event once within the watermark."""
    root = shared_path(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e.union(e).write.json(f"{root}/in")
    stream = sessions.deduplicated(sessions.tail(spark, f"{root}/in", "event_id long, ts timestamp, user_id long, event_type string"), late="1000 days")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events)
  SELECT user_id::VARCHAR AS session_id, count(*) AS n_partials, max(CASE WHEN n = k THEN 'done' END) AS last, count(*) * 100 AS duration_ms FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e) GROUP BY user_id""")
def recogniser_sessions(spark, sf_dir):
    """The recogniser's state over a stream of chunks, a session for each user: every chunk adds a word, the end closes it."""
    from pyspark.sql import Window as W

    root = shared_path(spark, "stream")
    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long"))
    chunk = lambda seq, event, said: (F.col("user_id").cast("string").alias("session_id"), seq.cast("long").alias("seq"), F.lit(event).alias("event"), said.alias("text"), F.lit(True).alias("speech"), F.lit(100).cast("long").alias("chunk_ms"))
    said = e.select(*chunk(F.col("seq"), "chunk", F.concat(F.lit("word"), F.md5(F.col("event_id").cast("string")))))
    ends = e.groupBy("user_id").agg(F.max("seq").alias("seq")).select(*chunk(F.col("seq") + 1, "eos", F.lit("")))
    # A file holds whole sessions, their chunks in order: the state machine takes them as they come.
    said.union(ends).repartition("session_id").sortWithinPartitions("session_id", "seq").write.json(f"{root}/in")
    stream = sessions.recognised(sessions.tail(spark, f"{root}/in", "session_id string, seq long, event string, text string, speech boolean, chunk_ms long"))
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(stream.schema).parquet(f"{root}/out").where("out_of_order = 0")
    return made.groupBy("session_id").agg(F.count_if(F.col("kind") == "partial").alias("n_partials"), F.max(F.when((F.col("kind") == "final") & (F.length("text") > 0), "done")).alias("last"), F.max(F.when(F.col("kind") == "final", F.col("duration_ms"))).alias("duration_ms"))


@query("SELECT DISTINCT sha1('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS key, event_type || ':' || user_id AS source, upper(event_type) || '#' || length(event_type) AS blob FROM events")
def stored_blobs(spark, sf_dir):
    """Derived values kept under a fingerprint and built once (A5, A6, A28): a stream is put, replayed by the same writer, and put by another one."""
    root = shared_path(spark, "store")
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    e.withColumn("key", jsonl.blob_key("event_type", "user_id")).withColumn("source", F.concat_ws(":", "event_type", "user_id")).select("key", "source").repartition(4).write.parquet(f"{root}/in")
    kept = store.Store(spark, f"{root}/kept", "key string, source string, blob string")
    kind = F.substring_index("source", ":", 1)
    build = lambda rows: rows.withColumn("blob", F.concat_ws("#", F.upper(kind), F.length(kind).cast("string")))
    for run, writer in (("a", "one"), ("b", "one"), ("c", "two")):
        stream = spark.readStream.schema("key string, source string").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        stream.writeStream.foreachBatch(kept.sink(writer, build)).option("checkpointLocation", f"{root}/state-{run}").trigger(availableNow=True).start().awaitTermination()
    return kept.rows()


@query("""SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 100 = 0 THEN 99 ELSE p_size END AS p_size FROM part""")
def updated_buckets(spark, sf_dir):
    """A table updated where it lies: only buckets that hold updated keys are written again."""
    path, schema = shared_path(spark, "buckets"), "p_partkey long, p_name string, p_size int"
    p = _part(spark, sf_dir)
    store.write_buckets(p, path, "p_partkey", 64)
    new = p.where("p_partkey % 50 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), F.when(F.col("p_partkey") % 100 == 0, 99).alias("p_size"))
    store.update_buckets(spark, path, schema, new, "p_partkey", 64)
    return store.read_buckets(spark, path, schema).drop("_bucket")
