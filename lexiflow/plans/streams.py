"""Queries that run a table through a stateful stream, each with a fold of the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import shared_path
from ..streaming import audio
from .catalogue import query, table

#: A thousand samples a second: chunks of a quarter second are 500 bytes, the window 600, a frame 100, an overlap 100.
LIMITS = audio.Limits(rate=1000, window_s=0.3, longest_s=2.0, frame_ms=50)
START = 1_700_000_000_000


def letters(window: bytes) -> str:
    """Stands for a recogniser: the small letters of the bytes."""
    return bytes(x for x in window if 97 <= x <= 122).decode()


@query(f"""WITH RECURSIVE t AS (SELECT page_id, left(x, 2 * (length(x) // 2)) AS x FROM (SELECT page_id, replace(regexp_replace(coalesce(html, ''), '[^\\x01-\\x7F]', '?', 'g'), '_', '-') AS x FROM pages)),
  c AS MATERIALIZED (SELECT page_id, k, CASE WHEN k > 0 THEN 100 ELSE 0 END AS overlap, {START} + k * 250 AS ms, substr(y, (k * 500 + 1 - CASE WHEN k > 0 THEN 100 ELSE 0 END)::INT, CASE WHEN k > 0 THEN 600 ELSE 500 END) AS raw
    FROM (SELECT page_id, array_to_string(list_transform(range((length(x) + 499) // 500), lambda k: rpad(substr(x, (k * 500 + 1)::INT, (120 * ((page_id + k) % 5))::INT), least(500, length(x) - k * 500)::INT, '_')), '') AS y FROM t) s, LATERAL (SELECT unnest(range((length(y) + 499) // 500)) AS k)),
  n AS (SELECT page_id, max(k) AS last FROM c GROUP BY page_id),
  f AS (SELECT page_id, -1::BIGINT AS k, 0 AS segment, false AS started, '' AS partial, '' AS waiting, NULL::BIGINT AS voice, 0::BIGINT AS emit, 0::BIGINT AS bytes, '' AS ring, NULL::VARCHAR AS o1, NULL::VARCHAR AS o2, 0::BIGINT AS b2, 0 AS s2 FROM n
    UNION ALL
    SELECT page_id, k, CASE WHEN closes THEN segment + 1 ELSE segment END, NOT closes, CASE WHEN closes THEN '' ELSE said END, CASE WHEN closes OR emits THEN '' ELSE later END, CASE WHEN closes OR speech THEN ms ELSE voice END, CASE WHEN closes THEN 0 WHEN emits THEN ms ELSE emit END,
      CASE WHEN closes THEN 0 ELSE bytes END, CASE WHEN closes THEN '' ELSE ring END, CASE WHEN emits THEN said END, CASE WHEN closes THEN CASE WHEN emits OR later = '' THEN said ELSE later END END, bytes, segment
    FROM (SELECT *, coalesce(NOT speech AND (ms - voice >= 700 OR bytes / 2000.0 >= 2.0), false) AS closes, CASE WHEN emits THEN merged ELSE partial END AS said, CASE WHEN hyp IS NULL THEN waiting WHEN merged <> partial THEN merged ELSE '' END AS later
    FROM (SELECT *, coalesce(hyp IS NOT NULL AND (length(replace(merged, ' ', '')) - length(replace(partial, ' ', '')) >= 2 OR ms - emit >= 900), false) AS emits
    FROM (SELECT *, CASE WHEN hyp IS NULL THEN NULL WHEN partial = '' THEN hyp WHEN best IS NULL THEN partial || ' ' || hyp ELSE partial || substr(hyp, (best + 1)::INT) END AS merged
    FROM (SELECT *, list_max(list_filter(range(4, least(length(hyp), length(replace(partial, ' ', ''))) + 1), lambda l: right(replace(partial, ' ', ''), l) = left(hyp, l))) AS best
    FROM (SELECT *, CASE WHEN length(regexp_replace(ring, '[^a-z]', '', 'g')) >= 3 THEN regexp_replace(ring, '[^a-z]', '', 'g') END AS hyp, length(core) >= 100 AND 2 * len(list_filter(range(length(core) // 100), lambda i: regexp_matches(substr(core, (i * 100 + 1)::INT, 100), '[^_]'))) >= length(core) // 100 AS speech
    FROM (SELECT f.page_id, ck AS k, segment, partial, waiting, coalesce(voice, ms) AS voice, emit, ms, core, bytes + length(core) AS bytes, right(f.ring || core, 600) AS ring
    FROM (SELECT f.*, c.k AS ck, c.ms, CASE WHEN started THEN substr(c.raw, (least(overlap, length(c.raw)) + 1)::INT) ELSE c.raw END AS core FROM f JOIN c ON c.page_id = f.page_id AND c.k = f.k + 1) f))))))),
  o AS (SELECT page_id, s2 AS segment, 'partial' AS kind, o1 AS text, b2 AS n_bytes FROM f WHERE o1 IS NOT NULL UNION ALL SELECT page_id, s2, 'final', o2, b2 FROM f WHERE o2 IS NOT NULL
    UNION ALL SELECT f.page_id, segment, 'final', CASE WHEN waiting <> '' THEN waiting ELSE partial END, bytes FROM f JOIN n ON n.page_id = f.page_id AND n.last = f.k WHERE bytes > 0)
  SELECT page_id::VARCHAR AS session_id, segment, kind, text, n_bytes FROM o""")
def audio_streams(spark, sf_dir):
    """Bytes of pages as overlapping chunks of audio, some of them silent from some place on: windows, votes, partial and final texts of a session for each page."""
    root = shared_path(spark, "stream")
    x = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x01-\x7F]", "?"), "_", "-")
    p = table(spark, sf_dir, "pages").select("page_id", x.alias("x")).withColumn("x", F.expr("left(x, 2 * (length(x) div 2))")).where("x <> ''")
    p = p.withColumn("y", F.expr("concat_ws('', transform(sequence(0, (length(x) + 499) div 500 - 1), k -> rpad(substring(x, cast(k * 500 + 1 AS int), cast(120 * ((page_id + k) % 5) AS int)), least(500, length(x) - k * 500), '_')))"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(length(y) + 499) div 500 - 1"))))
    said = F.expr("substring(y, cast(k * 500 + 1 - if(k > 0, 100, 0) AS int), if(k > 0, 600, 500))")
    chunks = p.select(F.col("page_id").cast("string").alias("session_id"), F.col("k").alias("seq"), F.lit("chunk").alias("event"), (F.lit(START) + F.col("k") * 250).alias("at_ms"), F.when(F.col("k") > 0, 50).otherwise(0).alias("overlap_ms"), F.regexp_replace(F.hex(said.cast("binary")), "5F", "00").alias("hex"))
    # Underscores stand for silence; hex digits come in pairs, so none is taken from two bytes but 'x5 Fx', which no ASCII text has.
    chunks = chunks.withColumn("payload", F.unhex("hex")).drop("hex")
    ends = chunks.groupBy("session_id").agg((F.max("seq") + 1).alias("seq"), (F.max("at_ms") + 250).alias("at_ms")).select("session_id", "seq", F.lit("eos").alias("event"), "at_ms", F.lit(0).alias("overlap_ms"), F.lit(b"").alias("payload"))
    chunks.unionByName(ends).write.parquet(f"{root}/in")
    own = spark.newSession()
    own.conf.set(*audio.PROVIDER)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a run over what there is ends with it
    stream = audio.audio_sessions(own.readStream.schema(audio.CHUNKS).parquet(f"{root}/in"), letters, LIMITS)
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select("session_id", "segment", "kind", "text", "n_bytes")
