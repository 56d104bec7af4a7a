"""Queries on greedy chains over long keys, each with its SQL, which walks the rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains
from .catalogue import query, table

HOUR = 3_600_000
TARGET, LEAST, MOST = 2 * HOUR, 60_000, 5 * HOUR


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type, (epoch_us(ts) // 1000)::BIGINT AS s FROM events),
  w AS MATERIALIZED (SELECT user_id, s - {HOUR} AS ws, s + {20 * HOUR} AS we FROM e WHERE event_id % 3 = 0),
  r AS MATERIALIZED (SELECT user_id, s, s + 60000 AS e, event_type = 'error' AS silent, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i,
    CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id) THEN coalesce((SELECT max(we) FROM w WHERE w.user_id = e.user_id AND ws <= s), -4611686018427387904) END AS lim FROM e),
  x AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS cs, NULL::BIGINT AS ce, NULL::BIGINT AS lim, NULL::BIGINT AS s1, NULL::BIGINT AS e1, NULL::BIGINT AS s2, NULL::BIGINT AS e2 FROM (SELECT DISTINCT user_id FROM r)
    UNION ALL
    SELECT user_id, i, CASE WHEN hit THEN NULL ELSE ns END, CASE WHEN hit THEN NULL ELSE ne END, nl, CASE WHEN away THEN cs END, CASE WHEN away THEN ce END, CASE WHEN hit THEN ns END, CASE WHEN hit THEN ne END
    FROM (SELECT *, coalesce(ne - ns >= {TARGET}, false) AS hit FROM (SELECT r.user_id, r.i, cs, ce,
      cs IS NOT NULL AND (coalesce(r.silent, true) OR coalesce(r.e > x.lim, false)) AS away,
      CASE WHEN NOT r.silent THEN CASE WHEN cs IS NULL OR coalesce(r.e > x.lim, false) THEN r.s ELSE cs END END AS ns, CASE WHEN NOT r.silent THEN r.e END AS ne,
      CASE WHEN NOT r.silent THEN CASE WHEN cs IS NULL OR coalesce(r.e > x.lim, false) THEN r.lim ELSE x.lim END END AS nl
      FROM x JOIN (SELECT * FROM r UNION ALL SELECT user_id, max(s) + 1, NULL, true, max(i) + 1, NULL FROM r GROUP BY user_id) r ON r.user_id = x.user_id AND r.i = x.i + 1))),
  packs AS (SELECT user_id, s1 AS s, e1 AS e FROM x WHERE s1 IS NOT NULL UNION ALL SELECT user_id, s2, e2 FROM x WHERE s2 IS NOT NULL),
  parts AS (SELECT user_id, s + k * {MOST} AS "start", least(e, s + (k + 1) * {MOST}) AS "end" FROM (SELECT *, unnest(range(greatest(1, ceil((e - s) / {MOST})::BIGINT))) AS k FROM packs WHERE e - s >= {LEAST}))
  SELECT * FROM parts WHERE "end" - "start" >= {LEAST}""")
def interval_packs(spark, sf_dir):
    """Adjacent intervals joined until a target, within words and between silences (E8), by doubled pointers."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("s"), (F.col("event_type") == "error").alias("silent"))
    words = e.where("event_id % 3 = 0").select("user_id", (F.col("s") - HOUR).alias("start"), (F.col("s") + 20 * HOUR).alias("end"))
    rows = chains.word_limits(e, words, ["user_id"], "s").withColumn("e", F.col("s") + 60_000)
    return chains.packs(rows, ["user_id"], ["s", "event_id"], "s", "e", "silent", TARGET, LEAST, MOST, limit="limit")


LETTERS = """p AS MATERIALIZED (SELECT p_brand, (p_partkey * 20 + i) * 100 AS s, (p_partkey * 20 + i) * 100 + 60 + 20 * (ascii(l) % 3) AS e, l, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, i) - 1 AS i
    FROM (SELECT p_brand, p_partkey, i, substr(p_name, i::INT, 1) AS l FROM (SELECT *, unnest(generate_series(1, length(p_name))) AS i FROM part)) WHERE l <> ' ')"""


def _letters(spark, sf_dir):
    """Letters of the names of a brand as phones in one sequence, each within its tenth of a second."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "l")).where("l <> ' '")
    s = (F.col("p_partkey") * 20 + F.col("i") + 1) * 100
    return p.select("p_brand", s.alias("s"), (s + 60 + 20 * (F.ascii("l") % 3)).alias("e"), "l")


VOWEL = "l IN ('a', 'e', 'i', 'o', 'u')"


@query(f"""WITH RECURSIVE {LETTERS}, n AS (SELECT p_brand, count(*) AS n FROM p GROUP BY p_brand),
  v AS (SELECT p_brand, i FROM (SELECT *, lag(l) OVER (PARTITION BY p_brand ORDER BY i) AS before FROM p) WHERE {VOWEL} AND before NOT IN ('a', 'e', 'i', 'o', 'u')),
  a AS MATERIALIZED (SELECT p_brand, i, n, coalesce((SELECT min(q.i) FROM p q WHERE q.p_brand = p.p_brand AND q.e >= p.s + 1500), n) AS far, coalesce((SELECT min(q.i) + 1 FROM p q WHERE q.p_brand = p.p_brand AND q.e >= p.s + 400), n) AS near FROM p JOIN n USING (p_brand)),
  b AS MATERIALIZED (SELECT p_brand, i, n, greatest(i + 1, near, coalesce((SELECT max(v.i) FROM v WHERE v.p_brand = a.p_brand AND v.i > a.i + 1 AND v.i <= least(far, n - 1)), far)) AS j FROM a),
  c AS (SELECT p_brand, 0::BIGINT AS i FROM n UNION ALL SELECT b.p_brand, j FROM c JOIN b ON b.p_brand = c.p_brand AND b.i = c.i WHERE j < n)
  SELECT p_brand, i AS first, j AS last FROM c JOIN b USING (p_brand, i)""")
def spliced_letters(spark, sf_dir):
    """Runs of phones up to a length, cut back to a vowel after a consonant, over one long sequence for each brand."""
    return chains.spliced(_letters(spark, sf_dir), ["p_brand"], ["s"], "s", "e", F.expr(VOWEL), 400, 1500)


WORDS = """w AS MATERIALIZED (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, k) AS i, p_partkey * 1000 + k * 400 AS s, p_partkey * 1000 + k * 400 + 50 * length(t) AS e, t, length(regexp_replace(t, '[^aeiou]', '', 'g')) AS n
    FROM (SELECT p_brand, p_partkey, string_split(p_name, ' ')[k] AS t, k FROM (SELECT *, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS k FROM part)))"""
UNIT_BOUNDS = (200, 5000)


@query(f"""WITH RECURSIVE {WORDS},
  o AS MATERIALIZED (SELECT a.*, b.e AS e2, b.t AS t2, a.n BETWEEN 1 AND 2 AND a.e - a.s BETWEEN {UNIT_BOUNDS[0]} AND {UNIT_BOUNDS[1]} AS alone, coalesce(a.n BETWEEN 1 AND 2 AND a.n + b.n <= 2 AND b.e - a.s BETWEEN {UNIT_BOUNDS[0]} AND {UNIT_BOUNDS[1]}, false) AS duo
    FROM w a LEFT JOIN w b ON b.p_brand = a.p_brand AND b.i = a.i + 1),
  c AS (SELECT DISTINCT p_brand, 1::BIGINT AS i FROM w UNION ALL SELECT o.p_brand, o.i + CASE WHEN duo AND NOT alone THEN 2 ELSE 1 END FROM c JOIN o ON o.p_brand = c.p_brand AND o.i = c.i)
  SELECT p_brand, s AS "start", CASE WHEN alone THEN e ELSE e2 END AS "end", CASE WHEN alone THEN t ELSE t || ' ' || t2 END AS text FROM c JOIN o USING (p_brand, i) WHERE alone OR duo""")
def word_units(spark, sf_dir):
    """Units of at most two syllables from one word or two neighbours, within bounds of their length."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.posexplode(F.split("p_name", " ")).alias("k", "t"))
    s = F.col("p_partkey") * 1000 + (F.col("k") + 1) * 400
    w = p.select("p_brand", s.alias("s"), (s + 50 * F.length("t")).alias("e"), "t", F.length(F.regexp_replace("t", "[^aeiou]", "")).alias("n"))
    return chains.units(w, ["p_brand"], ["s"], "s", "e", "t", "n", 2, *UNIT_BOUNDS)


PAIRS = {("e", "e"): "ee", ("l", "l"): "ll", ("o", "o"): "oo", ("l", "u"): "lu", ("u", "e"): "ue", ("i", "n"): "in", ("n", "g"): "ng", ("e", "a"): "ea"}


@query(f"""WITH RECURSIVE {LETTERS}, m(a, b, whole) AS (VALUES {", ".join(f"('{a}', '{b}', '{w}')" for (a, b), w in PAIRS.items())}),
  d AS MATERIALIZED (SELECT p_brand, i + 1 AS i, l AS phoneme, (s // 2000)::VARCHAR AS label, CASE WHEN s % 1100 = 0 THEN 'coda' ELSE 'nucleus' END AS position, CASE WHEN s % 700 <> 0 THEN (i % 11) / 8.0 END AS score, CASE WHEN i % 5 <> 0 THEN upper(l) END AS matched, e - s AS duration FROM p),
  o AS MATERIALIZED (SELECT a.*, m.whole, b.score AS score2, b.matched AS matched2, b.duration AS duration2 FROM d a LEFT JOIN d b ON b.p_brand = a.p_brand AND b.i = a.i + 1 AND a.label = b.label AND a.position = 'nucleus' AND b.position = 'nucleus' LEFT JOIN m ON m.a = a.phoneme AND m.b = b.phoneme),
  c AS (SELECT DISTINCT p_brand, 1::BIGINT AS i FROM d UNION ALL SELECT o.p_brand, o.i + CASE WHEN whole IS NULL THEN 1 ELSE 2 END FROM c JOIN o ON o.p_brand = c.p_brand AND o.i = c.i)
  SELECT p_brand, i AS place, label, coalesce(whole, phoneme) AS phoneme, position, CASE WHEN whole IS NULL THEN score ELSE (coalesce(score, 0) + coalesce(score2, 0)) / 2 END::DOUBLE AS score,
    CASE WHEN whole IS NULL THEN matched WHEN matched IS NOT NULL OR matched2 IS NOT NULL THEN coalesce(matched, '') || coalesce(matched2, '') END AS matched, CASE WHEN whole IS NULL THEN duration ELSE duration + duration2 END::DOUBLE AS duration FROM c JOIN o USING (p_brand, i)""")
def merged_letter_pairs(spark, sf_dir):
    """Neighbouring phonemes of one label that make one, each used once, with scores, matches and durations put together."""
    from pyspark.sql import Window as W

    p = _letters(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("p_brand").orderBy("s")) - 1)
    d = p.select(
        "p_brand", "s", F.floor(F.col("s") / 2000).cast("string").alias("label"), F.col("l").alias("phoneme"), F.when(F.col("s") % 1100 == 0, "coda").otherwise("nucleus").alias("position"), F.when(F.col("s") % 700 != 0, (F.col("i") % 11) / 8.0).alias("score"),
        F.when(F.col("i") % 5 != 0, F.upper("l")).alias("matched"), F.array(F.lit("tip")).alias("advice"), (F.col("e") - F.col("s")).cast("double").alias("duration"),
    )
    return chains.merged_pairs(d, ["p_brand"], ["s"], PAIRS).drop("advice")


@query(f"""WITH {LETTERS}, x AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS segment, p_size % 4 AS n FROM part),
  u AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY segment)::BIGINT AS upto FROM x),
  f AS (SELECT *, {VOWEL} AS v, l IN ('l', 'r') AS g FROM p), b AS (SELECT *, lead(v) OVER w AS after, lag(g) OVER w AS before FROM f WINDOW w AS (PARTITION BY p_brand ORDER BY i)),
  c AS (SELECT *, greatest(1, sum(CASE WHEN (g AND coalesce(after, false)) OR (v AND NOT coalesce(before, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY i))::BIGINT AS nucleus FROM b)
  SELECT c.p_brand, s, l, nucleus, coalesce((SELECT min(segment) FROM u WHERE u.p_brand = c.p_brand AND upto >= nucleus AND n > 0), (SELECT max(segment) FROM u WHERE u.p_brand = c.p_brand)) AS segment FROM c""")
def nuclei_segments(spark, sf_dir):
    """A long sequence of phones cut by the nuclei that each segment expects; a liquid goes with the vowel after it."""
    from pyspark.sql import Window as W

    expected = table(spark, sf_dir, "part").select("p_brand", (F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long").alias("segment"), (F.col("p_size") % 4).cast("long").alias("n"))
    found = chains.by_nuclei(_letters(spark, sf_dir), expected, ["p_brand"], ["s"], F.expr(VOWEL), F.col("l").isin("l", "r"))
    return found.select("p_brand", "s", "l", "nucleus", "segment")
