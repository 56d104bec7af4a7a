"""Queries on lookups, intervals, scores, decodes and merges over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, dedup, events, intervals, records, splits
from .catalogue import query, table

HOUR = 3600


def _at():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query(f"""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events), w AS (SELECT user_id, t AS s, t + {4 * HOUR} AS e FROM p WHERE event_id % 3 = 0),
  m AS (SELECT event_id, min(CASE WHEN t - s <= e - t AND t - s <= {HOUR} THEN s WHEN e - t < t - s AND e - t <= {HOUR} THEN e END) AS moved FROM p JOIN w ON p.user_id = w.user_id AND s < t AND t < e WHERE event_id % 3 <> 0 GROUP BY event_id)
  SELECT event_id, coalesce(moved, t) AS snapped FROM p LEFT JOIN m USING (event_id) WHERE event_id % 3 <> 0""")
def edge_snaps(spark, sf_dir):
    """Points moved to the nearer edge of the interval they lie in (C8): of every three events one opens an interval."""
    p = table(spark, sf_dir, "events").select("event_id", "user_id", _at().alias("t"))
    words = p.where("event_id % 3 = 0").select("user_id", F.col("t").alias("start"), (F.col("t") + 4 * HOUR).alias("end"))
    return intervals.snap_to_edges(p.where("event_id % 3 <> 0"), words, ["user_id"], "event_id", "t", HOUR, 4 * HOUR).select("event_id", "snapped")


@query("""WITH f AS (SELECT user_id, min_by(event_id, {'ts': ts, 'event_id': event_id}) AS first_event FROM events GROUP BY user_id)
  SELECT o_orderkey, first_event FROM orders LEFT JOIN f ON user_id = o_custkey""")
def first_matches(spark, sf_dir):
    """Each row with the first listed entry of its key."""
    listing = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("first_event"))
    return records.first_match(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), listing, "o_custkey", "at").select("o_orderkey", "first_event")


@query("""SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7) AS open, o_custkey IN (SELECT user_id FROM events) AS has_file FROM orders""")
def open_work(spark, sf_dir):
    """Rows not done yet, by keys or by markers, and rows whose file is there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    open_ = records.remaining(o, done, ["o_orderkey"]).select("o_orderkey", F.lit(True).alias("open"))
    files = records.with_file(o, table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", F.lit(True).alias("has_file"))
    return o.join(open_, "o_orderkey", "left").join(files, "o_orderkey", "left").select("o_orderkey", F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("has_file", F.lit(False)).alias("has_file"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a:0-10|b:10-30' ELSE 'a:0-10|b:10-20|c:20-30' END AS zipped, CASE WHEN p_size % 2 = 0 THEN '3,1' ELSE '3,9' END AS durations FROM part""")
def zipped_priors(spark, sf_dir):
    """Segments with priors at their places, or an even split; durations through alignment pairs."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    even = F.col("p_size") % 2 == 0
    segments = F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(10).alias("start"), F.lit(30).alias("end")))
    p = p.withColumn("segments", segments).withColumn("priors", F.when(even, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    pair = lambda i, j: F.struct(i.alias("ri"), j.alias("hj"))
    pairs = F.array(pair(F.lit(0), F.lit(1)), pair(F.lit(-1), F.lit(0)), pair(F.lit(1), F.when(even, 0).otherwise(-1)))
    done = records.zip_priors(p, "segments", "priors")
    return done.select("p_partkey", F.array_join(F.transform("zipped", lambda z: F.concat(z["prior"], F.lit(":"), z["start"].cast("int").cast("string"), F.lit("-"), z["end"].cast("int").cast("string"))), "|").alias("zipped"), F.array_join(F.transform(align.transferred(pairs, F.array(F.lit(1), F.lit(3)), 9), lambda x: x.cast("string")), ",").alias("durations"))


@query("""WITH s AS (SELECT o_custkey, greatest(0.0, least(1.0, sum(o_totalprice) / greatest(1, max(2000000)))) AS r FROM orders GROUP BY o_custkey) SELECT o_custkey, round(r, 6) AS speech_ratio FROM s""")
def speech_ratios(spark, sf_dir):
    """Sums of region lengths over a total, within 0 and 1."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.lit(0.0).alias("start"), F.col("o_totalprice").alias("end"), F.lit(2_000_000).alias("total"))
    return intervals.speech_ratio(o, ["o_custkey"], "start", "end", "total").select("o_custkey", F.round("speech_ratio", 6).alias("speech_ratio"))


@query("""WITH g AS (SELECT l_orderkey, avg(l_discount * 10) AS m, avg(l_tax) AS e, count(*) AS n, coalesce(avg(l_discount) FILTER (l_discount > 0.05), avg(l_discount)) AS c FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, round(m * (1 - least(1.0, CASE WHEN n <= 2 THEN 0.1 ELSE 0.5 END * e)) * 100, 6) AS score, round(c, 6) AS confidence,
    (e * 10 < 0.35 + CASE WHEN n <= 2 THEN 0.10 WHEN n <= 5 THEN 0.05 ELSE 0.0 END AND m < 0.5) OR e * 60 < 2.0 + CASE WHEN n <= 2 THEN 0.3 ELSE 0.0 END OR (n <= 2 AND m < 0.6) OR (n <= 2 AND m >= 0.4 AND m >= 0.7 AND (e * 10 < 0.45 OR m < 0.45)) AS passed FROM g""")
def sentence_scores(spark, sf_dir):
    """Sentence scores, frame confidences and the gate over ready metrics.

    Means stand at the gate's limits, so the last bit of a sum decides: the rows of an order are added up in the table's order.
    """
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("_metadata.file_path", "_metadata.row_index", "l_discount", "l_tax").alias("x"))  # noqa: E741
    l = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))  # noqa: E741
    conf = align.frame_confidence_in_order(F.transform("x", lambda x: x["l_discount"] * 2)) / 2  # above 0.1 of twice the discount
    discount = F.transform("x", lambda x: x["l_discount"] * 10)
    g = l.select("l_orderkey", align.mean_in_order(discount).alias("m"), align.mean_in_order(F.col("x.l_tax")).alias("e"), F.size("x").cast("long").alias("n"), conf.alias("conf"))
    m, e, n = F.col("m"), F.col("e"), F.col("n")
    passed = align.gate(n * 3, e * 10, m, m * 5, e * 60, m, m, F.lit(False))
    sixth = lambda x: F.round(x * 1e6) / 1e6  # noqa: E731  (of the double, not of its shortest decimal as round(x, 6) does)
    return g.select("l_orderkey", sixth(align.sentence_score(m, e, n, 0.5)).alias("score"), sixth(F.col("conf")).alias("confidence"), passed.alias("passed"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL)[1:3], '|') AS firsts, array_to_string(list_filter(['p_name', 'p_color', 'p_size'], lambda k: k = 'p_color' OR (k = 'p_size' AND p_size % 2 = 1)), ',') AS missing, p_name AS migrated
  FROM (SELECT *, CASE WHEN p_brand = p_type THEN [p_brand, p_name] ELSE [p_brand, p_type, p_name] END AS list_distinct_in_order FROM part)""")
def array_rules(spark, sf_dir):
    """Distinct elements in order with a cap, required keys that are missing, an old text as a map."""
    p = table(spark, sf_dir, "part")
    keys = F.when(F.col("p_size") % 2 == 1, F.array(F.lit("p_name"))).otherwise(F.array(F.lit("p_name"), F.lit("p_size")))
    old = dedup.migrate_explanation(p.withColumn("old", F.col("p_name")).withColumn("texts", F.lit(None).cast("map<string,string>")), "old", "texts", "ko")
    return old.select("p_partkey", F.array_join(dedup.distinct_in_order(F.array("p_brand", "p_type", "p_brand", "p_name", F.lit("late")), 3), "|").alias("firsts"), F.array_join(dedup.missing_keys(keys, ["p_name", "p_color", "p_size"]), ",").alias("missing"), F.element_at("texts", "ko").alias("migrated"))


GAPS = f"SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 60 AS e FROM events"  # noqa: F541


@query(f"""WITH x AS ({GAPS}), g AS (SELECT *, s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM x),
  i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g),
  m AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, island), h AS (SELECT *, s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM m)
  SELECT user_id, s AS "start", e AS "end", sum(CASE WHEN gap IS NULL OR gap > {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM h""")
def gap_groups(spark, sf_dir):
    """Small gaps joined, then groups split at large ones (E5)."""
    e = table(spark, sf_dir, "events").select("user_id", _at().alias("start"), (_at() + 60).alias("end"))
    return intervals.group_by_gaps(e, ["user_id"], "start", "end", HOUR, 24 * HOUR)


@query("""WITH x AS (SELECT event_id, floor(value * 10)::BIGINT AS s, floor(value * 10)::BIGINT + event_id % 50 AS e FROM events), p AS (SELECT *, greatest(0, s - 5) AS lo, least(400, e + 5) AS hi FROM x)
  SELECT event_id, greatest(e, s + 20) AS stretched, greatest(0, lo - greatest(0, 30 - (hi - lo)) / 2)::DOUBLE AS pad_start, least(400, hi + greatest(0, 30 - (hi - lo)) / 2)::DOUBLE AS pad_end,
    greatest(1, ceil((event_id % 7) / 2.0))::BIGINT AS n_parts, round(s + (e - s) / greatest(1, ceil((event_id % 7) / 2.0)), 6)::DOUBLE AS first_end, round(greatest(0.0, e / 4.0 - e / 40.0), 6)::DOUBLE AS second_start, round(least(e, e / 2.0 + e / 40.0), 6)::DOUBLE AS second_end FROM p""")
def shaped_intervals(spark, sf_dir):
    """Least lengths, padding, even parts and uniform windows."""
    s = F.floor(F.col("value") * 10)
    x = table(spark, sf_dir, "events").select("event_id", s.alias("s"), (s + F.col("event_id") % 50).alias("e"))
    s, e = F.col("s"), F.col("e")
    lo, hi = intervals.padded(s, e, 5, 30, F.lit(400))
    parts = intervals.even_parts(s, e, F.col("event_id") % 7)
    windows = intervals.uniform_windows(e.cast("double"), 4, 0.1)
    return x.select(
        "event_id", intervals.stretched(e, e, 0).alias("_"), intervals.stretched(s, e, 20).alias("stretched"), lo.cast("double").alias("pad_start"), hi.cast("double").alias("pad_end"), F.size(parts).cast("long").alias("n_parts"), F.round(parts[0]["end"], 6).alias("first_end"),
        F.round(windows[1]["start"], 6).alias("second_start"), F.round(windows[1]["end"], 6).alias("second_end"),
    ).drop("_")


@query("""SELECT o_orderkey, 'train' AS split, NULL::VARCHAR AS note FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'valid', 'reserved' FROM orders WHERE o_orderkey % 10 = 0""")
def reserved_rows(spark, sf_dir):
    """Reserved rows added to one split."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    reserved = o.where("o_orderkey % 10 = 0").withColumn("note", F.lit("reserved"))
    return splits.with_reserved(o.where("o_orderkey % 10 <> 0").withColumn("split", F.lit("train")), reserved, "valid").select("o_orderkey", "split", "note")


@query("SELECT doc_id, (n_chars * 2) // 512 AS frames FROM documents WHERE length(text) BETWEEN 200 AND 5000")
def usable_texts(spark, sf_dir):
    """Texts of usable length with estimated frames."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") * 2).alias("size"))
    return splits.usable_lengths(d, "text", "size", 200, 5000, 512).select("doc_id", "frames")


@query("""SELECT p_name AS name, p_brand AS brand, '' AS type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, '', p_type FROM part WHERE p_partkey % 2 = 1""")
def united_tables(spark, sf_dir):
    """Tables of other columns as one, missing ones empty."""
    p = table(spark, sf_dir, "part")
    return dedup.union_all([p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), p.where("p_partkey % 2 = 1").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"))], "")


@query("SELECT DISTINCT x FROM (SELECT p_brand AS x FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation)")
def united_values(spark, sf_dir):
    """Distinct values over several tables."""
    p = table(spark, sf_dir, "part")
    return dedup.union_distinct([p.select(F.col("p_brand").alias("x")), p.select(F.col("p_type").alias("x")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("x"))], "x")


@query("""SELECT DISTINCT p_brand, p_type, sha1('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}') AS content_hash FROM part""")
def stored_once(spark, sf_dir):
    """One row for each content."""
    return events.store_once(table(spark, sf_dir, "part").select("p_brand", "p_type"), ["p_brand", "p_type"])


@query("""WITH v AS (SELECT p_name AS word, p_brand AS phones, 0 AS source, p_partkey AS line_no FROM part UNION ALL SELECT p_name, p_type, 1, p_partkey FROM part), o AS (SELECT word, phones, min({'s': source, 'l': line_no}) AS pos FROM v GROUP BY ALL)
  SELECT word, array_to_string(list(phones ORDER BY pos)[1:4], '|') AS variants FROM o GROUP BY word""")
def merged_lexicons(spark, sf_dir):
    """Variants of each word over two lexicons, distinct, capped."""
    p = table(spark, sf_dir, "part")
    one = lambda c: p.select(F.col("p_name").alias("word"), F.col(c).alias("phones"), F.col("p_partkey").alias("line_no"))
    return dedup.merge_lexicons([one("p_brand"), one("p_type")], 4).select("word", F.array_join("variants", "|").alias("variants"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 6 = 0 THEN 99 ELSE p_size END AS p_size FROM part")
def updated_rows(spark, sf_dir):
    """Rows with the non-null fields of their updates."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = p.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), F.when(F.col("p_partkey") % 6 == 0, 99).alias("p_size"))
    return dedup.update_by_key(p, new, "p_partkey")


def _letters(column: str):
    return F.filter(F.split(column, ""), lambda x: x != "")


@query("""SELECT p_partkey, length(p_name) + 2 AS n_pairs, length(p_name) - 1.0::DOUBLE AS score, 1.0::DOUBLE AS normal, length(p_name) * 1.0::DOUBLE AS soft_score FROM part""")
def nw_extended(spark, sf_dir):
    """Alignment of a name with itself and two more letters, and with another letter that counts as equal by a soft map."""
    p = table(spark, sf_dir, "part").select("p_partkey", _letters("p_name").alias("a"))
    b = F.concat("a", F.array(F.lit("#"), F.lit("@")))
    p = p.withColumn("al", align.aligned(gap=-0.5)("a", b)).withColumn("soft", align.aligned(soft={("~", x): 1.0 for x in "aeiou"})("a", F.transform("a", lambda x: F.when(x.isin(*"aeiou"), "~").otherwise(x))))
    return p.select("p_partkey", F.size("al.pairs").cast("long").alias("n_pairs"), F.col("al.score").alias("score"), F.round(align.normal_score(F.col("al.score"), F.size("a"), F.size(b)), 9).alias("normal"), F.col("soft.score").alias("soft_score"))


@query("""WITH s AS (SELECT p_partkey, p_name, length(p_name) - length(regexp_replace(p_name, '[aeiou]', '', 'g')) AS v, length(p_name) AS n FROM part), x AS (SELECT *, strpos(p_name, ' ') AS k FROM s),
  w AS (SELECT p_partkey, n, v, k - 1 AS n1, n - k AS n2, length(regexp_replace(p_name[1 : k - 1], '[^aeiou]', '', 'g')) AS v1, length(regexp_replace(p_name[k + 1 :], '[^aeiou]', '', 'g')) AS v2 FROM x)
  SELECT p_partkey, 0 AS word_no, n1 AS n, round((n1 - 1.4 * v1) / n1, 9)::DOUBLE AS avg_score, round((n - 1 - 1.4 * v) / (n - 1), 9)::DOUBLE AS overall FROM w
  UNION ALL SELECT p_partkey, 1, n2, round((n2 - 1.4 * v2) / n2, 9)::DOUBLE, round((n - 1 - 1.4 * v) / (n - 1), 9)::DOUBLE FROM w""")
def word_and_overall_scores(spark, sf_dir):
    """Scores of symbols, words and rows, a matched symbol by its similarity, which is negative here for each vowel (K4)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    flat = F.flatten(F.transform("w", lambda x: F.filter(F.split(x, ""), lambda c: c != "")))
    p = p.withColumn("a", flat).withColumn("b", F.transform("a", lambda c: F.when(c.isin(*"aeiou"), "~").otherwise(c)))
    details = align.symbol_scores(p.withColumn("pairs", align.aligned(gap=-0.3, mismatch=-0.4)("a", "b")["pairs"]), "p_partkey", "a", "b", "pairs", mismatch=-0.4)
    first = F.when(F.col("word_no") == 0, 0).otherwise(F.length(F.get("w", F.lit(0))))
    words = p.select("p_partkey", "w", F.posexplode("w").alias("word_no", "label")).select("p_partkey", "word_no", "label", F.explode(F.sequence(first, first + F.length("label") - 1)).alias("ri"), F.lit(1.0).alias("duration"))
    by_word, overall = align.word_scores(details, words, "p_partkey"), align.overall_scores(details, words, "p_partkey")
    return by_word.select("p_partkey", "word_no", "n", F.round("avg_score", 9).alias("avg_score")).join(overall.select("p_partkey", F.round("avg_score", 9).alias("overall")).hint("merge"), "p_partkey")


FRAMES = "SELECT user_id, event_id, substr(event_type, 1, 1) AS l, value / 100.0 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events"


@query(f"""WITH f AS ({FRAMES}), s AS (SELECT user_id, event_id, i, p, CASE WHEN p >= 0.08 THEN l ELSE '_' END AS l FROM f), c AS (SELECT *, lag(l) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s),
  d AS (SELECT user_id, string_agg(l, '' ORDER BY event_id) AS decoded FROM c WHERE l <> '_' AND l IS DISTINCT FROM before GROUP BY user_id),
  q AS (SELECT user_id, l, event_id, lag(l) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s WHERE l <> '_'), nb AS (SELECT user_id, string_agg(l, '' ORDER BY event_id) AS no_blank FROM q WHERE l IS DISTINCT FROM before GROUP BY user_id),
  r AS (SELECT user_id, greatest(0, min(CASE WHEN p >= 0.08 THEN i END) - 2) AS first_frame, least(max(i), max(CASE WHEN p >= 0.08 THEN i END) + 2) AS last_frame FROM f GROUP BY user_id)
  SELECT user_id, decoded, no_blank, first_frame, last_frame FROM d JOIN nb USING (user_id) JOIN r USING (user_id)""")
def greedy_decodes(spark, sf_dir):
    """Decodes with and without blanks between labels, and the crop to spoken frames (K7, K8)."""
    from pyspark.sql import Window as W

    f = table(spark, sf_dir, "events").select("user_id", "event_id", F.substring("event_type", 1, 1).alias("l"), (F.col("value") / 100).alias("p"))
    f = f.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).withColumn("blank_p", -F.col("p"))
    decode = lambda name, **o: align.greedy_decode(f, ["user_id"], "event_id", "l", "p", "_", 0.08, **o).withColumnRenamed("decoded", name)
    crop = align.speech_crop(f, ["user_id"], "i", "blank_p", -0.08 + 1e-15, 2)
    return decode("decoded").join(decode("no_blank", keep_blank=False), "user_id").join(crop.select("user_id", F.col("first_frame").cast("long").alias("first_frame"), F.col("last_frame").cast("long").alias("last_frame")), "user_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS place, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  t AS (SELECT user_id, place, 0 AS r, 'slow down' AS tip FROM e WHERE event_type IN ('error', 'click') UNION ALL SELECT user_id, place, 1, 'after view' FROM e WHERE event_type = 'error' AND prev = 'view' UNION ALL SELECT user_id, place, 2, 'first' FROM e WHERE event_type = 'click' AND place = 1),
  f AS (SELECT user_id, tip, min({'p': place, 'r': r}) AS pos FROM t GROUP BY ALL) SELECT user_id, array_to_string(list(tip ORDER BY pos)[1:2], '|') AS tips FROM f GROUP BY user_id""")
def advice_tips(spark, sf_dir):
    """Distinct tips of context rules in order, capped."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w)).withColumn("prev", F.lag("event_type").over(w)).withColumn("next", F.lead("event_type").over(w)).withColumn("position", F.when(F.col("place") == 1, "onset").otherwise("nucleus"))
    rules = spark.createDataFrame([(0, ["error", "click"], "slow down", None, None, None), (1, ["error"], "after view", None, ["view"], None), (2, ["click"], "first", "onset", None, None)], "rule_idx int, covers array<string>, tip string, rule_position string, prev_in array<string>, next_in array<string>")
    return align.advice(e, rules, ["user_id"], "event_type", 2).select("user_id", F.array_join("tips", "|").alias("tips"))


@query("""WITH e AS (SELECT user_id, event_id, event_type AS t, row_number() OVER w AS place, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  t AS (SELECT user_id, place, 0 AS r, 'glide' AS tip FROM e WHERE t IN ('view', 'signup') AND next = 'click' UNION ALL SELECT user_id, place, 1, 'start' FROM e WHERE place = 1
    UNION ALL SELECT user_id, place, 2, 'pair' FROM e WHERE (t = 'error' AND next = 'view') OR (t = 'view' AND next = 'error')),
  f AS (SELECT user_id, tip, min({'p': place, 'r': r}) AS pos FROM t GROUP BY ALL) SELECT user_id, array_to_string(list(tip ORDER BY pos)[1:3], '|') AS tips FROM f GROUP BY user_id""")
def advice_conditions(spark, sf_dir):
    """Tips by class, next vowel, surroundings and pairs in either order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("event_type").over(w))
    e = e.withColumn("class", F.when(F.col("event_type").isin("view", "signup"), "soft")).withColumn("env", F.when(F.col("place") == 1, "first"))
    rules = spark.createDataFrame(
        [(0, "glide", ["soft"], None, True, None, None), (1, "start", None, "first", None, None, None), (2, "pair", None, None, None, ["error"], ["view"])],
        "rule_idx int, tip string, class_in array<string>, rule_env string, next_is_vowel boolean, pair_a array<string>, pair_b array<string>",
    )
    return align.advice(e, rules, ["user_id"], "event_type", 3, vowels=("click",)).select("user_id", F.array_join("tips", "|").alias("tips"))


@query("""WITH i AS (SELECT user_id, event_id * 37 % 100000 AS s, event_id * 37 % 100000 + floor(value)::BIGINT * 10 + 5 AS e FROM events),
  m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
  n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
  g AS (SELECT user_id, island, min(s) AS s, max(e) AS e FROM n GROUP BY ALL), p AS (SELECT user_id, e, unnest(range(s, e, 300)) AS a FROM g)
  SELECT user_id, a AS start_ms, least(e, a + 300) AS end_ms FROM p WHERE least(e, a + 300) - a >= 50""")
def speech_clips(spark, sf_dir):
    """Regions merged over short silence, cut at a length, short ones left out."""
    start = F.col("event_id") * 37 % 100000
    regions = table(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + F.floor("value") * 10 + 5).alias("e"))
    return intervals.clips(regions, ["user_id"], "s", "e", 200, 300, 50).select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))
