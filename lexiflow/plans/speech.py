"""Queries on alignment, scoring, Korean text and state machines over the fixture tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import canonical, hangul, numbers, phonology, streams, text
from ..operators import align, chains, intervals, machines, records, scans
from .catalogue import query, table

HANGUL = ["같이 굳이 읽고", "담요와 색연필", "많이 먹었다", "국물이 좋다", "신라의 독립", "2024-05-17 3시 30분에 사과 3개", "값이 12,500원", "학교 앞 칼날"]


def _korean(spark, sf_dir):
    """A Korean phrase beside the name of each part."""
    phrase = F.element_at(F.array(*map(F.lit, HANGUL)), (F.col("p_partkey") % len(HANGUL) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(phrase, F.lit(" "), "p_name").alias("text"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, coalesce(lag(p_name) OVER (ORDER BY p_partkey), '') AS b FROM part)
  SELECT p_partkey, round(CASE WHEN length(b) = 0 THEN 1.0 ELSE levenshtein(a, b) / length(b) END, 6)::DOUBLE AS cer FROM p""")
def char_error_rate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(before, "p_partkey", "left").withColumn("b", F.coalesce("b", F.lit("")))
    return both.select("p_partkey", F.round(align.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, coalesce(lag(p_name) OVER (ORDER BY p_partkey), '') AS b FROM part)
  SELECT p_partkey, round(CASE WHEN length(b) = 0 THEN 1.0 ELSE levenshtein(a, b) / length(b) END, 6)::DOUBLE AS cer FROM p""")
def char_error_rate_whole(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(before, "p_partkey", "left").withColumn("b", F.coalesce("b", F.lit("")))
    return both.select("p_partkey", F.round(align.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query("""SELECT l_orderkey, round(pow(avg(pow(greatest(1e-9, least(1.0, l_discount * 10)), 0.5)), 2), 6) AS power, round(sum(l_discount * sqrt(l_quantity)) / sum(sqrt(l_quantity)), 6) AS weighted,
  round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS missing FROM lineitem GROUP BY l_orderkey""")
def pronunciation_scores(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("c", F.col("l_discount") * 10)  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.round(align.power_mean("c", 0.5), 6).alias("power"), F.round(align.weighted_mean("l_discount", "l_quantity", "sqrt"), 6).alias("weighted"), F.round(align.missing_ratio("l_discount", 0.05), 6).alias("missing"))


@query()
def nw_align(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("a"), F.split(F.reverse("p_name"), "").alias("b"))
    done = p.withColumn("al", align.aligned()("a", "b"))
    return done.select("p_partkey", F.size("al.pairs").alias("n_pairs"), F.col("al.score").alias("score"), align.normal_score(F.col("al.score"), F.size("a"), F.size("b")).alias("normal"))


@query()
def nw_symbol_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("a"), F.split("p_brand", "").alias("b"))
    return align.symbol_scores(p.withColumn("pairs", align.aligned()("a", "b")["pairs"]), "p_partkey", "a", "b", "pairs")


@query()
def surface_phonology(spark, sf_dir):
    return _korean(spark, sf_dir).select("id", phonology.surface_form(phonology.Options(n_insertion=True))("text").alias("s"), hangul.jamo("text").alias("jamo"), hangul.skeleton("text").alias("skeleton")).select("id", "s.clean", "s.tags", "jamo", "skeleton")


@query()
def surface_changes(spark, sf_dir):
    return _korean(spark, sf_dir).select("id", F.explode(phonology.explained("text")).alias("c")).select("id", "c.*")


@query()
def verbalised_numbers(spark, sf_dir):
    return _korean(spark, sf_dir).select("id", *(numbers.verbalised(v)("text").alias(v) for v in numbers.VARIANTS), numbers.cleaned(["numbers", "collapse"])("text").alias("cleaned"))


@query()
def syllable_chunk_scores(spark, sf_dir):
    k = _korean(spark, sf_dir).select("id", hangul.syllable_chunks("text").alias("chunks"))
    flat = k.select("id", F.posexplode(F.flatten("chunks.jamos")).alias("place", "j")).select("id", "place", ((F.col("place") * 7 % 10) / 10).alias("conf"))
    return align.syllable_scores(k, flat, "id")


@query(f"""WITH p AS (SELECT p_partkey AS id, ({HANGUL!r})[p_partkey % {len(HANGUL)} + 1] || ' ' || p_name AS text FROM part),
  c AS (SELECT id, i, substr(text, i::INT, 1) AS ch, unicode(substr(text, i::INT, 1)) - 44032 AS n FROM (SELECT *, unnest(generate_series(1, length(text))) AS i FROM p)),
  g AS (SELECT *, n BETWEEN 0 AND 11171 AS syl, sum((n BETWEEN 0 AND 11171)::INT) OVER (PARTITION BY id ORDER BY i) - 1 AS chunk FROM c),
  s AS (SELECT id, chunk, string_agg(CASE WHEN syl OR regexp_matches(ch, '\\p{{P}}') THEN ch END, '' ORDER BY i) AS label, max(n) FILTER (syl) AS n FROM g WHERE chunk >= 0 GROUP BY id, chunk),
  f AS (SELECT *, 2 + (n % 28 > 0)::INT AS len, sum(2 + (n % 28 > 0)::INT) OVER (PARTITION BY id ORDER BY chunk)::BIGINT - 2 - (n % 28 > 0)::INT AS first, (sum(2 + (n % 28 > 0)::INT) OVER (PARTITION BY id))::BIGINT AS total FROM s),
  j AS (SELECT id, chunk, label, k, first + k AS place, total, k = 0 AND n // 588 = 11 AS silent FROM f, LATERAL (SELECT unnest(range(len)) AS k)),
  v AS (SELECT *, CASE WHEN place < total + id % 5 - 2 THEN (place * 7 % 10) / 10.0 ELSE 0.0 END::DOUBLE AS conf FROM j),
  x AS (SELECT DISTINCT id, total, unnest(range(total, total + id % 5 - 2)) AS place FROM f),
  r AS (SELECT id, chunk, label, coalesce(avg(greatest(conf, 1e-9)) FILTER (NOT silent), 0) AS conf, sum(CASE WHEN silent THEN 100 ELSE round_even(100 * conf, 0) END)::BIGINT AS shown, count(*) FILTER (silent) AS n_silent FROM v GROUP BY id, chunk, label
    UNION ALL SELECT id, NULL, '', avg(greatest((place * 7 % 10) / 10.0::DOUBLE, 1e-9)), sum(round_even(100 * ((place * 7 % 10) / 10.0::DOUBLE), 0))::BIGINT, 0 FROM x GROUP BY id)
  SELECT id, chunk::INT AS chunk, label, round(conf, 6) AS conf, round_even(100 * conf, 0)::INT AS score, shown, n_silent FROM r""")
def syllable_scores_detailed(spark, sf_dir):
    """Syllables with silent onsets, missing confidences and those beyond the last jamo."""
    k = _korean(spark, sf_dir).select("id", hangul.syllable_chunks("text").alias("chunks"))
    total = F.size(F.flatten("chunks.jamos"))
    places = k.withColumn("n", total + F.col("id") % 5 - 2).where("n > 0").select("id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("place"))
    done = align.syllable_details(k, places.withColumn("conf", (F.col("place") * 7 % 10) / 10), "id")
    shown = F.aggregate("jamo", F.lit(0).cast("long"), lambda a, x: a + x["score"])
    return done.select("id", "chunk", "label", F.round("conf", 6).alias("conf"), "score", shown.alias("shown"), F.size(F.filter("jamo", lambda x: x["silent"])).cast("long").alias("n_silent"))


@query("""WITH RECURSIVE d AS MATERIALIZED (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents),
  c AS MATERIALIZED (SELECT source, i, w, count(*) AS n FROM (SELECT source, i, unnest(w) AS w FROM d) GROUP BY ALL), q AS MATERIALIZED (SELECT source, i, sum(n * n) AS q FROM c GROUP BY ALL),
  s AS MATERIALIZED (SELECT a.source, a.i, b.i AS j, sum(a.n * b.n)::DOUBLE / sqrt((any_value(x.q) * any_value(y.q))::DOUBLE) AS sim FROM c a JOIN c b ON a.source = b.source AND a.w = b.w AND a.i < b.i JOIN q x ON x.source = a.source AND x.i = a.i JOIN q y ON y.source = b.source AND y.i = b.i GROUP BY a.source, a.i, b.i HAVING sim >= 0.9),
  k AS (SELECT source, 1::BIGINT AS i, 1::BIGINT AS last FROM d WHERE i = 1 UNION ALL SELECT k.source, d.i, CASE WHEN s.sim IS NULL THEN d.i ELSE k.last END FROM k JOIN d ON d.source = k.source AND d.i = k.i + 1 LEFT JOIN s ON s.source = k.source AND s.i = k.last AND s.j = d.i)
  SELECT source, doc_id AS kept FROM k JOIN d USING (source, i) WHERE last = i""")
def near_dup_prev_kept(spark, sf_dir):
    """Documents of a source that aren't like the last one kept."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return machines.machine_over_keys(d, ["source"], ["doc_id"], partial(machines.UnlikeLastKept, 0.9), ["doc_id", "text"], ["kept"])


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("view", "click").alias("voiced"))


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type IN ('view', 'click') AS v FROM events),
  h AS (SELECT user_id, -1::BIGINT AS i, NULL::BIGINT AS start, 0::BIGINT AS run, NULL::BOOLEAN AS last, NULL::BIGINT AS a, NULL::BIGINT AS b FROM (SELECT DISTINCT user_id FROM r)
    UNION ALL SELECT user_id, i, CASE WHEN start IS NULL AND v AND n >= 2 THEN i - n + 1 WHEN start IS NOT NULL AND NOT v AND n >= 3 THEN NULL ELSE start END, n, v, CASE WHEN start IS NOT NULL AND NOT v AND n >= 3 THEN start END, i - n + 1
    FROM (SELECT h.user_id, r.i, start, r.v, CASE WHEN r.v = last THEN run + 1 ELSE 1 END AS n FROM h JOIN r ON r.user_id = h.user_id AND r.i = h.i + 1)),
  e AS (SELECT user_id, start AS a, i + 1 AS b FROM h JOIN (SELECT user_id, max(i) AS i FROM r GROUP BY user_id) USING (user_id, i) WHERE start IS NOT NULL)
  SELECT user_id, a * 10 AS start_ms, b * 10 AS end_ms FROM (SELECT user_id, a, b FROM h WHERE a IS NOT NULL UNION ALL SELECT * FROM e)""")
def vad_hysteresis(spark, sf_dir):
    """Speech regions of frames."""
    return machines.machine_over_keys(_frames(spark, sf_dir), ["user_id"], ["ts", "event_id"], partial(machines.Hysteresis, frame_ms=10, start_ms=20, end_ms=30), ["voiced"], ["start_ms", "end_ms"])


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id, (epoch_us(ts) // 1000)::BIGINT AS s, event_type = 'error' AS silent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  x AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS c, NULL::BIGINT AS e, NULL::BIGINT AS a, NULL::BIGINT AS b FROM (SELECT DISTINCT user_id FROM r)
    UNION ALL SELECT user_id, i, CASE WHEN silent OR t - n >= 3600000 THEN NULL ELSE n END, t, CASE WHEN silent THEN c WHEN t - n >= 3600000 THEN n END, CASE WHEN silent THEN e ELSE t END
    FROM (SELECT r.user_id, r.i, silent, x.c, x.e, coalesce(x.c, r.s) AS n, r.s + 60000 AS t FROM x JOIN r ON r.user_id = x.user_id AND r.i = x.i + 1)),
  p AS (SELECT user_id, a, b FROM x WHERE a IS NOT NULL UNION ALL SELECT user_id, c, e FROM x JOIN (SELECT user_id, max(i) AS i FROM r GROUP BY user_id) USING (user_id, i) WHERE c IS NOT NULL),
  q AS (SELECT user_id, a + k * 7200000 AS start, least(b, a + (k + 1) * 7200000) AS "end" FROM (SELECT *, unnest(range(greatest(1, ceil((b - a) / 7200000)::BIGINT))) AS k FROM p WHERE b - a >= 60000))
  SELECT * FROM q WHERE "end" - start >= 60000""")
def pack_intervals(spark, sf_dir):
    """Adjacent intervals joined until a target, silence closes a pack."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("s"), (F.col("event_type") == "error").alias("silent"))
    e = e.withColumn("e", F.col("s") + 60_000)
    return machines.machine_over_keys(e, ["user_id"], ["ts", "event_id"], partial(machines.Packs, 3_600_000, 60_000, 7_200_000), ["s", "e", "silent"], ["start", "end"])


PHONES = """p AS MATERIALIZED (SELECT p_partkey, i - 1 AS i, length(p_name) AS n, (i - 1) * 100 AS s, i * 100 AS e, substr(p_name, i::INT, 1) AS l FROM (SELECT *, unnest(generate_series(1, length(p_name))) AS i FROM part))"""


def _phones(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "label"))
    return p.withColumn("s", F.col("i").cast("long") * 100).withColumn("e", F.col("s") + 100)


@query(f"""WITH RECURSIVE {PHONES}, v AS (SELECT p_partkey, i FROM (SELECT *, lag(l) OVER (PARTITION BY p_partkey ORDER BY i) AS before FROM p) WHERE l IN ('a', 'e', 'i', 'o', 'u') AND before NOT IN ('a', 'e', 'i', 'o', 'u')),
  a AS (SELECT *, coalesce((SELECT min(q.i) FROM p q WHERE q.p_partkey = p.p_partkey AND q.e >= p.s + 600), n) AS far, coalesce((SELECT min(q.i) + 1 FROM p q WHERE q.p_partkey = p.p_partkey AND q.e >= p.s + 300), n) AS near FROM p),
  b AS MATERIALIZED (SELECT p_partkey, i, n, greatest(i + 1, near, coalesce((SELECT max(v.i) FROM v WHERE v.p_partkey = a.p_partkey AND v.i > a.i + 1 AND v.i <= least(far, n - 1)), far)) AS j FROM a),
  c AS (SELECT p_partkey, 0::BIGINT AS i FROM p WHERE i = 0 UNION ALL SELECT b.p_partkey, j FROM c JOIN b ON b.p_partkey = c.p_partkey AND b.i = c.i WHERE j < n)
  SELECT p_partkey, i AS first, j AS last FROM c JOIN b USING (p_partkey, i)""")
def splice_phones(spark, sf_dir):
    """Runs of phones up to a length, cut back to a vowel after a consonant."""
    return chains.spliced(_phones(spark, sf_dir), ["p_partkey"], ["i"], "s", "e", F.lower("label").isin(*"aeiou"), 300, 600)


@query(f"""WITH {PHONES}, a AS (SELECT *, coalesce((SELECT min(q.i) + 1 FROM p q WHERE q.p_partkey = p.p_partkey AND q.e >= p.s + 300), n) AS near, coalesce((SELECT min(q.i) FROM p q WHERE q.p_partkey = p.p_partkey AND q.e > p.s + 500), n) AS far FROM p WHERE i % 2 = 0),
  b AS (SELECT p_partkey, i, s, least(least(n, greatest(i + 3, near)), greatest(far, i + 1)) AS j FROM a)
  SELECT b.p_partkey, b.i AS first, j AS last FROM b JOIN p ON p.p_partkey = b.p_partkey AND p.i = j - 1 WHERE p.e - b.s BETWEEN 300 AND 500 AND j - b.i >= 3""")
def phone_groups(spark, sf_dir):
    """Overlapping groups of phones between two lengths."""
    return chains.groups_from_each(_phones(spark, sf_dir), ["p_partkey"], ["i"], "s", "e", 300, 500, 3, 2)


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(1, length(regexp_replace(text, '[\\s\\p{Z}]', '', 'g'))) AS latin, regexp_replace(lower(coalesce(text, '')), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS head FROM documents""")
def script_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script_ratio("text", "[A-Za-z]").alias("latin"), text.norm("text").alias("head"))


@query()
def script_ratios_whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script_ratio("text", "[A-Za-z]").alias("latin"), text.norm("text").alias("norm"))


@query("SELECT doc_id, sha1(lower(source) || '|' || trim(text, ' \n\t'))[1:16] AS item FROM documents")
def stable_item_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.item_id("source", "text").alias("item"))


def _questions(spark, sf_dir):
    """Exam items from the part table: options from its columns, some of them broken."""
    p = table(spark, sf_dir, "part")
    options = F.create_map(F.lit("1"), F.col("p_brand"), F.lit("2"), F.col("p_type"), F.lit("3"), F.when(F.col("p_size") > 45, "").otherwise(F.col("p_size").cast("string")), F.lit("4"), F.when(F.col("p_partkey") % 11 == 0, F.col("p_brand")).otherwise(F.lit("none")))
    turns = F.array(F.struct(F.lit("").alias("speaker"), F.col("p_name").alias("text")))
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.col("p_name")).alias("question"), turns.alias("dialogue"), canonical.choices(options).alias("options"), (F.col("p_size") % 6).cast("string").alias("answer"), (F.col("p_size") % 5 + 1).alias("score"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'no_question' WHEN p_size > 45 THEN 'empty_option' WHEN p_partkey % 11 = 0 OR p_brand = p_type OR p_type = p_size::VARCHAR THEN 'same_options'
  WHEN p_size % 6 NOT BETWEEN 1 AND 4 THEN 'bad_answer' END AS reason FROM part""")
def question_reasons(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", canonical.first_reason(canonical.question_rules()).alias("reason"))


@query("""WITH o AS (SELECT p_partkey AS id, unnest(['A', 'B', 'C', 'D']) AS old, p_size % 6 AS a FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('5|' || id || '|' || old), old) AS n FROM o)
  SELECT id, string_agg(old, '' ORDER BY n) AS shuffled, max(CASE WHEN old = chr((64 + a)::INT) THEN chr((64 + n)::INT) END) AS answer FROM r GROUP BY id""")
def shuffled_choices(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("o", canonical.shuffled(F.col("options"), F.col("id"), "5"))
    return q.select("id", F.array_join(F.transform("o", lambda e: e["old"]), "").alias("shuffled"), canonical.relabelled(canonical.answer_letter(F.col("answer")), F.col("o")).alias("answer"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, string_agg(role || ': ' || trim(text, ' \n\t'), chr(10) ORDER BY turn) AS dialogue FROM c WHERE trim(text, ' \n\t') <> '' GROUP BY conv_id""")
def dialogue_lines(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("turns"))
    return t.select("conv_id", text.join_dialogue("turns").alias("dialogue"))


@query("""WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?…。？！]+[.!?…。？！]*'), lambda x: trim(x, ' \n\t')), lambda x: x <> ''))::INT AS n_sentences FROM d""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))


@query()
def merged_transcripts(spark, sf_dir):
    # Halves of the whole text that share 20 characters around its middle.
    c = table(spark, sf_dir, "conversations").withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    c = c.select("conv_id", "turn", F.expr("substring(text, 1, half + 10)").alias("a"), F.expr("substring(text, greatest(1, half - 9))").alias("b"))
    return c.select("conv_id", "turn", streams.merged("a", "b").alias("merged"), streams.highlighted("a", "b").alias("marked"))


SNAPS = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value FROM events)
  SELECT a.event_id, min_by(b.t, {'v': b.value, 't': b.t}) AS snapped FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 3600 AND a.t + 3600 GROUP BY a.event_id"""


def _snaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    frames = e.select("user_id", F.col("t").alias("frame_t"), F.col("value").alias("rms"))
    return intervals.snap_to_minima(e.select("event_id", "user_id", "t"), frames, ["user_id"], "event_id", "t", 3600.0).select("event_id", "snapped")


@query(SNAPS)
def boundary_snaps(spark, sf_dir):
    return _snaps(spark, sf_dir)


@query(SNAPS)
def boundary_snaps_whole(spark, sf_dir):
    return _snaps(spark, sf_dir)


@query("""WITH w AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type FROM events)
  SELECT event_id, CASE WHEN first IS NULL OR i < first THEN 'onset' WHEN i > last THEN 'coda' ELSE 'nucleus' END AS position
  FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id) AS first, max(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id) AS last FROM w)""")
def chunk_positions(spark, sf_dir):
    e = scans.plain(scans.scanned(scans.ordered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"]), i=("sum", F.lit(1)))).withColumn("v", F.col("event_type") == "purchase")
    return intervals.positions(e, ["user_id"], "i", "v").select("event_id", "position")


@query("SELECT p_partkey, coalesce(d.text, 'none') AS text FROM part LEFT JOIN (VALUES (1, 'ko text'), (2, 'vi text'), (3, 'en text')) d(p_partkey, text) USING (p_partkey)")
def described(spark, sf_dir):
    rows = spark.createDataFrame([(1, {"ko": "ko text", "en": "x"}), (2, {"vi": "vi text", "ko": " "}), (3, {"en": "en text"})], "p_partkey long, desc map<string,string>")
    out = records.description(table(spark, sf_dir, "part").select("p_partkey"), rows, "p_partkey", "ko")
    return out.select("p_partkey", F.coalesce("text", F.lit("none")).alias("text"))


@query("SELECT p_partkey, coalesce(d.text, 'none') AS text FROM part LEFT JOIN (VALUES (1, 'ko text'), (2, 'vi text'), (3, 'en text')) d(p_partkey, text) USING (p_partkey)")
def described_whole(spark, sf_dir):
    rows = spark.createDataFrame([(1, {"ko": "ko text", "en": "x"}), (2, {"vi": "vi text", "ko": " "}), (3, {"en": "en text"})], "p_partkey long, desc map<string,string>")
    out = records.description(table(spark, sf_dir, "part").select("p_partkey"), rows, "p_partkey", "ko")
    return out.select("p_partkey", F.coalesce("text", F.lit("none")).alias("text"))
