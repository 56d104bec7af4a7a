"""Queries over the fixture tables, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, events, intervals, records, splits

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table in the shape of learner tracking."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "chat_turn").when(F.col("event_type") == "purchase", "pronun_scored").when(F.col("event_type") == "click", "topik_answered").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("event_type"), F.col("user_id").cast("string").alias("session_id"), F.floor(F.col("value") * 1000).cast("int").alias("duration_ms"), F.col("value").alias("score_overall"), (k / 100).alias("cer"), (k % 2 == 0).alias("is_correct"), "ts")


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


TRACK = """
WITH e AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'chat_turn' WHEN 'purchase' THEN 'pronun_scored' WHEN 'click' THEN 'topik_answered' ELSE event_type END AS event_type,
    user_id::VARCHAR AS session_id, floor(value * 1000)::INT AS duration_ms, value AS score_overall, (props->>'$.k')::INT / 100.0::DOUBLE AS cer, (props->>'$.k')::INT % 2 = 0 AS is_correct
  FROM events)
"""
TRACK_COLUMNS = """
  count(*) FILTER (event_type = 'chat_turn') AS chat_turns, coalesce(max(duration_ms) FILTER (event_type = 'chat_turn'), 0)::BIGINT AS chat_latency_max_ms,
  count(*) FILTER (event_type = 'pronun_scored') AS pronun_attempts, coalesce(max(duration_ms) FILTER (event_type = 'pronun_scored'), 0)::BIGINT AS pronun_latency_max_ms,
  round(coalesce(avg(score_overall) FILTER (event_type = 'pronun_scored'), 0.0)::DECIMAL(20,10), 4)::DOUBLE AS pronun_score_avg, round(coalesce(avg(cer) FILTER (event_type = 'pronun_scored'), 0.0)::DECIMAL(20,10), 4)::DOUBLE AS pronun_cer_avg,
  count(*) FILTER (event_type = 'topik_answered') AS topik_answered, coalesce(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) FILTER (event_type = 'topik_answered'), 0)::BIGINT AS topik_correct,
  coalesce(round(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) FILTER (event_type = 'topik_answered') / nullif(count(*) FILTER (event_type = 'topik_answered'), 0), 4), 0.0)::DOUBLE AS topik_accuracy,
  coalesce(max(duration_ms) FILTER (event_type = 'topik_answered'), 0)::BIGINT AS topik_latency_max_ms
"""


@query(f"{TRACK} SELECT 'global' AS scope, count(DISTINCT session_id) AS unique_sessions, {TRACK_COLUMNS} FROM e")
def track_summary_global(spark, sf_dir):
    return events.tracking_summary(tracking_events(spark, sf_dir))


@query(f"{TRACK} SELECT 'session' AS scope, 1::BIGINT AS unique_sessions, {TRACK_COLUMNS} FROM e WHERE session_id = '7'")
def track_summary_session(spark, sf_dir):
    return events.tracking_summary(tracking_events(spark, sf_dir), "7")


@query(f"{TRACK} SELECT session_id, {TRACK_COLUMNS} FROM e GROUP BY session_id")
def track_summary_by_session(spark, sf_dir):
    return events.tracking_summary_by(tracking_events(spark, sf_dir))


@query("SELECT event_id, user_id, event_type FROM events")
def events_dedup_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    twice = e.withColumn("seq", F.lit(0)).union(e.withColumn("event_type", F.lit("copy")).withColumn("seq", F.lit(1)))
    return dedup.first_of(twice, ["event_id"], ["seq"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def events_batch_insert(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seq", F.lit(0))
    return events.batch_insert(e.where("event_id % 3 = 0"), e.union(e), "event_id", ("seq", "ts")).select("event_id", "user_id")


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS created, (2 * count(*) - count(*) FILTER (event_id % 3 <> 0))::BIGINT AS duplicates FROM events")
def events_insert_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.insert_counts(e.where("event_id % 3 = 0"), e.union(e))


@query("""SELECT event_id, min_by(event_id, {'ts': ts, 'event_id': event_id}) OVER (PARTITION BY user_id, event_type) AS prior_event_id FROM events""")
def idempotent_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("idempotency_key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return events.prior_event(e).select("event_id", "prior_event_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return records.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


QUEUE = "SELECT o_orderkey, o_orderdate, coalesce(n, 0) AS done, greatest(0, 5 - coalesce(n, 0)) AS remaining FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE coalesce(n, 0) < 5"


def _queue(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.open_queue(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), log, "o_orderkey")


@query(QUEUE)
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir)


@query(f"SELECT * FROM ({QUEUE}) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def review_queue_page(spark, sf_dir):
    return records.page(_queue(spark, sf_dir), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50, 25)


@query(f"SELECT count(*) AS total, greatest(0, least(25, count(*) - 50))::BIGINT AS returned FROM ({QUEUE})")
def review_queue_counts(spark, sf_dir):
    return records.page_counts(_queue(spark, sf_dir), 50, 25)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, n AS count_after, n >= 5 AS finalize FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)""")
def review_ordinal(spark, sf_dir):
    cols = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return records.ordinal(table(spark, sf_dir, "lineitem").select("l_orderkey", *cols), ["l_orderkey"], cols).drop("l_shipdate")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_ts FROM orders GROUP BY o_custkey")
def contributor_profile(spark, sf_dir):
    return records.profile(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderdate").withColumn("total", F.round("total", 2))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5")
def history_last5(spark, sf_dir):
    return records.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn").desc()], 5)


REASON = """CASE WHEN regexp_full_match(coalesce(text, ''), '\\s*') THEN 'empty' WHEN length(text) < 40 THEN 'too_short' WHEN contains(text, '!! ') THEN 'shouting' WHEN contains(text, ' | ') THEN 'table'
  WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.5 * length(text) THEN 'few_letters' END"""


def _reasons(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    reason = (
        F.when(text.rlike(r"^\s*$"), "empty").when(F.length(text) < 40, "too_short").when(text.contains("!! "), "shouting").when(text.contains(" | "), "table")
        .when(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) < 0.5 * F.length(text), "few_letters")
    )
    return docs.select("doc_id", reason.alias("reason"))


@query(f"SELECT doc_id, {REASON} AS reason FROM documents")
def doc_clean_reasons(spark, sf_dir):
    return _reasons(table(spark, sf_dir, "documents"))


@query(f"WITH r AS (SELECT {REASON} AS reason FROM documents) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY ALL")
def doc_drop_counts(spark, sf_dir):
    return records.frequencies(_reasons(table(spark, sf_dir, "documents")).select(F.coalesce("reason", F.lit("kept")).alias("reason")), "reason")


@query("SELECT sig, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(coalesce(lang, '') || '|' || coalesce(text, '')) AS sig FROM documents) GROUP BY sig")
def doc_dedup_ordered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", dedup.ordered_signature("lang", "text").alias("sig"))
    return dedup.first_of(d, ["sig"], ["doc_id"]).select("sig", "doc_id")


@query("SELECT sig, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, md5(p_brand || '||' || array_to_string(list_sort(string_split(p_name, ' ')), '||')) AS sig FROM part) GROUP BY sig")
def doc_dedup_unordered(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", dedup.unordered_signature("p_brand", options=F.split("p_name", " ")).alias("sig"))
    return dedup.first_of(p, ["sig"], ["p_partkey"]).select("sig", "p_partkey")


@query("SELECT doc_id, copy FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents) WHERE copy > 1")
def doc_duplicates(spark, sf_dir):
    return dedup.duplicates_of(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", "copy")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.6) FROM lineitem) THEN 3 ELSE 2 END AS score FROM lineitem")
def margin_score(spark, sf_dir):
    return records.quantile_classes(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.6).drop("threshold")


@query("""WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal AS a, c_acctbal * 0.5 + 10 AS b, abs(c_acctbal) AS c, 100.0::DOUBLE AS d, chr((97 + c_custkey % 4)::INT) AS gold FROM customer),
  m AS (SELECT *, greatest(a, b, c, d) AS top FROM s)
  SELECT c_custkey, CASE WHEN a = top THEN 'a' WHEN b = top THEN 'b' WHEN c = top THEN 'c' ELSE 'd' END AS pred,
  CASE gold WHEN 'a' THEN a - greatest(b, c, d) WHEN 'b' THEN b - greatest(a, c, d) WHEN 'c' THEN c - greatest(a, b, d) ELSE d - greatest(a, b, c) END AS margin FROM m""")
def option_margin(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_acctbal") * 0.5 + 10).alias("b"), F.abs("c_acctbal").alias("c"), F.lit(100.0).alias("d"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("gold"))
    return records.best_and_margin(s, ["a", "b", "c", "d"], "gold").select("c_custkey", "pred", "margin")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  SELECT o_orderkey, CASE WHEN r <= round_even(n * 0.9, 0) THEN 'train' WHEN r <= round_even(n * 0.9, 0) + round_even(n * 0.05, 0) THEN 'valid' ELSE 'test' END AS split FROM o""")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", {"train": 0.9, "valid": 0.05, "test": 0.05}, "42").select("o_orderkey", "split")


@query("""WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS r, count(*) OVER () AS n FROM g)
  SELECT doc_id, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'valid' ELSE 'test' END AS split FROM documents JOIN r USING (source)""")
def group_split(spark, sf_dir):
    return splits.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", {"train": 0.8, "valid": 0.1, "test": 0.1}, "42").select("doc_id", "split")


TOKENS = "SELECT item_id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM benchmark)"


def _tokens(df: DataFrame, key: str, pattern: str = "[a-z]+") -> DataFrame:
    return df.select(key, F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("place", "token"))


@query(f"WITH t AS ({TOKENS}), f AS (SELECT token, min({{'item_id': item_id, 'place': place}}) AS x FROM t GROUP BY token) SELECT token, row_number() OVER (ORDER BY x) - 1 AS id FROM f")
def vocab_first_seen(spark, sf_dir):
    return records.ids_by_appearance(_tokens(table(spark, sf_dir, "benchmark"), "item_id"), "token", ["item_id", "place"])


@query(f"WITH t AS ({TOKENS}) SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM t)")
def vocab_sorted(spark, sf_dir):
    return records.ids_by_order(_tokens(table(spark, sf_dir, "benchmark"), "item_id"), "token")


@query("""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM benchmark), d AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents)
  SELECT token, count(*) AS n FROM d WHERE token NOT IN (SELECT token FROM b) GROUP BY token""")
def oov_tokens(spark, sf_dir):
    d, b = (_tokens(table(spark, sf_dir, t), k, "[a-z]{4,}") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    return records.oov(d, b.select("token").distinct(), "token")


@query("""WITH t AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)),
  c AS (SELECT doc_id, token, count(*) AS n, min(place) AS first_place FROM t WHERE token NOT IN ('the', 'of', 'and', 'in') GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_place) AS rank FROM c) WHERE rank <= 3""")
def topk_keyphrases(spark, sf_dir):
    return records.top_per_key(_tokens(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "token", "place", 3, ["the", "of", "and", "in"]).withColumn("first_place", F.col("first_place").cast("long"))


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY event_type ORDER BY n DESC, f LIMIT 3)")
def top_event_types(spark, sf_dir):
    return records.top_values(table(spark, sf_dir, "events"), "event_type", "event_id", 3).select("event_type", "n")


@query("SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3")
def groups_with_all(spark, sf_dir):
    return records.groups_with_all(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", [1, 2, 3])


RECENT = "(SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')"


@query(f"SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey NOT IN {RECENT}) OR p_partkey NOT IN {RECENT}")
def choose_excluding_recent(spark, sf_dir):
    recent = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1998-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return records.excluding_recent(table(spark, sf_dir, "part").select("p_partkey"), recent, "p_partkey")


@query("SELECT p_partkey FROM part ORDER BY md5('7|' || p_partkey), p_partkey LIMIT 10")
def seeded_choice(spark, sf_dir):
    return records.seeded_choice(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "7", 10)


@query("""WITH r(lo, hi, idx, kind) AS (VALUES (1, 10, 0, 'short'), (8, 25, 1, 'middle'), (26, 40, 2, 'long'))
  SELECT p_partkey, idx, kind FROM (SELECT p_partkey, idx, kind, row_number() OVER (PARTITION BY p_partkey ORDER BY idx) AS rn FROM part LEFT JOIN r ON p_size BETWEEN lo AND hi) WHERE rn = 1""")
def rule_range_lookup(spark, sf_dir):
    rules = spark.createDataFrame([(1, 10, 0, "short"), (8, 25, 1, "middle"), (26, 40, 2, "long")], "lo int, hi int, idx int, kind string")
    return records.range_rules(table(spark, sf_dir, "part").select("p_partkey", "p_size"), rules, "p_size").select("p_partkey", "idx", "kind")


@query("SELECT o_custkey, count(*) AS n_items, round(sum(o_totalprice), 2) AS score_total, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderdate, o_orderkey), ',') AS members FROM orders GROUP BY o_custkey")
def bundle_build(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    b = records.bundles(o, "o_custkey", "o_orderdate", "o_totalprice")
    return b.select("o_custkey", "n_items", F.round("score_total", 2).alias("score_total"), F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("members"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def bundle_explode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    b = records.bundles(o, "o_custkey", "o_orderdate", "o_totalprice")
    return b.select("o_custkey", F.posexplode("items").alias("place", "item")).select("o_custkey", "item.o_orderkey", F.col("place").cast("long").alias("place"))


def _spans(spark, sf_dir):
    ms = _millis("ts")
    return table(spark, sf_dir, "events").select("event_id", "user_id", ms.alias("start"), (ms + F.floor(F.col("value") * 1000)).alias("end"))


SPANS = "SELECT event_id, user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + floor(value * 1000)::BIGINT AS e FROM events"
GAP = 12 * 3600 * 1000
ISLANDS = f"""WITH x AS ({SPANS}), g AS (SELECT *, s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM x),
  i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


@query(f'{ISLANDS} SELECT user_id, island::BIGINT AS island, min(s) AS "start", max(e) AS "end", count(*) AS n, coalesce(max(CASE WHEN gap <= {GAP} THEN greatest(gap, 0) ELSE 0 END), 0)::BIGINT AS max_gap FROM i GROUP BY ALL')
def merge_gaps(spark, sf_dir):
    return intervals.merge_gaps(_spans(spark, sf_dir), ["user_id"], "start", "end", GAP)


@query(f"{ISLANDS} SELECT user_id, count(DISTINCT island) AS sessions, count(*) AS n FROM i GROUP BY user_id")
def session_windows(spark, sf_dir):
    return intervals.islands(_spans(spark, sf_dir), ["user_id"], "start", "end", GAP).groupBy("user_id").agg(F.count_distinct("island").alias("sessions"), F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT event_id, floor(value * 20)::BIGINT AS len FROM events), n AS (SELECT *, (1 + ceil(greatest(0, len - 600) / 200.0))::BIGINT AS k FROM x WHERE len > 0)
  SELECT event_id, i AS window_no, i * 200 AS window_start, least(len, i * 200 + 600) AS window_end FROM (SELECT event_id, len, unnest(range(k)) AS i FROM n)""")
def sliding_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit(0).cast("long").alias("start"), F.floor(F.col("value") * 20).alias("end"))
    out = intervals.sliding_windows(e, "start", "end", 600, 200)
    return out.select("event_id", F.col("window_no").cast("long").alias("window_no"), F.col("window_start").cast("long").alias("window_start"), F.col("window_end").cast("long").alias("window_end"))


HOUR = 3_600_000


def _overlapping(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = _millis("ts")
    left = e.where("event_type = 'view'").select(F.col("event_id").alias("a"), "user_id", ms.alias("start"), (ms + 6 * HOUR).alias("end"))
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("b"), "user_id", ms.alias("r_start"), (ms + 2 * HOUR).alias("r_end"))
    return left, right


OVERLAP = f"""WITH a AS (SELECT event_id AS a, user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + {6 * HOUR} AS e FROM events WHERE event_type = 'view'),
  b AS (SELECT event_id AS b, user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + {2 * HOUR} AS e FROM events WHERE event_type = 'click')"""


@query(f"{OVERLAP} SELECT a, b FROM a JOIN b ON a.user_id = b.user_id AND b.s < a.e AND b.e > a.s")
def overlap_join(spark, sf_dir):
    return intervals.overlap_join(*_overlapping(spark, sf_dir), ["user_id"], 8 * HOUR).select("a", "b")


@query(f"{OVERLAP} SELECT a, round(coalesce(sum(CASE WHEN b IS NULL THEN 0 ELSE greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) END), 0) / {6 * HOUR}, 6) AS share FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.s < a.e AND b.e > a.s GROUP BY a")
def overlap_ratio(spark, sf_dir):
    left, right = _overlapping(spark, sf_dir)
    return intervals.overlap_share(left, right, ["user_id"], "a", 8 * HOUR).select("a", F.round("share", 6).alias("share"))


@query(f"{OVERLAP} SELECT a FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND b.s < a.e AND b.e > a.s)")
def not_covered(spark, sf_dir):
    return intervals.not_covered(*_overlapping(spark, sf_dir), ["user_id"], "a", 8 * HOUR).select("a")


@query(f"{OVERLAP} SELECT b FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.s <= b.s AND b.e <= a.e)")
def contained(spark, sf_dir):
    a, b = _overlapping(spark, sf_dir)
    inner = b.withColumnsRenamed({"r_start": "start", "r_end": "end"})
    return intervals.contained(inner, a.withColumnsRenamed({"start": "r_start", "end": "r_end"}), ["user_id"], "b", 8 * HOUR).select("b")


@query("""WITH x AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS len FROM orders), p AS (SELECT o_orderkey, len, unnest(range(ceil(len / 30000.0)::BIGINT)) AS part FROM x WHERE len > 0)
  SELECT o_orderkey, part, part * 30000 AS part_start, least(len, (part + 1) * 30000) AS part_end FROM p WHERE least(len, (part + 1) * 30000) - part * 30000 >= 5000""")
def tumbling_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).cast("long").alias("start"), F.floor("o_totalprice").alias("end"))
    out = intervals.tumbling(o, "start", "end", 30000, 5000)
    return out.select("o_orderkey", *(F.col(c).cast("long").alias(c) for c in ("part", "part_start", "part_end")))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM e), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c)
  SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(i) AS first_place, max(i) AS last_place, count(*) AS n FROM r GROUP BY user_id, run""")
def event_runs(spark, sf_dir):
    out = intervals.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.withColumns({c: F.col(c).cast("long") for c in ("first_place", "last_place")})


BUCKETS = [32, 300, 1000, 4000, 20000]


@query(f"""WITH b AS (SELECT CASE WHEN n_chars > 32 AND n_chars <= 300 THEN 0 WHEN n_chars > 300 AND n_chars <= 1000 THEN 1 WHEN n_chars > 1000 AND n_chars <= 4000 THEN 2 WHEN n_chars > 4000 AND n_chars <= 20000 THEN 3 END AS bucket FROM documents)
  SELECT bucket, count(*) AS n, (ceil(count(*) / 8.0) * 8)::BIGINT AS padded FROM b WHERE bucket IS NOT NULL GROUP BY bucket""")
def length_buckets(spark, sf_dir):
    return splits.padded_sizes(splits.length_buckets(table(spark, sf_dir, "documents"), "n_chars", BUCKETS), 8)


@query("""WITH f AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part), t AS (SELECT DISTINCT p_brand, 40 AS target FROM part)
  SELECT t.p_brand, target, count(p_partkey) AS got, greatest(0, any_value(target) - count(p_partkey))::BIGINT AS missing FROM t LEFT JOIN f ON t.p_brand = f.p_brand AND r <= 40 GROUP BY t.p_brand, target""")
def quota_shortfall(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return splits.shortfall(splits.fill_quotas(p, "p_brand", ["p_retailprice", "p_partkey"], 40), p.select("p_brand").distinct().withColumn("target", F.lit(40)), "p_brand")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, (i // ((n + 6) // 7))::BIGINT AS shard FROM d""")
def contiguous_shards(spark, sf_dir):
    return splits.contiguous_shards(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents")
def round_robin_shards(spark, sf_dir):
    return splits.round_robin(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@query("""WITH l AS (SELECT user_id, event_type, arg_max((props->>'$.k')::INT, {'ts': ts, 'event_id': event_id}) AS k FROM events GROUP BY ALL)
  SELECT user_id, string_agg(event_type || '=' || k, ',' ORDER BY event_type) AS merged FROM l GROUP BY user_id""")
def map_merge_last_win(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    m = dedup.merge_maps(e, ["user_id"], "event_type", "k", ["ts", "event_id"])
    pairs = F.transform(F.array_sort(F.map_entries("merged")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return m.select("user_id", F.array_join(pairs, ",").alias("merged"))


@query("SELECT n_name, coalesce(x, 'none') AS tier FROM nation LEFT JOIN (VALUES ('FRANCE', 'a'), ('JAPAN', 'b')) v(n_name, x) USING (n_name)")
def lookup_with_fallback(spark, sf_dir):
    lexicon = spark.createDataFrame([("FRANCE", "a"), ("JAPAN", "b")], "n_name string, tier string")
    return records.lookup_with_fallback(table(spark, sf_dir, "nation").select("n_name"), lexicon, "n_name", "tier", F.lit("none"))


@query("SELECT count(*) AS n, avg((quality = (toxic = 0)::INT)::INT) AS accuracy FROM labels")
def label_accuracy(spark, sf_dir):
    return records.accuracy(table(spark, sf_dir, "labels").withColumn("pred", (F.col("toxic") == 0).cast("int")), "quality", "pred")


@query("SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER w AS prev, lead(l_partkey) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def line_neighbours(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # noqa: E741
    return intervals.neighbours(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_partkey").drop("l_suppkey", "l_extendedprice")
