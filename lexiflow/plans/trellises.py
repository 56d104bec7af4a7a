"""Queries on alignments over emissions that events stand for, each with its dynamic programme as a fold in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import trellis
from .catalogue import query, table

TYPES = ("view", "click", "purchase", "signup", "error")
RIVALS = {1: "a", 2: "a", 3: "b", 4: "b", 5: "b"}
KIND = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " END"
#: Log probabilities in eighths, so that sums are exact: the event's own label is near, the blank and others farther.
EMISSION = f"CASE WHEN v = {KIND} THEN -((event_id % 5) / 8.0) WHEN v = 0 THEN -((event_id % 7 + 2) / 8.0) ELSE -(((event_id * (v + 3)) % 11 + 8) / 8.0) END"


@query(f"""WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
  e AS MATERIALIZED (SELECT user_id, t, list({EMISSION} ORDER BY v) AS e FROM r, (SELECT unnest(range(6)) AS v) GROUP BY user_id, t),
  u AS (SELECT user_id, list({KIND} ORDER BY t) AS labels FROM r WHERE t % 6 = 2 GROUP BY user_id),
  x AS MATERIALIZED (SELECT user_id, labels, list_append(flatten(list_transform(labels, lambda l: [0, l])), 0) AS s, (SELECT count(*) FROM r WHERE r.user_id = u.user_id) AS n FROM u),
  f AS (SELECT x.user_id, 0::BIGINT AS t, list_transform(range(len(s)), lambda m: CASE WHEN m < 2 THEN e[s[m + 1] + 1]::DOUBLE ELSE '-inf'::DOUBLE END) AS d, list_transform(s, lambda m: false) AS moved FROM x JOIN e ON e.user_id = x.user_id AND e.t = 0
    UNION ALL SELECT user_id, t, list_transform(range(len(s)), lambda m: CASE WHEN moved[m + 1] THEN d[m] ELSE d[m + 1] END + e[s[m + 1] + 1]), moved
    FROM (SELECT x.user_id, e.t, f.d, x.s, e.e, list_transform(range(len(s)), lambda m: m > 0 AND coalesce(f.d[m] > f.d[m + 1], false)) AS moved FROM f JOIN x USING (user_id) JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)),
  g AS MATERIALIZED (SELECT * FROM f),
  b AS (SELECT g.user_id, t, CASE WHEN d[len(s) - 1] > d[len(s)] THEN len(s) - 2 ELSE len(s) - 1 END AS m, moved FROM g JOIN x USING (user_id) WHERE t = n - 1
    UNION ALL SELECT g.user_id, g.t, b.m - CASE WHEN b.moved[b.m + 1] THEN 1 ELSE 0 END, g.moved FROM b JOIN g ON g.user_id = b.user_id AND g.t = b.t - 1),
  p AS (SELECT user_id, (m - 1) // 2 AS unit, t FROM b WHERE m % 2 = 1),
  a AS (SELECT x.user_id, k AS unit, labels[k + 1] AS label FROM x, LATERAL (SELECT unnest(range(len(labels))) AS k)),
  w AS MATERIALIZED (SELECT a.*, p.t, exp(e.e[label + 1]) AS own, exp(e.e[1]) AS blank, e.e[label + 1] - ln(list_sum(list_transform(list_sort(list_transform(list_filter(CASE WHEN label <= 2 THEN [1, 2] ELSE [3, 4, 5] END, lambda c: c <> label), lambda c: e.e[c + 1]), 'DESC')[1:2], lambda z: exp(z)))) AS margin
    FROM a JOIN p USING (user_id, unit) JOIN e ON e.user_id = a.user_id AND e.t = p.t),
  c AS (SELECT user_id, unit, any_value(label) AS label, min(t) AS first_frame, max(t) AS last_frame, count(*) AS n_frames, coalesce(avg(1 / (1 + exp(-margin / 0.25))) FILTER (own >= blank), avg(1 / (1 + exp(-margin / 0.25)))) AS mean FROM w GROUP BY user_id, unit)
  SELECT user_id, unit, label::BIGINT AS label, first_frame, last_frame, n_frames, round(pow(least(1.0, greatest(0.02, (mean - 0.05) / 0.95)), 0.9), 6) AS confidence FROM c""")
def forced_units(spark, sf_dir):
    """Every sixth event of a user as a text that is forced onto all of them: frames and confidence of each unit (K9)."""
    r = table(spark, sf_dir, "events").withColumn("t", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    own = F.expr(KIND)
    e = F.array(*(F.expr(EMISSION.replace("v = ", f"{v} = ").replace("(v + 3)", f"({v} + 3)")).cast("double") for v in range(6)))
    refs = r.where("t % 6 = 2").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", own.alias("x")))), lambda x: x["x"]).alias("labels")).withColumn("roles", F.lit(None).cast("array<string>"))
    found = trellis.forced_confidences(r.select("user_id", "t", e.alias("e")), refs, ["user_id"], 0, RIVALS)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS y FROM events),
  n AS MATERIALIZED (SELECT user_id, count(*) AS ty, least(count(*), 2 + user_id % 9) AS tx FROM r GROUP BY user_id),
  v AS MATERIALIZED (SELECT r.user_id, y, ty, tx, list_transform(range(tx), lambda x: ((event_id * (x + 3)) % 17) / 4.0) AS v FROM r JOIN n USING (user_id)),
  f AS (SELECT user_id, y, list_transform(range(tx), lambda x: v[x + 1]::DOUBLE) AS d FROM v WHERE y = 0
    UNION ALL SELECT v.user_id, v.y, list_transform(range(tx), lambda x: CASE WHEN x >= tx + v.y - ty AND x <= v.y THEN v.v[x + 1] + greatest(CASE WHEN x = v.y THEN -1e9 ELSE f.d[x + 1] END, CASE WHEN x = 0 THEN -1e9 ELSE f.d[x] END) ELSE v.v[x + 1]::DOUBLE END) FROM f JOIN v ON v.user_id = f.user_id AND v.y = f.y + 1),
  g AS MATERIALIZED (SELECT f.*, tx, ty FROM f JOIN n USING (user_id)),
  b AS (SELECT user_id, ty - 1 AS y, tx - 1 AS x FROM n
    UNION ALL SELECT b.user_id, b.y - 1, CASE WHEN b.x <> 0 AND (b.x = b.y OR g.d[b.x + 1] < g.d[b.x]) THEN b.x - 1 ELSE b.x END FROM b JOIN g ON g.user_id = b.user_id AND g.y = b.y - 1)
  SELECT user_id, y, x FROM b""")
def monotonic_paths(spark, sf_dir):
    """Events of a user aligned to a few columns, in order."""
    user = W.partitionBy("user_id")
    r = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(user.orderBy("ts", "event_id")) - 1).alias("y"), F.count("*").over(user).alias("ty"))
    last = F.least(F.col("ty"), F.lit(2) + F.col("user_id") % 9) - 1
    values = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda x: ((F.col("event_id") * (x + 3)) % 17) / 4.0)
    return trellis.monotonic_paths(r.select("user_id", "y", values.alias("v")), ["user_id"])
