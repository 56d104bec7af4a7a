"""Queries in SQL over the library's registered functions, and covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..operators import cover
from .catalogue import query, table


def _session(spark, sf_dir, *names):
    """A session of its own, with the functions and the tables as views."""
    own = spark.newSession()
    registry.register(own)
    for name in names:
        own.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return own


@query()
def sql_aligned_pairs(spark, sf_dir):
    """Alignment pairs of a name and its reverse by a table function in SQL."""
    return _session(spark, sf_dir, "part").sql("SELECT p_partkey, x.* FROM part, LATERAL align_pairs(split(p_name, ''), split(reverse(p_name), ''), -0.5, -1.0) AS x")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
  r AS (SELECT *, sum(CASE WHEN before = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS run FROM p)
  SELECT user_id::VARCHAR AS key, run, event_type AS label, min(i) AS first_place, max(i) AS last_place FROM r GROUP BY ALL""")
def sql_label_runs(spark, sf_dir):
    """Runs of equal labels by a table function over a partitioned table argument in SQL."""
    return _session(spark, sf_dir, "events").sql("SELECT * FROM label_runs(TABLE(SELECT user_id, event_id, ts, event_type FROM events), key => 'user_id', label => 'event_type', `order` => 'ts,event_id')")


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS cleaned FROM documents""")
def sql_cleaned_texts(spark, sf_dir):
    """A chain of cleaners by their names in SQL."""
    return _session(spark, sf_dir, "documents").sql("SELECT doc_id, clean_text(text, 'lowercase,collapse') AS cleaned FROM documents")


@query()
def covering_names(spark, sf_dir):
    """Parts whose names and types hold every run of three letters that any has."""
    p = table(spark, sf_dir, "part").withColumn("x", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    p = p.withColumn("units", F.expr("transform(sequence(1, length(x) - 2), i -> substring(x, i, 3))"))
    return cover.greedy_cover(p, "p_partkey", "units", "7")
