"""Thin queries ``opN_<name>`` over the tables of a folder, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_format
from .collocations import collocations
from .common import table
from .crf import fit_quality, quality_scores
from .decontaminate import contamination, judged
from .licenses import BLOCK, PHRASES, THRESHOLD, license_scan, template_sets
from .lloyd import lloyd
from .lm import pseudo_likelihood
from .minhash import near_duplicates
from .packing import first_line, packed
from .secrets import KINDS, LEAST, PATTERNS, REACH, ROLES, listed, secret_scan
from .secrets import BREAK as PARAGRAPH
from .substrings import remove_repeats
from .vptree import nearest
from .warc import fixity_audit, page_records, warc_manifest, with_held


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op1_license_scans_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), lines=3)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage: by the MD5 of the page_id some records lose a byte's value, some are gone."""
    mark = F.md5(F.col("page_id").cast("string"))
    broken = F.concat(F.expr("substring(record, 1, octet_length(record) - 1)"), F.lit(b"\0"))
    return records.where(~mark.startswith("f0")).withColumn("record", F.when(mark.startswith("0"), broken).otherwise(F.col("record")))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc_manifest(pages)
    return fixity_audit(manifest, with_held(manifest, damaged(page_records(pages))))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0).cast("long"), lambda a, b: a + b)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As an instruction and its answer: the first line bears no loss. A sequence has at most 64 pieces and 1,984 tokens with loss.
    done = packed(table(spark, sf_dir, "documents"), max_tokens=2048, max_segments=64, max_loss=1984, prompt=first_line(), with_ids=False, special=True)
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13), min_share=0.05)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    done = quality_scores(docs, model)
    return done.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed="3")


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = map(number, ("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("base", "linked").alias("spans"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, percent=80, top=2000)


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op1_license_scans_wrapped": op1_license_scans_wrapped,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op7_warc_fixity": op7_warc_fixity,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_packing": op6_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op8_vantage_point_search": op8_vantage_point_search,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_secret_scans": op12_secret_scans,
    "op13_phrase_collocations": op13_phrase_collocations,
}


def lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd rounds as one chain of tables; sums over components are exact integers, quotients are floors."""
    near = "SELECT v.row, v.vec_id, v.p, min({{'d': list_sum(list_transform(list_zip(v.p, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS best FROM v, c{n} c GROUP BY ALL"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), p) - 1 AS c, p AS q FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(f"""s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT best.c AS c, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{n}) GROUP BY c, i)""")
        steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.q, c0.q) AS q FROM c{n} c0 LEFT JOIN (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS q FROM s{n} GROUP BY c) m ON m.c = c0.c)""")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(n=rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = best.c"""


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {words})" for i, (label, words) in enumerate(template_sets()))
PHRASE_ROWS = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in PHRASES.items())


def secrets_sql() -> str:
    """Spans of every pattern: matches are put between two marks, and lengths of the pieces before them give their places."""
    import re

    # Letters in either case as classes: case folding of the engine goes beyond ASCII.
    either = lambda p: re.sub(r"\\[a-z](?:[0-9]+)?|\[[^\]]*\]|[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]" if len(m[0]) == 1 else m[0], p)
    patterns = {k: either(p) if k in ("assign", "endpoint", "id") else p for k, p in PATTERNS.items()}
    marked = " UNION ALL ".join(f"SELECT row, {i} AS n, '{k}' AS kind, string_split(regexp_replace(t, '{patterns[k].replace("'", "''")}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pieces FROM d" for i, k in enumerate(KINDS))
    value = " ".join(f"WHEN kind = '{k}' THEN length(regexp_extract(m, '{patterns[k].replace("'", "''")}', 2)) >= {n}" for k, n in LEAST.items())
    over = "a.row = b.row AND b.\"start\" < a.\"end\" AND a.\"start\" < b.\"end\""
    apart = lambda kind, *taken: f"""{kind} AS MATERIALIZED (SELECT * FROM hit a WHERE kind = '{kind}' AND NOT EXISTS (SELECT 1 FROM ({" UNION ALL ".join(f"SELECT * FROM {x}" for x in taken)}) b WHERE {over}))"""
    roles = ", ".join(f"('{k}', '{r}')" for k, r in ROLES.items())
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
marked AS ({marked}),
pieces AS (SELECT row, n, kind, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM marked WHERE len(pieces) > 1),
found AS (SELECT row, n, kind, i, split_part(piece, chr(2), 1) AS m, sum(length(piece) - (i > 1)::INT) OVER (PARTITION BY row, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS "start" FROM pieces),
hit AS MATERIALIZED (SELECT row, n, kind, "start", "start" + length(m) AS "end", len(regexp_extract_all(substr(t, 1, "start"), '{PARAGRAPH}')) AS scope FROM found JOIN d USING (row)
  WHERE i > 1 AND CASE {value} WHEN kind = 'key' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
base AS (SELECT * FROM hit WHERE n < 3),
{apart("endpoint", "base")}, {apart("id", "base", "endpoint")}, {apart("key", "base", "endpoint", "id")},
weak AS (SELECT * FROM endpoint UNION ALL SELECT * FROM id UNION ALL SELECT * FROM key),
role(kind, r) AS (VALUES {roles}),
part AS (SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) JOIN role USING (kind)),
linked AS (SELECT * FROM weak JOIN role USING (kind) WHERE EXISTS (SELECT 1 FROM part b WHERE b.row = weak.row AND b.scope = weak.scope AND b.r <> role.r AND 'secret' IN (b.r, role.r)
  AND greatest(b."start" - weak."end", weak."start" - b."end") BETWEEN 0 AND {REACH})),
listed AS (SELECT row, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", n) AS spans FROM (SELECT row, kind, "start", "end", n FROM base UNION ALL SELECT row, kind, "start", "end", n FROM linked) GROUP BY row),
own AS (SELECT row, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", n) AS spans FROM base GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own.spans, '')) AS base_sha256, coalesce(listed.spans, '') AS spans
FROM d LEFT JOIN own USING (row) LEFT JOIN listed USING (row)"""


ORACLE_SQL: dict[str, str] = {
    "op13_phrase_collocations": f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, lang || chr(9) || phrase AS key, count(*) AS f FROM (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM p, (VALUES (1), (2), (3), (4)) x(k) WHERE len(w) >= k)) GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, k, f AS a, j, string_split(phrase, ' ') AS w FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
scored AS (SELECT cut.lang, cut.phrase, cut.k, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.key = cut.lang || chr(9) || array_to_string(w[1:j], ' ') JOIN f y ON y.key = cut.lang || chr(9) || array_to_string(w[j + 1 : cut.k], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM worst WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = worst.lang AND c.k > worst.k AND contains(' ' || c.phrase || ' ', ' ' || worst.phrase || ' ') AND 100 * c.f >= 80 * worst.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op12_secret_scans": secrets_sql(),
    "op11_centroid_clustering": lloyd_sql(),
    "op4_chat_formatting": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|im_start|>' || CASE WHEN trim(coalesce(role, '')) = '' THEN 'user' ELSE lower(trim(replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>'))) END || chr(10)
      || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM t GROUP BY conv_id)
SELECT conv_id, len(turns)::BIGINT AS n_turns, rendered FROM c a
WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND b.conv_id <> a.conv_id AND len(b.turns) >= len(a.turns) AND b.turns[1 : len(a.turns)] = a.turns
    AND (len(b.turns) > len(a.turns) OR b.conv_id < a.conv_id))
""",
    "op7_warc_fixity": """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages WHERE page_id IS NOT NULL),
one AS (SELECT page_id, min({'digest': sha256(record), 'length': strlen(record)}) AS x FROM r GROUP BY page_id)
SELECT page_id, (page_id // 4096)::BIGINT AS file_id,
  coalesce(sum(x.length) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  x.length::BIGINT AS length, x.digest AS digest,
  CASE WHEN starts_with(md5(page_id::VARCHAR), 'f0') THEN 'missing' WHEN starts_with(md5(page_id::VARCHAR), '0') THEN 'corrupt' ELSE 'ok' END AS status
FROM one
""",
    "op1_license_scans": f"""
WITH t(number, label, words) AS (VALUES {TEMPLATE_ROWS}),
p(label, phrase) AS (VALUES {PHRASE_ROWS}),
d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
hit AS (
  SELECT row, label, s - 1 AS place
  FROM (SELECT row, label, phrase, w, unnest(generate_series(1, len(w) - len(phrase) + 1)) AS s FROM d, p WHERE len(w) >= len(phrase))
  WHERE w[s : s + len(phrase) - 1] = phrase),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM hit GROUP BY row),
blocks AS (SELECT row, w[i * {BLOCK // 2} + 1 : i * {BLOCK // 2} + {BLOCK}] AS w FROM (SELECT row, w, unnest(generate_series(0, (len(w) - 1) // {BLOCK // 2})) AS i FROM d WHERE len(w) > 0)),
near AS (
  SELECT row, label, max(len(list_intersect(words, w)) / len(words)) AS c FROM blocks, t
  WHERE len(list_intersect(words, w)) >= ceil({THRESHOLD} * len(words) - 1e-9) GROUP BY row, label),
best AS (SELECT row, max(c) AS c FROM near GROUP BY row),
own AS (SELECT row, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT DISTINCT row, label FROM hit) GROUP BY row),
every AS (SELECT row, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT row, label FROM hit UNION SELECT row, label FROM near) GROUP BY row)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(own.x, '') AS base_labels, coalesce(every.x, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN best USING (row) LEFT JOIN own USING (row) LEFT JOIN every USING (row)
""",
    "op9_benchmark_decontamination": f"""
WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS s, w FROM d, sizes WHERE len(w) >= n),
hit AS (
  SELECT doc_id, s, place.n, item_id FROM place JOIN win ON win.n = place.n AND win.phrase = array_to_string(w[s : s + place.n - 1], ' ')),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
""",
}
