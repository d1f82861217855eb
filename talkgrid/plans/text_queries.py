"""Queries of text functions, filters and evaluation."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from talkgrid.functions import text as T
from talkgrid.operators import evaluation as E
from talkgrid.operators import windows as W
from talkgrid.operators import people as P
from talkgrid.plans import views as V
from talkgrid.plans.registry import query

_TEXT = "SELECT doc_id, text, lang FROM documents"


@query(r"SELECT doc_id, md5(lower(regexp_replace(text, '[\s,.?!;:，。？！、；：]', '', 'g'))) AS k, length(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS n FROM documents")
def echo_keys(spark, d):
    """X01, X04, X23"""
    t = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.echo_key(t)).alias("k"), F.char_length(T.effective(t)).cast("long").alias("n"))


_PAIR = r"""WITH p AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[^a-z0-9]', '', 'g') AS b FROM conversations)"""


@query(_PAIR + """ SELECT conv_id, turn, CAST(levenshtein(a, b) AS BIGINT) AS distance, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 WHEN least(length(a), length(b)) >= 4 AND (contains(a, b) OR contains(b, a)) THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS sim FROM p WHERE b IS NOT NULL""")
def turn_similarity(spark, d):
    """X02, X03"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = V.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("a"))
    p = p.withColumn("b", F.lag("a").over(w)).where("b is not null").withColumn("distance", F.levenshtein("a", "b").cast("long"))
    return p.select("conv_id", "turn", "distance", F.round(T.similarity(F.col("a"), F.col("b"), distance=F.col("distance")), 6).alias("sim"))


@query("SELECT p_partkey AS id, lower(trim(p_name)) AS k FROM part")
def name_keys(spark, d):
    """X06"""
    return V.entities(spark, d).select("id", T.name_key(F.col("name")).alias("k"))


@query(r"SELECT item_id, CASE WHEN length(text) >= 20 THEN substr(text, 6, 15) END AS slice, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark")
def char_slices(spark, d):
    """X11, X12"""
    t = F.col("text")
    return V.table(spark, d, "benchmark").select("item_id", T.char_slice(t, F.lit(5), F.lit(20)).alias("slice"), T.quote(t).alias("q"))


@query("""SELECT p_partkey AS id, 'kg_' || substr(sha256(unhex(printf('%016X', octet_length(encode(p_brand)))) || encode(p_brand) || unhex(printf('%016X', octet_length(encode(p_name)))) || encode(p_name)), 1, 24) AS kg FROM part""")
def stable_ids(spark, d):
    """X13"""
    return V.entities(spark, d).select("id", T.stable_id("kg_", F.col("kind"), F.col("name")).alias("kg"))


@query("SELECT conv_id, sha256(CAST(count(*) AS VARCHAR) || chr(10) || string_agg(CAST(turn AS VARCHAR) || ':' || text, chr(10) ORDER BY turn)) AS source_hash FROM conversations GROUP BY 1")
def source_hashes(spark, d):
    """X14"""
    c = V.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(T.source_hash_lines("turn", "turn", "text").alias("source_hash"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: CASE WHEN regexp_matches(w, 'sk-|phc_|phx_|A-SH-|[0-9a-fA-F]{32,}') THEN '<REDACTED>' ELSE w END), ' ')) AS clean FROM documents""")
def key_redaction(spark, d):
    """X17"""
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.redact_keys(F.col("text"))).alias("clean"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, 'file://\S+', '<PATH>', 'g'), '[一-鿿]{12,}', '<TEXT>', 'g')) AS clean FROM pages")
def page_redaction(spark, d):
    """X18, X20"""
    return V.table(spark, d, "pages").select("page_id", F.md5(T.drop_cjk_runs(T.redact_file_urls(F.col("html")))).alias("clean"))


@query(r"SELECT item_id, list_count(regexp_extract_all(lower(text), '([a-z0-9]+|[\p{L}\p{N}])')) AS n, array_to_string(regexp_extract_all(lower(text), '([a-z0-9]+|[\p{L}\p{N}])'), ' ') AS tokens FROM benchmark")
def mixed_tokens(spark, d):
    """X22"""
    t = T.mixed_tokens(F.col("text"))
    return V.table(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query("SELECT conv_id, turn, printf('%02d:%02d:%02d', turn * 5000 // 3600000, turn * 5000 // 60000 % 60, turn * 5000 // 1000 % 60) AS at FROM conversations")
def clock_labels(spark, d):
    """X24"""
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.clock(F.col("turn") * 5000).alias("at"))


@query("SELECT o_orderkey AS id, CASE WHEN c IN (401, 403) THEN 'auth' WHEN c = 404 THEN 'not_found' WHEN c = 429 THEN 'rate_limit' WHEN c >= 500 THEN 'server' ELSE 'other' END AS class FROM (SELECT o_orderkey, 400 + o_orderkey % 120 AS c FROM orders)")
def status_classes(spark, d):
    """X36"""
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.status_class(400 + F.col("o_orderkey") % 120).alias("class"))


@query("SELECT c_custkey AS id, CASE WHEN length(trim(c_name)) BETWEEN 1 AND 18 THEN trim(c_name) END AS name FROM customer")
def new_names(spark, d):
    """X37"""
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.new_name(F.col("c_name"), 18).alias("name"))


@query("SELECT c_custkey AS id, lower(trim(c_name)) || '@x.org' AS email FROM customer")
def email_keys(spark, d):
    """X30"""
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.email_key(F.concat(F.lit("MailTo:"), F.regexp_replace("c_name", "#", "%23"), F.lit("@X.org"))).alias("email"))


@query("SELECT doc_id, length(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…[truncated]' ELSE text END) AS n FROM documents")
def field_caps(spark, d):
    """X33"""
    return V.table(spark, d, "documents").select("doc_id", F.char_length(T.cap_field(F.col("text"), 2000)).cast("long").alias("n"))


@query(r"""WITH s AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS e, least(60 * length(text), 4500) AS ms FROM conversations)
SELECT conv_id, turn FROM s WHERE e NOT IN ('ok', '好', '嗯') AND ms < 2500 AND length(e) <= 2""")
def noise_filter(spark, d):
    """F17, F18"""
    s = V.segments(spark, d)
    return s.where(T.is_noise(F.col("text"), F.col("end_ms") - F.col("start_ms"), F.lit("en"))).select(F.col("note_id").alias("conv_id"), F.col("seq").alias("turn"))


@query(r"SELECT doc_id FROM documents WHERE trim(text) <> '' AND NOT regexp_matches(text, '[\p{L}\p{N}]')")
def no_content(spark, d):
    """F19"""
    return V.table(spark, d, "documents").where(T.no_content(F.col("text"))).select("doc_id")


@query(r"""SELECT doc_id, lang IN ('ja', 'ko') OR (n > 0 AND k / n > 0.3) AS is_foreign FROM (SELECT doc_id, lang, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n, length(text) - length(regexp_replace(text, '[぀-ヿ가-힯]', '', 'g')) AS k FROM documents WHERE lang IS NOT NULL)""")
def foreign_filter(spark, d):
    """F20"""
    return V.table(spark, d, "documents").where("lang is not null").select("doc_id", T.is_foreign(F.col("text"), F.col("lang")).alias("is_foreign"))


@query(r"SELECT doc_id, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS cjk, length(text) - length(regexp_replace(text, '[\p{L}\p{N}]', '', 'g')) AS letters FROM documents")
def cjk_counts(spark, d):
    """F23"""
    a, b = T.cjk_share(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", a.cast("long").alias("cjk"), b.cast("long").alias("letters"))


@query(r"""SELECT conv_id AS note_id, count(*) AS n, CAST(floor(sum(ms) / 1000) AS BIGINT) AS seconds FROM (SELECT conv_id, least(60 * length(text), 4500) AS ms, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS e FROM conversations) WHERE ms >= 3000 AND e <= 200 GROUP BY 1""")
def low_density(spark, d):
    """long segments with few characters (200 here, as the table has no sparser ones)."""
    return E.low_density(V.segments(spark, d), most_chars=200)


@query(None)
def repeat_collapse(spark, d):
    """X05"""
    from pyspark.sql.functions import pandas_udf

    collapse = pandas_udf(W.repeat_collapse, "string")
    return V.table(spark, d, "documents").select("doc_id", F.md5(collapse("text")).alias("collapsed"))


@query(_PAIR + """, s AS (SELECT conv_id, a AS reference, b AS hypothesis FROM p WHERE b IS NOT NULL) SELECT conv_id, CAST(sum(levenshtein(reference, hypothesis)) AS BIGINT) AS errors, CAST(sum(length(reference)) AS BIGINT) AS chars, round(sum(levenshtein(reference, hypothesis)) / sum(length(reference)), 6) AS cer FROM s GROUP BY 1 HAVING sum(length(reference)) > 0""")
def character_error_rate(spark, d):
    """A16"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = V.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("reference"))
    return E.error_rate(p.withColumn("hypothesis", F.lag("reference").over(w)).where("hypothesis is not null"), "conv_id")


@query("""SELECT count(*) AS labeled, count(*) FILTER (toxic = quality) AS correct, round(count(*) FILTER (toxic = quality) / greatest(1, count(*) FILTER (quality IS NOT NULL)), 6) AS precision, round(count(*) FILTER (toxic = quality) / greatest(1, count(*)), 6) AS recall FROM labels""")
def precision_recall(spark, d):
    """One label stands for the prediction of the other."""
    return E.precision_recall(V.table(spark, d, "labels").select(F.col("quality").alias("want"), F.col("toxic").alias("got")))


@query("""WITH t AS (SELECT i / 100.0 AS threshold FROM range(-20, 101) r(i)), s AS (SELECT round(value / 100, 4) AS score, event_type = 'purchase' AS same FROM events)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (NOT same AND score >= threshold) AS false_accepts, count(*) FILTER (same AND score < threshold) AS false_rejects FROM t, s GROUP BY 1""")
def threshold_sweep(spark, d):
    """Scores are counted by value first; thresholds meet only the distinct buckets."""
    e = V.table(spark, d, "events").select(F.round(F.col("value") / 100, 4).alias("score"), (F.col("event_type") == "purchase").alias("same"))
    return E.threshold_sweep(e)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN i = CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY 1""")
def nearest_rank(spark, d):
    """A14"""
    return E.nearest_rank(V.table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query('SELECT user_id AS device, count(*) AS sessions, count(*) FILTER (value > 200) AS degraded, CAST(sum(event_id % 3) AS BIGINT) AS reanchors, round(max(abs(value)), 6) AS worst FROM events GROUP BY 1')
def drift_distribution(spark, d):
    """Users stand for devices."""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("device"), (F.col("value") > 200).alias("degraded"), (F.col("event_id") % 3).alias("reanchors"), F.col("value").alias("rate_ppm"))
    return P.drift_distribution(e).select("device", "sessions", "degraded", "reanchors", F.round("worst", 6).alias("worst"))


@query("""SELECT event_type, count(*) AS rows, count(*) FILTER (props IS NOT NULL) AS scored, round(sum(value) / sum(1 + user_id % 7), 6) AS rtf FROM events GROUP BY 1""")
def engine_summary(spark, d):
    """A17"""
    return E.engine_summary(V.table(spark, d, "events").select("event_type", F.col("props").alias("reference"), F.col("value").alias("elapsed_ms"), (1 + F.col("user_id") % 7).alias("audio_ms")), "event_type")


@query("SELECT text, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    """Texts that occur more than once."""
    return E.duplicates(V.table(spark, d, "documents"), "text")
