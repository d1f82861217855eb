"""The driver's tables as the engine's relations, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_entities(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("mention_count"))


def mentions(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("paragraph_index"))


def entities(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("alias"))


def notes(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), F.col("o_orderstatus").alias("state"))


def segments(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    start = F.col("turn") * 5000
    return t.select(F.col("conv_id").alias("note_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text", start.alias("start_ms"), (start + F.least(60 * F.char_length("text"), F.lit(4500))).cast("long").alias("end_ms"))


def relations(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id")).agg(F.min("l_shipdate").alias("valid_from"), F.max("l_shipdate").alias("valid_to"), F.round(1 - F.avg("l_discount"), 6).alias("confidence"), F.count(F.lit(1)).alias("evidence_count"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("person_id"), (F.col("vec_id") % 2).alias("source"), "vec_id", "embedding")


NE = "ne AS (SELECT l_orderkey AS note_id, l_partkey AS entity_id, count(*) AS mention_count FROM lineitem GROUP BY 1, 2)"
ENT = "ent AS (SELECT p_partkey AS id, p_brand AS kind, p_name AS name, p_type AS alias FROM part)"
NOTES = "notes AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS started_at, o_orderstatus AS state FROM orders)"
SEG = "seg AS (SELECT conv_id AS note_id, turn AS seq, role AS speaker, text, turn * 5000 AS start_ms, turn * 5000 + least(60 * length(text), 4500) AS end_ms FROM conversations)"
REL = "rel AS (SELECT l_suppkey AS subject_id, l_partkey AS object_id, min(l_shipdate) AS valid_from, max(l_shipdate) AS valid_to, round(1 - avg(l_discount), 6) AS confidence, count(*) AS evidence_count FROM lineitem GROUP BY 1, 2)"
VEC = "vec AS (SELECT label AS person_id, vec_id % 2 AS source, vec_id, embedding FROM embeddings)"
