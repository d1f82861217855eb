"""Scans and publication of the note store's files: JSON documents, JSON lines, ledgers, logs and versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "schema_version int, id string, title string, started_at string, ended_at string, state string, asr_engine string"
SEGMENT = "seq bigint, source string, text string, start_ms bigint, end_ms bigint, speaker string, rms float"
SPEAKERS = "map<string,struct<name:string,sources:array<string>,count:bigint,person_id:string,multi_speaker:boolean>>"
PEOPLE = "map<string,struct<name:string,aliases:array<string>,email:string,redirect:string,last_seen:string>>"
LOG = "schema_version int, id string, ts string, kind string, provider string, note_id string, model string, endpoint string, status string, error string, duration_ms bigint, truncated boolean"


def _note() -> Column:
    """The folder that a row's file lies in."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)


def parse_meta(folders: DataFrame, raw: DataFrame) -> DataFrame:
    """One row a folder from its metadata text (folder, value). Corrupt or missing metadata gives a complete note titled by
    its folder, without a start."""
    m = raw.select("folder", F.from_json("value", META, {"mode": "PERMISSIVE"}).alias("m"))
    got = folders.join(m, "folder", "left")
    bad = F.col("m.id").isNull()
    return got.select(F.coalesce("m.id", "folder").alias("id"), F.coalesce("m.title", "folder").alias("title"), F.coalesce("m.started_at", F.lit("")).alias("started_at"), F.col("m.ended_at").alias("ended_at"), F.when(bad, "complete").otherwise(F.col("m.state")).alias("state"), bad.alias("fallback"))


def scan_meta(spark: SparkSession, root: str) -> DataFrame:
    """:func:`parse_meta` of every folder's meta.json."""
    raw = spark.read.option("wholetext", True).text(f"{root}/*/meta.json").select(_note().alias("folder"), "value")
    folders = spark.read.format("binaryFile").load(f"{root}/*/*").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).distinct()
    return parse_meta(folders, raw)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines (note_id, raw) with the raw line kept: note_id, raw, ok, and the columns of the schema. Blank lines are left out."""
    r = lines.where(F.trim("raw") != "").select("note_id", "raw", F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    names = [c.strip().split()[0] for c in schema.split(",")]
    return r.select("note_id", "raw", (F.col("r").isNotNull() & F.col("r._bad").isNull()).alias("ok"), *[F.col(f"r.{c}") for c in names])


def scan_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """:func:`parse_lines` of files."""
    return parse_lines(spark.read.text(path).select(_note().alias("note_id"), F.col("value").alias("raw")), schema)


def scan_segments(spark: SparkSession, root: str) -> DataFrame:
    """Readable segments of all notes."""
    return scan_lines(spark, f"{root}/*/segments.jsonl", SEGMENT).where("ok").drop("raw", "ok")


def skipped_lines(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, skipped_lines): lines that could not be read."""
    return scan_lines(spark, f"{root}/*/segments.jsonl", SEGMENT).groupBy("note_id").agg(F.count_if(~F.col("ok")).alias("skipped_lines"))


def scan_suppressions(spark: SparkSession, root: str) -> DataFrame:
    return scan_lines(spark, f"{root}/*/segment-suppressions.jsonl", "seq bigint, reason string").where("ok and seq is not null").select("note_id", "seq").distinct()


def map_rows(raw: DataFrame, kind: str) -> DataFrame:
    """(note_id, key, item): the entries of JSON maps (note_id, value); a corrupt one has none."""
    m = F.coalesce(F.from_json("value", kind), F.expr(f"cast(map() as {kind})"))
    return raw.select("note_id", F.explode(m).alias("key", "item"))


def scan_speakers(spark: SparkSession, root: str) -> DataFrame:
    """One row a speaker; a corrupt file has none."""
    raw = spark.read.option("wholetext", True).text(f"{root}/*/speakers.json").select(_note().alias("note_id"), "value")
    return map_rows(raw, SPEAKERS).select("note_id", F.col("key").alias("speaker_id"), "item.*")


def scan_people(spark: SparkSession, path: str) -> DataFrame:
    """The person library, one row a person; a file that can't be read is an empty library."""
    raw = spark.read.option("wholetext", True).text(path).select(F.lit("").alias("note_id"), "value")
    return map_rows(raw.withColumn("value", F.get_json_object("value", "$.people")), PEOPLE).select(F.col("key").alias("id"), "item.*")


def newest(files: DataFrame, new: str, old: str) -> DataFrame:
    """(note_id, doc): of a note's files (note_id, file, value) the new one, else the legacy one."""
    mine = files.where(F.col("file").isin(new, old))
    return mine.groupBy("note_id").agg(F.min_by("value", F.when(F.col("file") == new, 0).otherwise(1)).alias("doc"))


def parse_documents(docs: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents (note_id, doc) as their fields, and those that are no such JSON object as (note_id, error)."""
    r = docs.withColumn("r", F.from_json("doc", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    object_ = F.get_json_object("doc", "$").startswith("{")
    bad = F.coalesce(~object_, F.lit(True)) | F.col("r._bad").isNotNull()
    return r.where(~bad).select("note_id", "r.*").drop("_bad"), r.where(bad).select("note_id", F.concat(F.lit("invalid document: "), F.coalesce(F.substring("doc", 1, 40), F.lit(""))).alias("error"))


def scan_documents(spark: SparkSession, root: str, new: str = "aing.json", old: str = "refined.json") -> DataFrame:
    """(note_id, doc, error): the new document, else the legacy one; text that is no JSON object is an error."""
    files = spark.read.option("wholetext", True).text(f"{root}/*/*.json").withColumns({"file": F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), "note_id": _note()})
    docs = newest(files, new, old)
    return docs.withColumn("error", F.when(F.coalesce(~F.get_json_object("doc", "$").startswith("{"), F.lit(True)), "invalid document"))


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Operations with their position; a corrupt ledger is an error."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "operations array<struct<id:string,at:string,kind:string,payload:string>>", {"mode": "FAILFAST"}).alias("l"))
    return raw.select(F.posexplode("l.operations").alias("op_index", "o")).select("op_index", "o.*")


def scan_log(spark: SparkSession, root: str) -> DataFrame:
    """Log entries, a file each, newest file name first; corrupt ones are left out."""
    raw = spark.read.option("wholetext", True).text(f"{root}/*.json").select(F.input_file_name().alias("file"), F.from_json("value", f"{LOG}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return raw.where("r._bad is null and r.id is not null").orderBy(F.desc("file")).select("r.*").drop("_bad")


def with_history(raw: DataFrame) -> DataFrame:
    """(file, report): every report of a file's history, and the report itself, as JSON text. raw: file, value."""
    past = F.coalesce(F.from_json(F.get_json_object("value", "$.history"), "array<string>"), F.expr("cast(array() as array<string>)"))
    return raw.select("file", F.explode(F.concat(past, F.array("value"))).alias("report"))


def scan_drift(spark: SparkSession, path: str) -> DataFrame:
    """:func:`with_history` of report files."""
    return with_history(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value"))


def folder_bytes(spark: SparkSession, root: str, pattern: str = "*.m4a") -> DataFrame:
    """Bytes of audio files one level deep, by note; only file metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/*")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("note_id")).agg(F.sum("length").alias("bytes"))


def export_lines(df: DataFrame, path: str, order: str = "id") -> int:
    """JSON lines in ascending order; the number of lines."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()
