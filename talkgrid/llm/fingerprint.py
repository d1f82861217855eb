"""Document fingerprints: canonical exact digests, made by DataFrame and SQL functions only.

A text's canonical form is NFKC, full case folding, NFKC again, every run of white space (all that Unicode calls so) as one
space, none at either end. Canonical forms are grouped by a wide key (two independently seeded xxhash64 values); forms of
one key that differ are told apart by a running number in their fingerprints. By default forms of one key are compared
byte for byte (``compare="bytes"``), so equal fingerprints always mean equal forms; with ``compare="digest"`` their SHA-256
stands for the bytes, which saves shipping the texts by key.

Null texts count as empty. Empty texts share one fingerprint, which that of texts of nothing but white space equals too.
Repeated rows get equal fingerprints. Other columns are passed through, whatever their names; ``fingerprint`` replaces a
column of its own output's name. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_COMPOSE = "com.ibm.icu.text.Normalizer"
_FOLD = "com.ibm.icu.lang.UCharacter"
#: Unicode's white space (separators, and the controls from tab to carriage return and U+0085), and the four
#: information separators, which count as white space where text is split.
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\p{Z}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text column (ICU ships with Spark)."""
    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit(_COMPOSE), F.lit("compose"), c, F.lit(True))

    folded = nfkc(F.reflect(F.lit(_FOLD), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def wide_key(form: Column, bits: int = 128) -> Column:
    """Hexadecimal key of ``bits`` hash bits (fewer than 128 only to make collisions in tests)."""
    key = F.concat(F.lpad(F.hex(F.xxhash64(F.lit(1), form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(2), form, F.lit(3))), 16, "0"))
    return F.lower(F.substring(key, 1, max(1, bits // 4)))


def numbered(keys: DataFrame) -> DataFrame:
    """For the buckets that hold several forms: (key, digest, number). ``keys``: key, digest (the form's bytes or their SHA-256).

    The first number is 0, in the order of digests. One row for each key and task leaves the partial aggregation, so copies cost nothing;
    only buckets with a collision, of which there are practically none at 128 bits, are looked at closer.
    """
    clash = keys.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("key")
    forms = keys.join(clash, "key", "left_semi").distinct()
    w = Window.partitionBy("key").orderBy("digest")
    return forms.select("key", "digest", (F.row_number().over(w) - 1).alias("number"))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", bits: int = 128, compare: str = "bytes") -> DataFrame:
    """``df`` with the fingerprint of its text column."""
    if compare not in ("bytes", "digest"):
        raise ValueError(f"compare: {compare!r}")
    had = [c for c in df.columns if c != out]
    row, form = df.select(F.struct(*[F.col(c) for c in had]).alias("row"), canonical(F.col(text)).alias("form")), F.col("form")
    keyed = row.select("row", wide_key(form, bits).alias("key"), (form.cast("binary") if compare == "bytes" else F.unhex(F.sha2(form, 256))).alias("digest"))
    made = attach(keyed, numbered(keyed.select("key", "digest")), [("key", "digest", "made")])
    return made.select(*[F.col("row")[c].alias(c) for c in had], F.col("made").alias(out))


def attach(df: DataFrame, numbers: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Fingerprint columns from (key, digest, output) column names; ``numbers`` as of :func:`numbered`."""
    for i, (key, digest, out) in enumerate(columns):
        n = numbers.select(F.col("key").alias(f"_k{i}"), F.col("digest").alias(f"_d{i}"), F.col("number").alias(f"_n{i}"))
        df = df.join(n, (F.col(key) == F.col(f"_k{i}")) & (F.col(digest) == F.col(f"_d{i}")), "left")
        df = df.withColumn(out, F.concat_ws("-", F.col(key), F.coalesce(F.col(f"_n{i}"), F.lit(0)).cast("string"))).drop(f"_k{i}", f"_d{i}", f"_n{i}")
    return df


def block_heads(docs: DataFrame, blocks: int) -> list[int]:
    """The largest doc_id of each of about ``blocks`` ranges of doc_id, in descending order: one value a range."""
    ids = docs.select("doc_id").where("doc_id is not null")
    dealt = ids.repartitionByRange(blocks, F.col("doc_id").desc()).withColumn("part", F.spark_partition_id())
    return sorted({r["head"] for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}, reverse=True)


def _block(doc_id: Column, heads: list[int], step: int = 64) -> Column:
    """Number of the range that a doc_id lies in, found in two levels; nulls lie in the last."""
    if len(heads) < 2:
        return F.lit(0)
    every = F.array(*map(F.lit, heads))
    outer = F.array(*map(F.lit, heads[::step]))
    o = F.greatest(F.lit(0), F.size(F.filter(outer, lambda x: x >= doc_id)) - 1)
    at = o * step + F.size(F.filter(F.slice(every, o * step + 1, step), lambda x: x >= doc_id)) - 1
    return F.when(doc_id.isNull(), len(heads) - 1).otherwise(F.greatest(F.lit(0), at))


def with_next(docs: DataFrame, columns: list[str], blocks: int | None = None) -> DataFrame:
    """``docs`` (doc_id and others) with ``next_<c>`` of the row that follows in descending doc_id, nulls last, ties by th.

    Rows are dealt once, by ranges of doc_id; the first row of a range also goes to the range before it, that of the
    first range to the last, so every row finds its successor in its own range. Rows that repeat a doc_id follow each other.
    """
    blocks = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = block_heads(docs, blocks) or [0]
    last = len(heads) - 1
    at = docs.withColumn("_block", _block(F.col("doc_id"), heads))
    lead_row = F.col("doc_id").eqNullSafe(F.element_at(F.array(*map(F.lit, heads)), F.col("_block") + 1))
    if last == 0:  # one range: whichever row comes first may be the helper
        lead_row = F.lit(True)
    before = F.when(F.col("_block") == 0, last).otherwise(F.col("_block") - 1)
    own = F.struct(F.col("_block").alias("b"), F.lit(0).alias("helper"))
    extra = F.struct(before.alias("b"), F.lit(1).alias("helper"))
    dealt = at.withColumn("_at", F.explode(F.when(lead_row, F.array(own, extra)).otherwise(F.array(own))))
    w = Window.partitionBy("_at.b").orderBy("_at.helper", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_at.helper = 0").drop("_block", "_at")


def edited_fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and whether they equal each other's and the next one's.

    docs: doc_id, text. The next document follows in descending doc_id (nulls last, ties by text hash), the first
    after the last. Forms are compared by SHA-256. The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next text. near_edited and near_next are 1.0 for equal fingerprints, else 0.0.
    """
    form = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_form", canonical(F.col("text")))
    base = form.select("doc_id", F.xxhash64("text").alias("th"), "text", F.char_length("text").cast("long").alias("n_chars"), wide_key(F.col("_form"), bits).alias("k"), F.unhex(F.sha2("_form", 256)).alias("d"))
    both = with_next(base, ["text", "k", "d"])
    edit = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    edit = edit.select("doc_id", "n_chars", "k", "d", F.col("next_k").alias("nk"), F.col("next_d").alias("nd"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("edited")).alias("_ef"))
    rows = cut(edit.select("doc_id", "n_chars", "k", "d", "nk", "nd", "edited_sha256", wide_key(F.col("_ef"), bits).alias("ek"), F.unhex(F.sha2("_ef", 256)).alias("ed")))
    numbers = cut(numbered(rows.select(F.explode(F.array(F.struct(F.col("k").alias("key"), F.col("d").alias("digest")), F.struct(F.col("ek").alias("key"), F.col("ed").alias("digest")))).alias("x")).select("x.*")))
    out = attach(rows, numbers, [("k", "d", "fingerprint"), ("ek", "ed", "edited_fingerprint"), ("nk", "nd", "next_fingerprint")])
    like = lambda c: F.when(F.col("fingerprint") == F.col(c), 1.0).otherwise(0.0)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
