"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that echo comparison leaves out.
ECHO_MARKS = ",.?!;:，。？！、；："
#: Short answers that are never noise.
SHORT_ANSWERS = ("好", "对", "嗯", "行", "是", "好的", "对的", "嗯嗯", "行吧", "可以", "ok", "噢", "哦", "喔", "欸", "诶", "嗯哼", "没了", "没有")
#: Words that a recogniser makes out of silence.
FILLERS = ("yeah", "yes", "oh", "the", "so", "this", "i", "a", "and", "but", "ok", "okay", "uh", "um", "hmm", "mhm", "thankyou", "right")


def echo_key(t: Column) -> Column:
    """Without white space and echo marks, in lower case."""
    return F.lower(F.regexp_replace(t, rf"[\s{ECHO_MARKS}]", ""))


def effective(t: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))


def similarity(a: Column, b: Column, contains_min: int = 4, distance: Column | None = None) -> Column:
    """1 - distance / longer length, or 1 where the shorter has ``contains_min`` characters and lies in the longer; 0 if one is empty.
    ``distance``: the edit distance, where it is there already."""
    la, lb = F.char_length(a), F.char_length(b)
    inside = (F.least(la, lb) >= contains_min) & (F.contains(a, b) | F.contains(b, a))
    return F.when((la == 0) | (lb == 0), 0.0).when(inside, 1.0).otherwise(1 - (F.levenshtein(a, b) if distance is None else distance) / F.greatest(la, lb))


def alike(a: Column, b: Column, least: float, contains_min: int = 4) -> Column:
    """Whether :func:`similarity` is ``least`` at least; the distance is only counted as far as that needs."""
    la, lb = F.char_length(a), F.char_length(b)
    inside = (F.least(la, lb) >= contains_min) & (F.contains(a, b) | F.contains(b, a))
    long = F.greatest(la, lb)
    most = F.floor((1 - least) * long + 1e-9).cast("int")
    # One threshold a call: lengths apart by more than it can't be alike, and the rest is compared up to the text's own bound.
    close = (F.abs(la - lb) <= most) & (F.levenshtein(a, b) <= most)
    return F.when((la == 0) | (lb == 0), F.lit(least <= 0)).otherwise(inside | close)


def name_key(t: Column) -> Column:
    return F.lower(F.trim(t))


def char_slice(t: Column, start: Column, end: Column) -> Column:
    """Code points [start, end); null where they lie outside."""
    return F.when((start >= 0) & (end >= start) & (end <= F.char_length(t)), F.substring(t, start + 1, end - start))


def quote(t: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def field_bytes(c: Column) -> Column:
    """A field's length as eight big-endian bytes, then its UTF-8 bytes."""
    b = F.encode(c, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b)


def stable_id(prefix: str, *fields: Column) -> Column:
    """Content-addressed id: prefix and 24 hexadecimal digits of SHA-256 over length-prefixed fields."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*map(field_bytes, fields)), 256), 1, 24))


def redact_keys(t: Column) -> Column:
    """Blank-separated tokens that look like keys become a mark; white space collapses."""
    token = lambda w: F.when(w.rlike(r"sk-|phc_|phx_|A-SH-|[0-9a-fA-F]{32,}"), "<REDACTED>").otherwise(w)
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), token), " ")


def drop_cjk_runs(t: Column, least: int = 12) -> Column:
    return F.regexp_replace(t, rf"[\x{{4E00}}-\x{{9FFF}}]{{{least},}}", "<TEXT>")


def redact_file_urls(t: Column) -> Column:
    return F.regexp_replace(t, r"file://\S+", "<PATH>")


def clock(ms: Column) -> Column:
    """Milliseconds as hh:mm:ss."""
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def human_duration(s: Column) -> Column:
    """Seconds as hours and minutes, minutes and seconds, or seconds."""
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(s >= 3600, F.format_string("%dh%dm", h, m)).when(s >= 60, F.format_string("%dm%ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def email_key(t: Column) -> Column:
    """Without mailto:, percent-decoded (a plus sign stays), trimmed, lower case."""
    return F.lower(F.trim(F.url_decode(F.regexp_replace(F.regexp_replace(t, "(?i)^mailto:", ""), r"\+", "%2B"))))


def status_class(code: Column) -> Column:
    return F.when(code.isin(401, 403), "auth").when(code == 404, "not_found").when(code == 429, "rate_limit").when(code >= 500, "server").otherwise("other")


def new_name(t: Column, most: int = 32) -> Column:
    """Without control characters, trimmed; null if empty or too long."""
    n = F.trim(F.regexp_replace(t, r"[\x00-\x1F\x7F]", ""))
    return F.when((n != "") & (F.char_length(n) <= most), n)


def mixed_tokens(t: Column) -> Column:
    """ASCII letter and digit runs are words, other letters and digits stand alone."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9]+|[\p{L}\p{N}])"), F.lit(1))


def is_noise(t: Column, duration_ms: Column, lang: Column) -> Column:
    """Recogniser noise: short segments with next to no characters, unless they are known answers."""
    e = effective(t)
    n = F.char_length(e)
    return ~e.isin(*SHORT_ANSWERS) & (((duration_ms < 2500) & (n <= 2)) | ((duration_ms < 3000) & lang.isin("yue", "ja", "ko") & (n <= 4)))


def no_content(t: Column) -> Column:
    return (F.trim(t) != "") & ~t.rlike(r"[\p{L}\p{N}]")


def cjk_share(t: Column) -> tuple[Column, Column]:
    """CJK letters, and all letters and digits."""
    count = lambda p: F.char_length(t) - F.char_length(F.regexp_replace(t, p, ""))
    return count(r"[\x{4E00}-\x{9FFF}]"), count(r"[\p{L}\p{N}]")


def is_foreign(t: Column, lang: Column, most: float = 0.3) -> Column:
    """Tagged Japanese or Korean, or with a large share of kana and hangul among its letters."""
    count = lambda p: F.char_length(t) - F.char_length(F.regexp_replace(t, p, ""))
    letters = count(r"\p{L}")
    return lang.isin("ja", "ko") | ((letters > 0) & (count(r"[\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]") / letters > most))


def cap_field(t: Column, most: int = 200_000) -> Column:
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…[truncated]"))).otherwise(t)


def cut_bytes(t: Column, most: int) -> Column:
    """(text, cut): at most so many bytes of UTF-8, ending on a whole character, and whether something was cut."""
    raw = F.encode(t, "UTF-8")
    inside = lambda i: F.hex(F.substring(raw, i, 1)).between("80", "BF")
    end = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    short = F.octet_length(t) <= most
    return F.when(t.isNotNull(), F.struct(F.when(short, t).otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(end, F.lit(0))), "UTF-8")).alias("text"), (~short).alias("cut")))


def redact_paths(t: Column) -> Column:
    """File URLs, Windows paths, home folders and Unix paths become marks, in this order."""
    t = redact_file_urls(t)
    t = F.regexp_replace(t, r"(?U)\b[A-Za-z]:\\(?i:users)\\[^\s\"'<>|]+", "<HOME_PATH>")
    t = F.regexp_replace(t, r"(?U)\b[A-Za-z]:\\[^\s\"'<>|]+", "<PATH>")
    t = F.regexp_replace(t, r"(?U)(?<![\w/])/(?:Users|home)/[^\s\"'<>|]+", "<HOME_PATH>")
    return F.regexp_replace(t, r"(?U)(?<![\w/<])/(?:[\w.@+-]+/)+[\w.@+-]*", "<PATH>")


def redact(t: Column) -> Column:
    """Paths, key-like tokens and long CJK runs become marks; white space becomes single spaces."""
    words = F.split(F.trim(F.regexp_replace(redact_paths(t), r"(?U)[\s\x1c-\x1f]+", " ")), " ")
    key = lambda w: w.rlike(r"sk-|phc_|phx_|A-SH-|[0-9a-fA-F]{32,}")
    return drop_cjk_runs(F.array_join(F.transform(words, lambda w: F.when(key(w), "<REDACTED>").otherwise(w)), " "))


def source_hash(rows: Column) -> Column:
    """SHA-256 over the number of paragraphs and each one's segment numbers and text, in order. rows: array of (index, seqs, text)."""
    lines = F.transform(F.array_sort(rows), lambda r: F.concat_ws(":", r["seqs"].cast("string"), r["text"]))
    return F.sha2(F.concat_ws("\n", F.size(rows).cast("string"), F.array_join(lines, "\n")), 256)


def source_hash_lines(index: str, seqs: str, text: str) -> Column:
    """:func:`source_hash` as an aggregate over the rows of one document."""
    return source_hash(F.collect_list(F.struct(F.col(index).alias("index"), F.col(seqs).alias("seqs"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
