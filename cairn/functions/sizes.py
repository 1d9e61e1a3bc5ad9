"""Sizes as people read them, and what a text costs in tokens by its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 3.5


def token_estimate(size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.round(size / F.lit(BYTES_PER_TOKEN)).cast("long"))


def format_bytes(size: Column) -> Column:
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.2f", F.bround(size / F.lit(float(1024**k)), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


#: Bytes a character and characters a token where a text's letters are known.
ASCII_TOKENS, CYRILLIC_TOKENS = (1.0, 3.8), (1.9, 2.5)


def token_estimate_of(text: Column) -> Column:
    """The estimate refined by what the text is written in: mostly Cyrillic, or else."""
    cyrillic = F.regexp_count(text, F.lit(r"[\u0400-\u04FF]"))
    rate = lambda x: F.octet_length(text) / F.lit(x[0] * x[1])
    raw = F.when(cyrillic * 2 > F.length(text), rate(CYRILLIC_TOKENS)).otherwise(rate(ASCII_TOKENS))
    return F.greatest(F.lit(1).cast("long"), F.round(raw).cast("long"))


def thousands(n: Column) -> Column:
    """A whole number with a comma after each three digits from the right."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")


def utc_text(seconds: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), form)


def safe_name(name: Column) -> Column:
    """name without characters that file systems refuse; `project` if nothing is left."""
    plain = F.trim(F.translate(name, '<>:"/\\|?*', ""))
    return F.when(plain == "", "project").otherwise(plain)


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


#: Forms of a moment: as people read it, compact in names of files, with its zone, and in listings.
UTC_FORMS = {"human": "yyyy-MM-dd HH:mm:ss", "compact": "yyyyMMdd_HHmmss", "zoned": "yyyy-MM-dd HH:mm:ss 'UTC'", "listing": "dd-MMM-yy     HH:mm"}


def mermaid_id(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9_]", "_")


def short_oid(oid: Column) -> Column:
    return F.substring(oid, 1, 7)


def person(name: Column, email: Column) -> Column:
    return F.format_string("%s <%s>", F.coalesce(name, F.lit("")), F.coalesce(email, F.lit("")))
