"""Input profiles as Column expressions: type, size, hash, density and emptiness of raw text or bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that the classifier looks at: for JSON, and for the marks of mail and HTML.
JSON_HEAD, MARK_HEAD = 8192, 4096
ASCII_SPACE = r"\x09\x0A\x0B\x0C\x0D\x20"
#: What a character test for white space adds beyond ASCII's six (fixed values of Unicode).
MORE_SPACE = r"\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def raw_bytes(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "binary":
        return F.col(name)
    if kind == "string":
        return F.encode(F.col(name), "UTF-8")
    raise TypeError(f"{name} is {kind}; raw input is string or binary")


def decoded(raw: Column) -> Column:
    """UTF-8 with U+FFFD for what is malformed."""
    return F.make_valid_utf8(raw.cast("string"))


def is_empty(raw: Column, text: Column | None = None) -> Column:
    return _text(raw, text).rlike(rf"^[{ASCII_SPACE}]*\z")


def _text(raw: Column, text: Column | None) -> Column:
    return decoded(raw) if text is None else text


def _head(raw: Column, n: int) -> Column:
    return decoded(F.substring(raw, 1, n))


def input_type(raw: Column, text: Column | None = None) -> Column:
    """empty, pdf_text, json, email, html, csv or text; the first rule that holds."""
    head = _head(raw, MARK_HEAD)
    trimmed = F.regexp_replace(_head(raw, JSON_HEAD), rf"^[{ASCII_SPACE}]+", "")
    line = F.regexp_replace(F.substring_index(_text(raw, text), "\n", 1), rf"^[{ASCII_SPACE}]+", "")
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    return (
        F.when(F.octet_length(raw) == 0, "empty")
        .when(F.startswith(head, F.lit("%PDF-")), "pdf_text")
        .when(trimmed.rlike(r"^[\{\[]") & F.try_parse_json(trimmed).isNotNull(), "json")
        .when(head.rlike(r"(?m)^From ") & head.rlike(r"(?m)^Subject:"), "email")
        .when(head.rlike(r"(?i)<\s*html|<!doctype\s+html"), "html")
        .when(commas >= 3, "csv")
        .otherwise("text")
    )


def density(raw: Column, text: Column | None = None) -> Column:
    """Share of what isn't white space: bytes of ASCII text, else characters over bytes."""
    text, size = _text(raw, text), F.octet_length(raw)
    ascii_ = F.length(F.regexp_replace(text, rf"[{ASCII_SPACE}]", ""))
    other = F.length(F.regexp_replace(text, rf"[{ASCII_SPACE}{MORE_SPACE}]", ""))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.when(F.length(text) == size, ascii_).otherwise(other).cast("double") / size.cast("double"))


def profile(raw: Column, text: Column | None = None) -> Column:
    """The profile of raw bytes; `text` is the column that holds them decoded, where there is one, so that they are once."""
    return F.struct(
        input_type(raw, text).alias("input_type"),
        F.octet_length(raw).cast("bigint").alias("size"),
        F.sha2(raw, 256).alias("content_hash"),
        density(raw, text).alias("density"),
        ((F.octet_length(raw) == 0) | is_empty(raw, text)).alias("is_empty"),
    )
