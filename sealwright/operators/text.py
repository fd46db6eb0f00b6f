"""Text extraction: plain text as it is, HTML by the standard parser."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..model import Step
from . import candidates as C


class Provider(Protocol):
    """Extracts text in a task, from bytes and their content type. What it raises becomes a diagnostic of its row."""

    def extract(self, raw: bytes, content_type: str) -> str: ...


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


#: An ampersand, and the reference that it begins if a semicolon ends it.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def html_to_text(html: str, ended: bool = False) -> str:
    """All text between tags, that of scripts and styles too; entities are decoded and comments dropped.

    The standard parser decodes `&amp` without its semicolon too. With `ended`, only references that a semicolon ends
    are decoded, and other ampersands stay.
    """
    stands = ""
    if ended and "&" in html:
        stands = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else stands + (m[1] or ""), html)
    parser = _Text()
    parser.feed(html)
    parser.close()
    out = "".join(parser.parts)
    return out.replace(stands, "&") if stands else out


def html_text(html: Column | str, ended: bool = False) -> Column:
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: None if x is None else html_to_text(x, ended))

    return F.pandas_udf(run, StringType())(html)


def extracted(provider: Provider, raw: Column, kind: Column) -> Column:
    """struct<text, error> by an object with extract(), in Arrow batches."""

    def one(data: bytes | None, content_type: str | None) -> tuple:
        try:
            return provider.extract(bytes(data or b""), content_type or ""), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("struct<text:string,error:string>")
    def run(data: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d, k) for d, k in zip(data, kinds, strict=True)], columns=["text", "error"], dtype=object)

    return run(raw, kind)


def compile_step(step: Step, ctx) -> tuple[Column, Column]:
    from .registry import builtin

    spec = builtin()["text_extraction"].spec
    kind = step.config.get("content_type")
    kind = ctx.profile["input_type"] if kind is None else F.lit(kind)
    if (provider := step.config.get("provider")) is not None:
        if not callable(getattr(provider, "extract", None)):
            return C.none(), C.diagnostic("CAPABILITY_INVOKE_FAILED", "ERROR", "text_extraction: the provider has no extract()", ctx.field_id)
        got = F.array(extracted(provider, ctx.raw, kind))
        good = F.filter(got, lambda g: g["error"].isNull())
        found = F.transform(good, lambda g: C.candidate(g["text"], C.of(spec, ctx.field_id, F.lit(0), F.octet_length(ctx.raw))))
        wrong = F.transform(F.filter(got, lambda g: g["error"].isNotNull()), lambda g: F.get(C.diagnostic("CAPABILITY_INVOKE_FAILED", "ERROR", F.concat(F.lit("text_extraction: "), g["error"]), ctx.field_id), 0))
        return found, wrong
    plain, html = kind.isin("text", "text/plain"), kind.isin("html", "text/html")
    value = F.when(plain, ctx.text).when(html, html_text(F.when(html, ctx.text)))
    one = F.array(C.candidate(value, C.of(spec, ctx.field_id, F.lit(0), F.octet_length(ctx.raw))))
    return F.when(plain | html, one).otherwise(C.none()), F.when(plain | html, C.no_diagnostics()).otherwise(C.diagnostic("INPUT_NOT_SUPPORTED", "ERROR", "only text and html are extracted", ctx.field_id))
