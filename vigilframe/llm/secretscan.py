"""Secret scan: fixed token forms, and strings in a sensitive context that a primed compressor finds new.

For a candidate string the marginal cost is measured: the zstandard size of its surroundings with it, less their size without it, by a compressor
primed with a dictionary of common identifiers. Words, paths and repeated names cost a few bytes; a key or a password costs nearly its whole length.

One map over the documents, nothing is shuffled. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import trim

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the same runs: a run is taken from its first character to its last
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|signing[ _-]?key|credential|bearer|authorization|client[ _-]?id|session[ _-]?id|\bauth\b|\bpwd\b|\bkey\b", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT_CHARS = 100  # on either side of a candidate: where the sensitive word must stand
AROUND_CHARS = 400  # text on either side that the candidate is measured against
# Marginal bytes per character that make a candidate new: random strings of letters and digits cost 0.9 or more, words, names and paths nearly always less than 0.8.
NOVEL_SHARE = 0.85
LEVEL = 3

IDENTIFIERS = (
    "import from return class function const static public private protected void string integer boolean double float null none true false "
    "self this super extends implements interface package namespace module export default async await yield lambda except finally raise throw "
    "request response session client server handler controller service repository manager factory builder context config configuration settings "
    "environment variable parameter argument value default_value database connection username user_name password passwd secret token api_key apikey "
    "access_key secret_key private_key public_key client_id client_secret session_token refresh_token authorization authentication credentials bearer "
    "header content-type application/json text/html charset=utf-8 https:// http:// www. localhost example.com example.org example.net index.html "
    "created_at updated_at deleted_at timestamp identifier description document_id object_id account_id customer_id order_id product_id "
    "get_value set_value get_name set_name to_string from_string parse_json load_file save_file open_connection close_connection "
    "getElementById addEventListener querySelector innerHTML className toString hashCode equals valueOf ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef 1234567890 your_api_key_here your-secret-key changeme placeholder example_token xxxxxxxxxxxxxxxx"
)


def _novel(text: str, taken: list[tuple[int, int]], packer: zstandard.ZstdCompressor, least: float) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        word = m.group()
        if any(s < end and start < e for s, e in taken) or not (SENSITIVE.search(text, max(0, start - CONTEXT_CHARS), start) or SENSITIVE.search(text, end, end + CONTEXT_CHARS)):
            continue
        before, after = text[max(0, start - AROUND_CHARS) : start], text[end : end + AROUND_CHARS]
        alone = len(packer.compress((before + after).encode()))
        if len(packer.compress((before + after + word).encode())) - alone >= least * len(word):
            yield start, end


def spans_of(text: str, packer: zstandard.ZstdCompressor, least: float = NOVEL_SHARE) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    if SENSITIVE.search(text):
        found += [(s, 3, e) for s, e in _novel(text, [(s, e) for s, _, e in found], packer, least)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def packer() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed)


def with_spans(docs: DataFrame, text: str = "text", spans: str = "secret_spans", least: float = NOVEL_SHARE) -> DataFrame:
    """``docs`` with an array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = packer()
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t or "", tool, least)] for t in batch])
            del batch
            trim()

    return docs.withColumn(spans, found(F.coalesce(F.col(text), F.lit(""))))


def masked(text: str, spans: str) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``[redacted]``."""
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def part(frm: Column, length: Column) -> Column:
        return F.substring(F.col(text), (frm + 1).cast("int"), length.cast("int"))

    def hide(a: Column, s: Column) -> Column:
        out = F.concat(a["out"], part(a["done"], s["start"] - a["done"]), F.lit("[redacted]"))
        return F.struct(F.when(s["start"] >= a["done"], out).otherwise(a["out"]).alias("out"), F.greatest(a["done"], s["end"]).alias("done"))

    return F.aggregate(ordered, begin, hide, lambda a: F.concat(a["out"], part(a["done"], F.length(text))))
