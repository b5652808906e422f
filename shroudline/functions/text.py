"""Text functions: offsets, entropy, previews, stream lines, media types, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroudline.functions import regex

TOKEN_CLASS = r"[A-Za-z0-9\-_./+=]"

# Text put in place of what must not be shown.
REDACTED_JSON = '{"error":"response redacted by gateway"}'
REDACTED_TEXT = "[REDACTED]"
BINARY_BODY = "[binary request body]"

# File name endings and the media type they stand for.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".json": "application/json",
    ".csv": "text/csv",
    ".xml": "application/xml",
}

# Headers that never leave, and those tied to a body length.
HOP_BY_HOP = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "te", "trailers", "transfer-encoding", "upgrade",
)
BODY_SIZE = ("content-length",)


def char_to_byte(text: Column, position: Column) -> Column:
    """Byte offset of a code-point offset, clamped to the end of the text."""
    inside = F.least(position, F.char_length(text)).cast("int")
    return F.octet_length(F.substring(text, F.lit(1), inside))


def shannon_entropy(value: Column) -> Column:
    """Bits per byte over the byte histogram (ASCII tokens: one byte per character).

    Characters are sorted once; a run of n equal ones among N adds −n/N·log2(n/N).
    """
    marks = F.array_sort(F.filter(F.split(value, ""), lambda c: c != ""))
    none = F.lit(0).cast("bigint")

    def state(last: Column, run: Column, bits: Column, size: Column) -> Column:
        return F.struct(last.alias("last"), run.alias("run"), bits.alias("bits"), size.alias("size"))

    def weight(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(F.lit(0.0))

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.when(same, state(c, acc["run"] + 1, acc["bits"], acc["size"] + 1)).otherwise(
            state(c, F.lit(1).cast("bigint"), acc["bits"] + weight(acc["run"]), acc["size"] + 1)
        )

    def finish(acc: Column) -> Column:
        # log2(N) − Σ n·log2(n) / N
        return F.when(acc["size"] > 0, F.log2(acc["size"]) - (acc["bits"] + weight(acc["run"])) / acc["size"]).otherwise(F.lit(0.0))

    return F.aggregate(marks, state(F.lit(""), none, F.lit(0.0), none), step, finish)


def entropy_tokens(text: Column, min_length: int, min_entropy: float) -> Column:
    """Maximal runs of token characters that are long and varied enough."""
    runs = F.regexp_extract_all(text, F.lit(f"{TOKEN_CLASS}{{{min_length},}}"), F.lit(0))
    return F.filter(runs, lambda t: shannon_entropy(t) >= min_entropy)


def spans_of(text: Column, pattern: str) -> Column:
    """Spans of one rule as a column expression: ``array<struct<start,end,matched>>``.

    The text between matches and the matches themselves, laid end to end, give every offset.  Exact
    where the captured text cannot start earlier inside its match, as in rules with one boundary
    character; ``operators.detect`` has no such limit.
    """
    java = regex.to_java(pattern)
    group = 1 if regex.has_group(pattern) else 0
    cut = F.transform(
        F.arrays_zip(
            F.split(text, java, -1).alias("gap"),
            F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, F.lit(java), F.lit(group)).alias("found"),
        ),
        lambda piece: piece,
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,matched:string>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + F.char_length(piece["gap"])
        first = begin + F.instr(piece["whole"], piece["found"]) - 1
        span = F.struct(
            first.cast("int").alias("start"),
            (first + F.char_length(piece["found"])).cast("int").alias("end"),
            piece["found"].alias("matched"),
        )
        return F.when(piece["whole"].isNull(), acc).otherwise(
            F.struct((begin + F.char_length(piece["whole"])).cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        )

    walked = F.aggregate(cut, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(java), walked).otherwise(F.array().cast("array<struct<start:int,end:int,matched:string>>"))


def preview(body: Column, chars: int) -> Column:
    """First ``chars`` code points of a body; a fixed text where it is not UTF-8."""
    return F.when(F.is_valid_utf8(body.cast("string")), F.substring(body.cast("string"), 1, chars)).otherwise(
        F.lit(BINARY_BODY[:chars])
    )


def truncate_middle(value: Column, max_chars: int) -> Column:
    head = max(max_chars - 3, 0) // 2
    tail = max(max_chars - 3 - head, 0)
    cut = F.concat(F.left(value, F.lit(head)), F.lit("..."), F.right(value, F.lit(tail)))
    return F.when(F.char_length(value) <= max_chars, value).otherwise(cut)


def is_json_type(content_type: Column) -> Column:
    return F.coalesce(content_type.contains("application/json") | content_type.contains("+json"), F.lit(False))


def parses(text: Column) -> Column:
    """Whether the text is one JSON document."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def payload_kind(content_type: Column, direction: Column, body: Column) -> Column:
    """Which path a payload takes: multipart, sse, json, text or passthrough."""
    lowered = F.coalesce(F.lower(content_type), F.lit(""))
    return (
        F.when((direction == "request") & lowered.startswith("multipart/form-data"), F.lit("multipart"))
        .when((direction == "response") & lowered.startswith("text/event-stream"), F.lit("sse"))
        .when(is_json_type(content_type) & parses(body.cast("string")), F.lit("json"))
        .when(F.is_valid_utf8(body.cast("string")), F.lit("text"))
        .otherwise(F.lit("passthrough"))
    )


def sse_payload(line: Column) -> Column:
    """What follows the ``data:`` marks of a stream line; NULL for lines that pass untouched."""
    payload = F.regexp_replace(F.regexp_replace(line, r"^(?:data:)+", ""), r"^(?U:\s)+|(?U:\s)+\z", "")
    return F.when(line.startswith("data:") & ~payload.isin("", "[DONE]"), payload)


def media_type(declared: Column, file_name: Column) -> Column:
    """The declared type unless it says nothing; then what the file name says."""
    lowered = F.lower(file_name)
    by_name = None
    for ending, name in MEDIA_TYPES.items():
        by_name = (F if by_name is None else by_name).when(lowered.endswith(ending), F.lit(name))
    named = F.trim(F.coalesce(declared, F.lit("")))
    blank = F.lower(named).isin("", "application/octet-stream", "binary/octet-stream")
    return F.when(~blank, named).otherwise(by_name.otherwise(F.lit("text/plain")))


def media_allowed(media: Column, allowed: tuple[str, ...]) -> Column:
    lowered = F.lower(media)
    tests = [lowered.startswith(a.lower().rstrip("*")) if a.endswith("/*") else lowered == a.lower() for a in allowed]
    result = F.lit(False)
    for test in tests:
        result = result | test
    return result


def forward_headers(headers: Column, allow: tuple[str, ...], request_id: Column) -> Column:
    """Request headers sent on: allowed, not hop-by-hop, plus the request id."""
    keep = [name for name in allow if name not in HOP_BY_HOP and name != "x-request-id"]
    kept = F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*keep))
    return F.map_concat(kept, F.create_map(F.lit("x-request-id"), request_id))


def response_headers(headers: Column) -> Column:
    drop = HOP_BY_HOP + BODY_SIZE
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: ~k.isin(*drop))


def host_of(url: Column, host_header: Column | None = None) -> Column:
    """Lower-case host of a URL, else of the Host header, without port and trailing dots."""
    host = F.try_parse_url(url, F.lit("HOST"))
    if host_header is not None:
        host = F.coalesce(host, F.split_part(host_header, F.lit(":"), F.lit(1)))
    return F.rtrim(F.lower(F.coalesce(host, F.lit(""))), F.lit("."))
