"""Attachments as rows: text parts and office documents, scanned and rewritten on the file's row."""

from __future__ import annotations

import io
import lzma
import struct
import xml.parsers.expat
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.config import Detection
from shroudline.functions import ranks
from shroudline.operators import detect as D, payloads as Y, policy as P, redact as R, skew

NODES = "array<struct<pointer:string,entry_path:string,text_index:int,text:string>>"
# ``shown`` is how many characters of each node a budget leaves, ``total`` how many the file has.
READ = f"struct<nodes:{NODES},shown:array<int>,total:bigint,error:string>"
WRITTEN = "struct<content:binary,error:string>"

# What an archive that is broken, encrypted or packed in an unknown way makes the readers raise.
UNREADABLE = (
    zipfile.BadZipFile, zipfile.LargeZipFile, xml.parsers.expat.ExpatError, RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError,
    struct.error, OSError, EOFError, ValueError, LookupError, OverflowError, MemoryError,
)

# Media types read as text, marks of office types, folders of an office archive with text.
TEXT_TYPES = ("application/json", "application/xml", "text/xml", "text/csv")
OFFICE_MARKS = ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation")
OFFICE_ENDINGS = (".docx", ".xlsx", ".pptx")
OFFICE_FOLDERS = ("word/", "xl/", "ppt/")
REVIEW_SOURCE = "attachment_review_fallback"
REVIEW_REASON = "attachment contains sensitive content that cannot be rewritten safely"

_NODE_TYPE = pa.list_(pa.struct([("pointer", pa.string()), ("entry_path", pa.string()), ("text_index", pa.int32()), ("text", pa.string())]))
_READ_TYPE = pa.struct([("nodes", _NODE_TYPE), ("shown", pa.list_(pa.int32())), ("total", pa.int64()), ("error", pa.string())])
_WRITTEN_TYPE = pa.struct([("content", pa.binary()), ("error", pa.string())])


def flag_too_large(parts: DataFrame, max_bytes: int, content: str = "content") -> DataFrame:
    return parts.withColumn("too_large", F.octet_length(content) > max_bytes)


def part_pointer(part_name: Column, file_name: Column) -> Column:
    return F.concat(F.lit("/attachments/"), F.coalesce(part_name, file_name, F.lit("file")))


def is_text_type(media: Column) -> Column:
    return F.lower(media).startswith("text/") | F.lower(media).isin(*TEXT_TYPES)


def is_office_type(media: Column, file_name: Column) -> Column:
    result = F.lit(False)
    for mark in OFFICE_MARKS:
        result = result | F.lower(media).contains(mark)
    for ending in OFFICE_ENDINGS:
        result = result | F.coalesce(F.lower(file_name).endswith(ending), F.lit(False))
    return result


def rewritable(media: Column, file_name: Column) -> Column:
    return is_text_type(media) | is_office_type(media, file_name)


# -- office documents -----------------------------------------------------------------------------


def _text_runs(xml_bytes: bytes):
    """(start, end, text, is_cdata) of every character run between two marks, in bytes of the entry."""
    runs, state = [], {"text": None, "cdata": False, "start": 0}
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = False

    def close(end: int) -> None:
        if state["text"] is not None:
            runs.append((state["start"], end, "".join(state["text"]), state["cdata"]))
            state["text"] = None

    def mark(*_):
        close(parser.CurrentByteIndex)

    def characters(data: str) -> None:
        if state["text"] is None:
            state["text"], state["start"] = [], parser.CurrentByteIndex
        state["text"].append(data)

    def cdata_start() -> None:
        mark()
        state["cdata"] = True
        state["text"], state["start"] = [], parser.CurrentByteIndex

    def cdata_end() -> None:
        close(parser.CurrentByteIndex + len("]]>"))
        state["cdata"] = False

    parser.StartElementHandler = parser.EndElementHandler = parser.CommentHandler = parser.ProcessingInstructionHandler = mark
    parser.CharacterDataHandler = characters
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = cdata_start, cdata_end
    parser.Parse(xml_bytes, True)
    return [run for run in runs if run[2].strip()]


def _has_text(name: str) -> bool:
    return name.lower().endswith(".xml") and name.lower().startswith(OFFICE_FOLDERS)


def _why(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def _read(content: bytes, pointer: str, max_chars: int | None) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        nodes = [
            {"pointer": f"{pointer}/{name}#text/{i}", "entry_path": name, "text_index": i, "text": run[2]}
            for name in archive.namelist() if _has_text(name)
            for i, run in enumerate(_text_runs(archive.read(name)))
        ]
    shown, at = [], 0
    for node in nodes:
        size = len(node["text"])
        shown.append(size if max_chars is None else max(0, min(size, max_chars - at)))
        at += size
    return {"nodes": nodes, "shown": shown, "total": at, "error": None}


def _rewrite(content: bytes, pointer: str, texts: dict[str, str]) -> bytes:
    """The archive with the changed runs replaced; every other entry keeps its bytes."""
    target = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(target, "w") as archive:
        for info in source.infolist():
            data = source.read(info)
            if _has_text(info.filename):
                pieces, at = [], 0
                for i, (start, end, _, is_cdata) in enumerate(_text_runs(data)):
                    text = texts.get(f"{pointer}/{info.filename}#text/{i}")
                    if text is not None:
                        shown = "<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]>" if is_cdata else escape(text)
                        pieces += [data[at:start], shown.encode()]
                        at = end
                data = b"".join([*pieces, data[at:]])
            archive.writestr(info, data, info.compress_type)
    return target.getvalue()


def _rewrite_batch(contents: pa.Array, pointers: pa.Array, changed: pa.Array) -> pa.Array:
    out = []
    for content, pointer, leaves in zip(contents.to_pylist(), pointers.to_pylist(), changed.to_pylist()):
        texts, error = {leaf["pointer"]: leaf["text"] for leaf in leaves or ()}, None
        if content is not None and texts:
            try:
                content = _rewrite(content, pointer, texts)
            except UNREADABLE as refused:
                content, error = None, _why(refused)
        out.append({"content": content, "error": error})
    return pa.array(out, _WRITTEN_TYPE)


def read_office(content: Column, pointer: Column, max_chars: int | None = None) -> Column:
    """``struct<nodes,shown,total,error>``: the non-blank text nodes of an office archive in entry order, or why it cannot be read.

    A NULL content has neither.
    """
    @F.arrow_udf(READ)
    def read(contents: pa.Array, pointers: pa.Array) -> pa.Array:
        out = []
        for one, where in zip(contents.to_pylist(), pointers.to_pylist()):
            found = {"nodes": None, "shown": None, "total": None, "error": None}
            if one is not None:
                try:
                    found = _read(one, where, max_chars)
                except UNREADABLE as refused:
                    found["error"] = _why(refused)
            out.append(found)
        return pa.array(out, _READ_TYPE)

    return read(content, pointer)


def office_nodes(content: Column, pointer: Column) -> Column:
    """Non-blank text nodes of an office archive in entry order; NULL where it cannot be read."""
    return read_office(content, pointer)["nodes"]


def explode_nodes(files: DataFrame, *keep: str, content: str = "content", pointer: str = "pointer") -> DataFrame:
    nodes = files.withColumn("_nodes", skew.bound(office_nodes(F.col(content), F.col(pointer))))
    return nodes.select(*keep, F.explode("_nodes").alias("n")).select(*keep, "n.*")


def apply_budget(nodes: DataFrame, max_chars: int, key: str = "path", order: str = "position", text: str = "text", dense: bool = False) -> DataFrame:
    """Nodes within a character budget per file, in order; the last one is cut.  ``truncated`` marks all nodes of a file with more text.

    ``order`` orders the nodes of a file by unique whole numbers; ``dense`` says that they run from 0 without gaps.
    """
    size = F.char_length(text).cast("bigint")
    over = nodes.groupBy(key).agg(F.sum(size).alias("_total"), F.count("*").alias("n")).where(F.col("_total") > max_chars)
    counted = skew.prefix_sum(nodes, key, order, size, "before", dense=dense).where(F.col("before") < max_chars)
    marked = skew.lookup(counted, over.select(key, "_total"), [key], order, "left", counts=over.select(key, "n"))
    return (
        marked.withColumn("truncated", F.col("_total").isNotNull())
        .withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(max_chars) - F.col("before")).cast("int")))
        .drop("before", "_total")
    )


def stricter(decision: Column, wanted: str | None, where: Column) -> Column:
    """``decision``, or ``wanted`` where that is stricter and ``where`` holds."""
    if wanted is None:
        return decision
    asked = ranks.action_rank(F.lit(wanted))
    return F.when(where & (asked > ranks.action_rank(decision)), F.lit(wanted)).otherwise(decision)


def scan_office(files: DataFrame, config: Detection, caller: Column, max_chars: int | None = None, content: str = "content",
                pointer: str = "pointer", tokenizer: R.Tokenizer | None = None, on_truncated: str | None = "review", on_unreadable: str = "block") -> DataFrame:
    """Scan, judge and rewrite office files: adds ``resolved``, ``decision``, ``rewritten``, ``truncated`` and ``error``.

    Whole files are scanned unless ``max_chars`` limits them; a file with more text is marked ``truncated`` and gets ``on_truncated`` where
    that is stricter than what was found.  A file that cannot be read, or not be written again, has an ``error``: its decision is
    ``on_unreadable`` and its content is withheld (NULL).
    """
    rows = files.withColumn("_read", skew.bound(read_office(F.col(content), F.col(pointer), max_chars)))
    leaves = F.transform(F.coalesce("_read.nodes", F.array().cast(NODES)), lambda n: F.struct(n["pointer"].alias("pointer"), n["text"].alias("text")))
    rows = rows.withColumn("_leaves", leaves)
    shown = None
    if max_chars is not None:
        shown = F.zip_with("_leaves", F.coalesce("_read.shown", F.array().cast("array<int>")), lambda leaf, n: F.substring(leaf["text"], F.lit(1), n))
        rows, shown = rows.withColumn("_shown", shown), F.col("_shown")
    truncated = F.lit(False) if max_chars is None else F.coalesce(F.col("_read.total") > max_chars, F.lit(False))
    rows = rows.withColumn("truncated", truncated).withColumn("error", F.col("_read.error")).drop("_read")
    rows = Y.judge_leaves(rows, config, caller, F.lit("request"), tokenizer, scanned=shown).drop("_shown")
    wanted = F.when(F.col("decision") == "redact", F.col(content))
    written = F.arrow_udf(_rewrite_batch, WRITTEN)(wanted, F.col(pointer), F.col("_changed"))
    rows = rows.withColumn("_written", skew.bound(written)).withColumn("error", F.coalesce("error", "scan_error", "_written.error")).drop("scan_error")
    failed = F.col("error").isNotNull()
    return (
        rows.withColumn("rewritten", F.when(~failed, F.coalesce("_written.content", F.col(content))))
        .withColumn("decision", F.when(failed, F.lit(on_unreadable)).otherwise(stricter(F.col("decision"), on_truncated, F.col("truncated"))))
        .drop("_changed", "_written")
    )


def scan_text_parts(parts: DataFrame, config: Detection, caller: Column, max_chars: int | None = None, content: str = "content",
                    tokenizer: R.Tokenizer | None = None, on_truncated: str | None = "review") -> DataFrame:
    """Scan, judge and rewrite text parts; invalid bytes are read as replacement characters.

    Whole parts are scanned unless ``max_chars`` limits them; a longer part is marked ``truncated`` and gets ``on_truncated``
    where that is stricter than what was found.
    """
    rows = parts.withColumn("text", F.make_valid_utf8(F.col(content).cast("string")))
    truncated = F.lit(False) if max_chars is None else F.coalesce(F.char_length("text") > max_chars, F.lit(False))
    rows = rows.withColumn("truncated", truncated)
    found = D.detect(rows.withColumn("_shown", F.col("text") if max_chars is None else F.substring("text", 1, max_chars)), config, "_shown")
    judged = R.judge(found.drop("_shown"), caller, F.lit("request"), "text", tokenizer)
    return (
        judged.withColumn("rewritten", F.col("redacted").cast("binary")).drop("text", "redacted")
        .withColumn("decision", stricter(F.col("decision"), on_truncated, F.col("truncated")))
    )


def part_findings(findings: DataFrame, parts: DataFrame, request: str = "request_id") -> DataFrame:
    """Findings with the part they lie in: at its pointer, or below it after ``/`` or ``#``.

    A finding's pointer is cut at every such mark, so parts are met by equality.
    """
    marks = F.regexp_extract_all("pointer", F.lit(r"[/#]?[^/#]*"), F.lit(0))
    steps = F.filter(marks, lambda m: m != "")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ""))
    candidates = findings.withColumn("part_pointer", F.explode(above))
    keys = [request, "part_pointer"]
    return skew.lookup(candidates, parts.select(request, F.col("pointer").alias("part_pointer")), keys, findings.columns, "inner", grown=True)


def attachment_decision(parts: DataFrame, request: str = "request_id") -> DataFrame:
    """Decision per request over its scanned parts (``resolved``, ``rewritable``, and ``decision`` where the parts have one).

    A request to be masked goes to review when a part that cannot be rewritten has findings.
    """
    own = ranks.action_rank(P.decide(F.col("resolved")))
    if "decision" in parts.columns:  # that of an unreadable or truncated part is stricter than its findings
        own = F.greatest(own, ranks.action_rank(F.col("decision")))
    top = F.max(own).alias("_top")
    stuck = F.bool_or(~F.col("rewritable") & (F.size("resolved") > 0)).alias("_stuck")
    rows = parts.groupBy(request).agg(top, stuck)
    escalates = F.col("_stuck") & (F.col("_top") == 1)
    return rows.select(
        request,
        F.when(escalates, F.lit("review")).otherwise(ranks.action_of(F.col("_top"))).alias("decision"),
        F.when(escalates, F.lit(REVIEW_SOURCE)).otherwise(F.lit("builtin")).alias("source"),
        F.when(escalates, F.lit(REVIEW_REASON)).alias("reason"),
    )
