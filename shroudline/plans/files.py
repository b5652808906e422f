"""Attachment queries: documents as text parts, and as office files built from them."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from shroudline.operators import attachments as A, policy as P
from shroudline.plans import sql as S, views as V
from shroudline.plans.registry import query
from shroudline.streaming import jobs as J


def _office_batch(texts: pa.Array) -> pa.Array:
    """A small office archive per text, one paragraph per line, with an entry that holds no text."""
    out = []
    for text in texts.to_pylist():
        target = io.BytesIO()
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            lines = "".join(f"<w:t>{escape(line)}</w:t>" for line in text.split("\n"))
            archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="w"><w:body>{lines}</w:body></w:document>')
            archive.writestr("word/media/pixel.bin", bytes(range(16)))
        out.append(target.getvalue())
    return pa.array(out, pa.binary())


def office_files(spark, d):
    docs = V.scan_docs(spark, d)
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\r]", "")
    return docs.select("doc_id", F.arrow_udf(_office_batch, "binary")(clean).alias("content"), F.lit("/attachments/file").alias("pointer"))


NODES_SQL = r"""nodes AS (SELECT doc_id, i - 1 AS text_index, text FROM (SELECT doc_id, line AS text, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS n
  FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\r]', '', 'g') AS t FROM scan_docs)) WHERE trim(line) <> ''))"""


@query("ooxml_nodes", f"WITH {NODES_SQL} SELECT doc_id, concat('/attachments/file/word/document.xml#text/', text_index) AS pointer, text FROM nodes")
def ooxml_nodes(spark, d):
    return A.explode_nodes(office_files(spark, d), "doc_id").select("doc_id", "pointer", "text")


LINES_SQL = f"""{NODES_SQL}, lines AS (SELECT doc_id * 100000 + text_index AS line_id, doc_id, text FROM nodes),
  line_findings AS ({S.findings_sql('lines', 'line_id')}),
  line_resolved AS (SELECT *, unauthorized_action AS effective_action FROM line_findings),
  line_redacted AS ({S.redacted_sql('line_resolved', 'lines', 'line_id')}),
  file_decision AS (SELECT line_id // 100000 AS doc_id, max({S.case('unauthorized_action', S.ACTION_RANK)}) AS top FROM line_findings GROUP BY 1)"""


@query("ooxml_rewrite", f"""WITH {LINES_SQL} SELECT l.doc_id, l.line_id % 100000 AS text_index, CASE WHEN d.top = 1 THEN r.redacted ELSE l.text END AS text
  FROM lines l JOIN line_redacted r ON r.line_id = l.line_id LEFT JOIN file_decision d ON d.doc_id = l.doc_id""")
def ooxml_rewrite(spark, d):
    """Rewritten archives, opened again."""
    done = A.scan_office(office_files(spark, d), V.CONFIG, P.local_principal())
    return A.explode_nodes(done, "doc_id", content="rewritten").select("doc_id", F.col("text_index").cast("bigint").alias("text_index"), "text")


BUDGET = 1500


@query("text_budget", f"""WITH {NODES_SQL} SELECT doc_id, text_index, substring(text, 1, ({BUDGET} - before)::INT) AS text, truncated FROM (
  SELECT *, sum(length(text)) OVER (PARTITION BY doc_id) > {BUDGET} AS truncated, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY text_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes) WHERE before < {BUDGET}""")
def text_budget(spark, d):
    folder = J.work_dir(spark, "nodes")
    A.explode_nodes(office_files(spark, d), "doc_id").select("doc_id", F.col("text_index").cast("bigint").alias("text_index"), "text").write.parquet(folder)
    nodes = spark.read.schema("doc_id bigint, text_index bigint, text string").parquet(folder)
    return A.apply_budget(nodes, BUDGET, "doc_id", "text_index", dense=True)


@query("part_findings", f"""WITH {LINES_SQL} SELECT f.line_id // 100000 AS doc_id, f.rule_name, concat('/attachments/file/word/document.xml#text/', f.line_id % 100000) AS pointer,
  '/attachments/file' AS part_pointer FROM line_findings f""")
def part_findings(spark, d):
    files = office_files(spark, d)
    done = A.scan_office(files, V.CONFIG, P.local_principal())
    folder = J.work_dir(spark, "findings")
    done.select("doc_id", F.explode("resolved").alias("f")).select("doc_id", "f.rule_name", "f.pointer").write.parquet(folder)
    found = spark.read.schema("doc_id bigint, rule_name string, pointer string").parquet(folder)
    parts = V.table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("/attachments/file"), F.lit("/attachments/fil"), F.lit("/other"))).alias("pointer"))
    return A.part_findings(found, parts, "doc_id").select("doc_id", "rule_name", "pointer", "part_pointer")


# Ten documents make one request; every third part is of a type that cannot be rewritten.
@query("attachment_fallback", f"""WITH per AS (SELECT t.doc_id // 10 AS request, max(coalesce({S.case('f.unauthorized_action', S.ACTION_RANK)}, 0)) AS top,
    bool_or(t.doc_id % 3 = 0 AND f.doc_id IS NOT NULL) AS stuck FROM scan_docs t LEFT JOIN findings f ON f.doc_id = t.doc_id GROUP BY 1)
  SELECT request, CASE WHEN stuck AND top = 1 THEN 'review' ELSE {S.action_of('top')} END AS decision,
    CASE WHEN stuck AND top = 1 THEN 'attachment_review_fallback' ELSE 'builtin' END AS source FROM per""")
def attachment_fallback(spark, d):
    from shroudline.operators import detect as D

    found = D.detect(V.scan_docs(spark, d), V.CONFIG, pointer=F.lit("/attachments/file"))
    parts = found.select(
        F.floor(F.col("doc_id") / 10).alias("request"), (F.col("doc_id") % 3 != 0).alias("rewritable"),
        P.resolve(F.col("findings"), P.local_principal(), F.lit("request")).alias("resolved"),
    )
    return A.attachment_decision(parts, "request").select("request", "decision", "source")


S.VIEWS["open_resolved"] = "SELECT *, unauthorized_action AS effective_action FROM findings"
S.VIEWS["open_redacted"] = S.redacted_sql("open_resolved", "scan_docs", "doc_id")


@query("attachment_text", "SELECT t.doc_id, r.redacted AS text, coalesce(f.n, 0) AS n_findings, FALSE AS truncated FROM scan_docs t JOIN open_redacted r ON r.doc_id = t.doc_id "
       "LEFT JOIN (SELECT doc_id, count(*) AS n FROM findings GROUP BY doc_id) f ON f.doc_id = t.doc_id")
def attachment_text(spark, d):
    parts = V.scan_docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("content"), F.lit("/attachments/file").alias("pointer"))
    done = A.scan_text_parts(parts, V.CONFIG, P.local_principal())
    return done.select("doc_id", F.col("rewritten").cast("string").alias("text"), F.size("resolved").cast("bigint").alias("n_findings"), "truncated")


def damaged_files(spark, d):
    """Office files of which some cannot be read: by doc_id modulo 8 cut short, with a wrong checksum, marked as encrypted, packed in an unknown way."""
    def spoil(contents: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for content, kind in zip(contents.to_pylist(), kinds.to_pylist()):
            data = bytearray(content)
            central = data.rfind(b"PK\x01\x02", 0, data.rfind(b"PK\x01\x02"))  # directory entry of the text
            if kind == 1:
                data = data[: len(data) // 2]
            elif kind == 2:
                data[16 + central] ^= 255
            elif kind == 3:
                data[6] |= 1
                data[8 + central] |= 1
            elif kind == 4:
                data[8] = data[10 + central] = 99
            out.append(bytes(data))
        return pa.array(out, pa.binary())

    return office_files(spark, d).withColumn("content", F.arrow_udf(spoil, "binary")(F.col("content"), (F.col("doc_id") % 8).cast("int")))


@query("attachment_unreadable", f"""WITH per AS (SELECT t.doc_id, t.doc_id % 8 IN (1, 2, 3, 4) AS failed, max(coalesce({S.case('f.unauthorized_action', S.ACTION_RANK)}, 0)) AS top
    FROM scan_docs t LEFT JOIN line_findings f ON f.line_id // 100000 = t.doc_id GROUP BY ALL)
  SELECT doc_id, CASE WHEN failed THEN 'block' ELSE {S.action_of('top')} END AS decision, failed, failed AS withheld FROM per""".replace("WITH per", f"WITH {LINES_SQL}, per", 1))
def attachment_unreadable(spark, d):
    done = A.scan_office(damaged_files(spark, d), V.CONFIG, P.local_principal())
    return done.select("doc_id", "decision", F.col("error").isNotNull().alias("failed"), F.col("rewritten").isNull().alias("withheld"))
