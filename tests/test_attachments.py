import io
import zipfile

from pyspark.sql import functions as F

from shroudline.config import DEFAULT_RULES, Detection
from shroudline.operators import attachments as A, policy as P

EMAIL_ONLY = Detection(rules=(DEFAULT_RULES[0],), high_entropy=None)
XML = '<?xml version="1.0" encoding="UTF-8"?><d a="x@y.example"><t>邮箱 admin@example.com</t> <t>A &amp; b@c.example</t><![CDATA[<raw> d@e.example]]><!-- f@g.example --></d>'


def office():
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", XML)
        archive.writestr("xl/sharedStrings.xml", "<s><t>plain</t></s>")
        archive.writestr("docProps/core.xml", "<s>x@y.example</s>")
        archive.writestr("word/media/pixel.bin", bytes(range(256)))
    return target.getvalue()


def files(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c), "/attachments/file") for i, c in enumerate(contents)], "i int, content binary, pointer string")


def test_office_text_nodes(spark):
    rows = A.explode_nodes(files(spark, office(), b"not a zip"), "i").collect()
    assert [(r.pointer, r.text) for r in rows] == [
        ("/attachments/file/word/document.xml#text/0", "邮箱 admin@example.com"), ("/attachments/file/word/document.xml#text/1", "A & b@c.example"),
        ("/attachments/file/word/document.xml#text/2", "<raw> d@e.example"), ("/attachments/file/xl/sharedStrings.xml#text/0", "plain"),
    ]


def test_office_rewrite_changes_only_text_with_findings(spark):
    done = A.scan_office(files(spark, office()), EMAIL_ONLY, P.local_principal(), 10_000).first()
    assert done.decision == "redact"
    with zipfile.ZipFile(io.BytesIO(bytes(done.rewritten))) as archive:
        assert archive.read("word/document.xml").decode() == (
            XML.replace("admin@", "a***@").replace("b@c", "b***@c").replace("d@e", "d***@e"))
        assert archive.read("word/media/pixel.bin") == bytes(range(256))
        assert archive.read("docProps/core.xml") == b"<s>x@y.example</s>"
        assert archive.namelist() == ["word/document.xml", "xl/sharedStrings.xml", "docProps/core.xml", "word/media/pixel.bin"]


def test_budget_limits_what_is_scanned(spark):
    done = A.scan_office(files(spark, office()), EMAIL_ONLY, P.local_principal(), 21).first()
    assert [f.matched for f in done.resolved] == ["admin@example.com"]


def spoiled(kind):
    data = bytearray(office())
    entry = data.find(b"PK\x01\x02")
    if kind == "encrypted":
        data[6] |= 1
        data[entry + 8] |= 1
    elif kind == "packed":
        data[8] = data[entry + 10] = 99
    elif kind == "short":
        data = data[:-30]
    elif kind == "checksum":
        data[14] ^= 1
        data[entry + 16] ^= 1
    elif kind == "xml":
        target = io.BytesIO()
        with zipfile.ZipFile(target, "w") as archive:
            archive.writestr("word/document.xml", "<a><b>leak@corp.example</a>")
        data = target.getvalue()
    elif kind == "encoding":
        target = io.BytesIO()
        with zipfile.ZipFile(target, "w") as archive:
            archive.writestr("word/document.xml", '<?xml version="1.0" encoding="no-such"?><a>leak@corp.example</a>')
        data = target.getvalue()
    elif kind == "empty":
        data = b""
    return bytes(data)


def test_unreadable_files_are_withheld(spark):
    kinds = ["encrypted", "packed", "short", "checksum", "xml", "encoding", "empty"]
    done = A.scan_office(files(spark, *map(spoiled, kinds), office()), EMAIL_ONLY, P.local_principal()).orderBy("i").collect()
    for kind, row in zip(kinds, done):
        assert (row.decision, row.rewritten, list(row.resolved)) == ("block", None, []) and row.error, kind
    assert done[-1].decision == "redact" and done[-1].error is None


def test_file_that_cannot_be_written_again(spark):
    data = bytearray(office())  # the text reads well, the picture does not
    local, entry = data.rfind(b"PK\x03\x04"), data.rfind(b"PK\x01\x02")
    data[local + 8] = data[entry + 10] = 99
    row = A.scan_office(files(spark, bytes(data)), EMAIL_ONLY, P.local_principal(), on_unreadable="review").first()
    assert (row.decision, row.rewritten) == ("review", None) and row.error and len(row.resolved) == 3


def test_text_beyond_the_budget_is_marked(spark):
    whole = A.scan_office(files(spark, office()), EMAIL_ONLY, P.local_principal()).first()
    assert (whole.truncated, whole.decision, len(whole.resolved)) == (False, "redact", 3)
    short = A.scan_office(files(spark, office()), EMAIL_ONLY, P.local_principal(), 1).first()
    assert (short.truncated, short.decision, len(short.resolved)) == (True, "review", 0)
    left = A.scan_office(files(spark, office()), EMAIL_ONLY, P.local_principal(), 1, on_truncated=None).first()
    assert (left.truncated, left.decision) == (True, "allow")
    parts = files(spark, b"0123456789 a@b.example", b"short")
    out = A.scan_text_parts(parts, EMAIL_ONLY, P.local_principal(), 10).orderBy("i").collect()
    assert [(r.truncated, r.decision) for r in out] == [(True, "review"), (False, "allow")]
    assert [r.truncated for r in A.scan_text_parts(parts, EMAIL_ONLY, P.local_principal()).orderBy("i").collect()] == [False, False]


def test_decision_of_a_failed_part_counts(spark):
    done = A.scan_office(files(spark, b"no archive"), EMAIL_ONLY, P.local_principal()).withColumn("request_id", F.lit("r")).withColumn("rewritable", F.lit(True))
    assert A.attachment_decision(done).first().decision == "block"


def test_text_parts_keep_bad_bytes_readable(spark):
    done = A.scan_text_parts(files(spark, b"a@b.example \xff"), EMAIL_ONLY, P.local_principal(), 1000).first()
    assert bytes(done.rewritten).decode() == "a***@b.example �"


def test_part_prefixes(spark):
    found = spark.createDataFrame([("r", "/attachments/a"), ("r", "/attachments/a/w.xml#text/0"), ("r", "/attachments/ab"), ("q", "/attachments/a")], "request_id string, pointer string")
    parts = spark.createDataFrame([("r", "/attachments/a")], "request_id string, pointer string")
    assert sorted(r.pointer for r in A.part_findings(found, parts).collect()) == ["/attachments/a", "/attachments/a/w.xml#text/0"]


def test_pieces_of_pointers_are_never_broadcast(spark):
    found = spark.createDataFrame([("r", "/attachments/a#text/0")], "request_id string, pointer string")
    parts = spark.createDataFrame([("r", "/attachments/a")] * 3, "request_id string, pointer string")
    plan = A.part_findings(found, parts)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "_r_part_pointer" in line and "Inner" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_unwritable_parts_go_to_review(spark):
    resolved = "array<struct<action:string>>"
    rows = [("a", True, [("redact",)]), ("a", False, []), ("b", True, []), ("b", False, [("redact",)]), ("c", False, [("block",)]), ("d", True, [])]
    df = spark.createDataFrame(rows, f"request_id string, rewritable boolean, resolved {resolved}")
    got = {r.request_id: (r.decision, r.source) for r in A.attachment_decision(df).collect()}
    assert got == {"a": ("redact", "builtin"), "b": ("review", A.REVIEW_SOURCE), "c": ("block", "builtin"), "d": ("allow", "builtin")}


def test_types(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(A.rewritable(F.lit("text/plain"), F.lit(None).cast("string"))) and one(A.rewritable(F.lit("x/y"), F.lit("A.DOCX")))
    assert not one(A.rewritable(F.lit("image/png"), F.lit("a.png")))
    assert one(A.part_pointer(F.lit(None).cast("string"), F.lit("f.txt"))) == "/attachments/f.txt"
