import datetime as dt
import os


from shroudline.operators import lines as L
from shroudline.plans.streams import rocksdb
from shroudline.streaming import jobs as J, sessions as SS

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def drop(spark, folder, name, rows, schema, mtime):
    """One input file with a set time, so that files arrive in order."""
    target = folder / name
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(target))
    for entry in os.scandir(target):
        os.utime(entry.path, (mtime, mtime))


def test_lines_over_chunk_and_character_borders(spark):
    data = "data: é1\n\ndata: 漢字\r\nlast".encode()
    for size in (1, 2, 5, 100):
        rows = [("s", i, bytearray(data[at : at + size])) for i, at in enumerate(range(0, len(data), size))] + [("t", 0, bytearray(b"x\n"))]
        got = L.reassemble_lines(spark.createDataFrame(rows, "stream_id string, seq bigint, chunk binary")).orderBy("stream_id", "line_no").collect()
        assert [(r.stream_id, r.line_no, r.line, r.terminated) for r in got] == [
            ("s", 0, "data: é1", True), ("s", 1, "", True), ("s", 2, "data: 漢字\r", True), ("s", 3, "last", False), ("t", 0, "x", True)]


def test_live_lines_keep_the_rest_between_batches(spark, tmp_path):
    schema = "stream_id string, seq bigint, chunk binary, last boolean"
    drop(spark, tmp_path, "a", [("s", 0, bytearray("one\ntw".encode()), False)], schema, 1000)
    drop(spark, tmp_path, "b", [("s", 1, bytearray("o\né".encode()[:3]), False)], schema, 2000)
    drop(spark, tmp_path, "c", [("s", 2, bytearray("é".encode()[1:] + b" end"), True)], schema, 3000)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    folder = J.work_dir(spark, "t")
    with rocksdb(spark):
        J.run_to_files(SS.reassemble_stream(stream), folder).awaitTermination()
    got = spark.read.parquet(f"{folder}/data").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "one"), (1, "two"), (2, "é end")]


def test_sessions_across_batches_and_late_rows(spark, tmp_path):
    schema = "session_id string, row_id string, ts timestamp, us bigint, labels array<string>"

    def row(session, id_, secs, labels):
        at = START + dt.timedelta(seconds=secs)
        return (session, id_, at, int(at.timestamp() * 1_000_000), labels)

    drop(spark, tmp_path, "a", [row("s", "1", 100, ["email"]), row("t", "2", 100, ["email"])], schema, 1000)
    drop(spark, tmp_path, "b", [row("s", "3", 90, ["phone"]), row("t", "4", 161, ["phone"]), row("s", "5", 160, [])], schema, 2000)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    folder = J.work_dir(spark, "t")
    with rocksdb(spark):
        J.run_to_files(SS.correlate_stream(stream, 60, 2), folder).awaitTermination()
    got = {r.row_id: r.escalated for r in spark.read.parquet(f"{folder}/data").collect()}
    assert got == {"1": False, "2": False, "3": True, "5": True, "4": False}


def test_review_ingest_over_batches(spark, tmp_path):
    schema = "request_id string, ts timestamp, fingerprint string"
    drop(spark, tmp_path, "a", [("r1", START, "f"), ("r2", START, "g"), ("r0", START + dt.timedelta(1), "f")], schema, 1000)
    drop(spark, tmp_path, "b", [("r3", START, "f"), ("r4", START, "h")], schema, 2000)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    folder = J.work_dir(spark, "t")
    J.run_review_ingest(stream, folder).awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").select("request_id", "fingerprint", "status").collect()
    assert sorted(map(tuple, rows)) == [("r1", "f", "pending"), ("r2", "g", "pending"), ("r4", "h", "pending")]


def test_counters_over_batches(spark, tmp_path):
    schema = "ts timestamp, kind string"
    drop(spark, tmp_path, "a", [(START, "x"), (START, "y")], schema, 1000)
    drop(spark, tmp_path, "b", [(START, "x")], schema, 2000)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    folder = J.work_dir(spark, "t")
    J.run_counters(stream, ["kind"], folder).awaitTermination()
    assert {r.kind: r.n for r in J.latest_counters(spark, folder, ["window", "kind"]).collect()} == {"x": 2, "y": 1}


def test_review_ingest_reopens_after_resolution(spark, tmp_path):
    def after(hours):
        return START + dt.timedelta(hours=hours)

    asked, closed = "request_id string, ts timestamp, fingerprint string", "ticket_id string, status string, resolved_at timestamp"
    drop(spark, tmp_path / "in", "a", [("r1", START, "f"), ("r2", after(1), "f"), ("r3", after(3), "f"), ("g1", START, "g")], asked, 1000)
    drop(spark, tmp_path / "in", "b", [("r4", after(5), "f"), ("g2", after(5), "g"), ("g3", after(7), "g")], asked, 2000)
    drop(spark, tmp_path / "done", "a", [("r1", "approved", after(2)), ("r2", "approved", after(2))], closed, 1000)
    drop(spark, tmp_path / "done", "b", [("g1", "rejected", after(6))], closed, 2000)
    folder = J.work_dir(spark, "t")
    streams = [spark.readStream.schema(x).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{d}/*") for x, d in ((asked, "in"), (closed, "done"))]
    J.run_review_ingest(streams[0], folder, resolutions=streams[1]).awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").collect()
    assert sorted(r.request_id for r in rows) == ["g1", "g3", "r1", "r3"]
