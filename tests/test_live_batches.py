"""The live counters run over a few batches, and every batch is work for all cores."""

from pathlib import Path

from shroudline.plans import load, streams


def test_batches_of_all_counters_have_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams.J, "work_dir", lambda spark, name: str(tmp_path / name))
    load()[0]["stream_m_all"](spark, "/root/testdata/sf0.001").count()
    files = len(list((tmp_path / "all-counters" / "in").glob("*.parquet")))
    batches = len([p for p in next(tmp_path.rglob("offsets")).iterdir() if Path(p).name.isdigit()])
    assert 2 <= batches <= streams.BATCHES and files > batches
