"""Growing files as a stream, through a restart, against one read at the end."""

import os

import pytest

from threadloom.streaming import appended as ap


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ap.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_growing_files(spark, store, tmp_path):
    files, seen, out = tmp_path / "files", tmp_path / "seen", tmp_path / "out"
    files.mkdir()

    def step(number):
        spark.range(1).selectExpr("1").count()
        ap.observe(spark, f"file://{files}", f"file://{seen}")
        stream = ap.appended(spark.readStream.schema(ap.OBSERVED).json(f"file://{seen}"), most=2, wait_ms=0)
        stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)

    def got(event="line"):
        return sorted((os.path.basename(r.path), r.at, r.line) for r in spark.read.schema(ap.LINES).parquet(f"file://{out}").where(f"event = '{event}'").collect())

    (files / "a").write_bytes("one\ntwo é\nthr".encode())
    (files / "b").write_bytes(b"unfinished")
    (files / "empty").write_bytes(b"")
    step(1)
    assert got() == [("a", 0, "one"), ("a", 4, "two é")] and got("deferred") == [("b", 0, None)]
    with (files / "a").open("ab") as f:
        f.write(b"ee\nfour\n")
    with (files / "b").open("ab") as f:
        f.write(b" no more\n" + b"x" * 100 + b"\n")
    step(2)  # a new query each time: the states come from the checkpoint
    (files / "c").write_bytes(b"late\n")
    step(3)
    want = [(p.name, at, line.decode()) for p in sorted(files.iterdir()) for at, line in _lines(p.read_bytes())]
    assert got() == sorted(want)
    (files / "a").write_bytes(b"new\n")  # shorter than before
    (files / "c").write_bytes(b"LATE\nand more\n")  # another beginning
    step(4)
    assert got("replaced") == [("a", 0, None), ("c", 0, None)]
    assert got() == sorted([*want, ("a", 0, "new"), ("c", 0, "LATE"), ("c", 5, "and more")])


def _lines(raw):
    at = 0
    for x in raw.split(b"\n")[:-1]:
        yield at, x
        at += len(x) + 1


def test_files_that_fail(spark, store, tmp_path):
    seen, out = tmp_path / "seen", tmp_path / "out"

    def step(rows):
        spark.createDataFrame(rows, ap.OBSERVED).coalesce(1).write.mode("append").json(f"file://{seen}")
        stream = ap.appended(spark.readStream.schema(ap.OBSERVED).json(f"file://{seen}"), most=2, wait_ms=10)
        stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((os.path.basename(r.path), r.event) for r in spark.read.schema(ap.LINES).parquet(f"file://{out}").collect())

    gone, back = f"file:{tmp_path}/gone", f"file:{tmp_path}/back"
    assert step([(gone, 5, 0, 100), (back, 5, 0, 100)]) == [("back", "retry_pending"), ("gone", "retry_pending")]
    (tmp_path / "back").write_bytes(b"here\n")
    early = step([(gone, 5, 0, 110), (back, 5, 0, 110)])  # before the wait is over
    assert early == [("back", "retry_pending"), ("gone", "retry_pending")]
    assert step([(gone, 5, 0, 200), (back, 5, 0, 200)]) == [("back", "active"), ("back", "line"), ("back", "retry_pending"), ("gone", "excluded"), ("gone", "retry_pending")]
    assert len(step([(gone, 5, 0, 900), (back, 5, 0, 900)])) == 5  # excluded for good, and nothing new
