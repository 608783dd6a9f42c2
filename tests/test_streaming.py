"""Streams give the batch result once all files are read; state is bounded; a restarted ingest changes nothing."""

import datetime as dt
from random import Random

import pytest
from pyspark.sql import functions as F

from assaymill.streaming import sessions as T
from assaymill.streaming.ingest import Ingest
from assaymill.streaming.runs import passes_by_window

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("ts", "event_type AS dimension", "CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END AS score")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = passes_by_window(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("passes").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.orderBy("start", "dimension").collect()))
    assert key(spark.table("passes")) == key(passes_by_window(rows)) and spark.table("passes").agg(F.sum("total")).first()[0] == rows.count()


def replayed(spark, folder, frames, make, mode="append"):
    """The output of a stream that gets the frames one after the other, and its last progress."""
    name = folder.name.replace("-", "_")
    schema, query = frames[0].schema, None
    (folder / "in").mkdir(parents=True)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "progress")).start()
    try:
        for i, f in enumerate(frames):
            f.coalesce(1).write.parquet(str(folder / f"parts{i}"))
            (part,) = (folder / f"parts{i}").glob("*.parquet")
            part.rename(folder / "in" / f"{i}.parquet")
            query.processAllAvailable()
        return sorted(map(tuple, spark.table(name).collect()), key=repr), query.lastProgress
    finally:
        query.stop()


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


RESULTS = "run_id long, ts timestamp, dimension string, score double"


def results(spark, rows):
    return spark.createDataFrame(rows, RESULTS)


def test_windows_and_sessions_with_late_rows(spark, tmp_path):
    """Rows out of order, as late as the watermark allows, and one that joins two sessions; a last row far away closes all."""
    r = Random(1)
    rows = [(r.choice((1, 2, None)), at(m + r.random()), r.choice(("a", None)), r.choice((0.0, 1.0, None))) for m in range(0, 300, 3) if m % 60 < 40]
    batches = [rows[i::4] for i in range(4)]
    batches[0].sort(key=lambda x: x[1])
    batches += [[(7, at(100), "a", 1.0), (7, at(140), "a", 1.0)], [(7, at(120), "a", 0.0)], [(9, at(3000), "z", 1.0)], [(9, at(3001), "z", 1.0)]]
    frames = [results(spark, b) for b in batches]
    whole = results(spark, sum(batches, []))
    closed = lambda df: sorted((tuple(x) for x in df.collect() if x["start"] < at(2000)), key=repr)
    for name, make in (("sliding", lambda d: T.passes_sliding(d, late="6 hours")), ("sessions", lambda d: T.run_sessions(d, late="6 hours"))):
        got, last = replayed(spark, tmp_path / name, frames, make)
        assert got == closed(make(whole)) and last["stateOperators"][0]["numRowsTotal"] < 12
    merged = [x for x in T.run_sessions(whole).collect() if x.run_id == 7]
    assert len(merged) == 1 and merged[0].total == 3 and merged[0].end == at(170)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    frames = [results(spark, [(1, at(0), "a", 1.0)]), results(spark, [(1, at(200), "a", 1.0)]), results(spark, [(1, at(201), "a", 1.0)]), results(spark, [(1, at(1), "a", 1.0), (1, at(900), "a", 1.0)]), results(spark, [(1, at(901), "a", 1.0)])]
    got, _ = replayed(spark, tmp_path / "late", frames, lambda d: T.run_sessions(d, late="10 minutes"))
    assert [(x[1], x[3]) for x in got] == [(at(0), 1), (at(200), 2)]


def test_first_arrivals(spark, tmp_path):
    rows = [(k % 5, at(k), "a", float(k)) for k in range(20)]
    frames = [results(spark, rows[:10]), results(spark, rows[10:]), results(spark, [(99, at(5000), "z", 0.0)]), results(spark, [(98, at(5001), "z", 0.0)])]
    got, last = replayed(spark, tmp_path / "first", frames, lambda d: T.first_arrivals(d, ["run_id"], within="2 hours"))
    batch = T.first_arrivals(results(spark, rows), ["run_id"]).collect()
    assert [x for x in got if x[0] < 90] == sorted(map(tuple, batch)) and last["stateOperators"][0]["numRowsTotal"] <= 2


def test_confirmations(spark, tmp_path):
    schema = "token string, action string, document_id long, file_hash string, ts timestamp"
    e = lambda token, action, doc, content, m: (token, action, doc, content, at(m))
    batches = [
        [e("a", "issue", 1, "h", 0), e("b", "issue", 1, "h", 0), e("c", "issue", 2, "h", 1), e("d", "issue", 3, "h", 1), e("w", "issue", 3, "h", 2), (None, "issue", 1, "h", at(0)), e("q", "look", 1, "h", 0)],
        [e("a", "use", 1, "h", 3), e("c", "use", 9, "h", 3), e("d", "use", 3, "x", 3), e("e", "use", 1, "h", 3)],
        [e("a", "use", 1, "h", 4), e("b", "use", 1, "h", 10.1), e("f", "issue", 5, "h", 5), e("f", "issue", 6, "h", 6), e("f", "use", 6, "h", 15.5)],
        [e("z", "issue", 1, "h", 300)], [e("z", "use", 1, "h", 301)], [e("w", "use", 3, "h", 302)],
    ]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    want = {("a", at(3)): "accepted", ("a", at(4)): "unknown", ("b", at(10.1)): "expired", ("c", at(3)): "other document", ("d", at(3)): "other content", ("e", at(3)): "unknown", ("f", at(15.5)): "accepted", ("z", at(301)): "accepted"}
    batch = T.confirmations(spark.createDataFrame(sum(batches, []), schema)).collect()
    assert {(x.token, x.ts): x.outcome for x in batch} == want | {("w", at(302)): "expired"}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        got, last = replayed(spark, tmp_path / "confirm", frames, lambda d: T.confirmations(d, late="1 minute"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {(t, s): o for t, s, o in got} == want | {("w", at(302)): "unknown"}  # forgotten by its timer
    assert last["stateOperators"][0]["numRowsTotal"] <= 2


TEXTS = {"a.md": "# Head\n\nFirst paragraph of a.\n\n- item", "b.txt": "Only one line.", "c.md": "# Head\n\nFirst paragraph of a.\n\n- item", "d.exe": "no", "e.csv": "name,value\nx,1\n"}


def arrived(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / n).write_text(TEXTS[n])


def contents(tables):
    blocks = tables.blocks().join(tables.documents().select("document_id", "file_name"), "document_id")
    return (
        sorted((x.file_name, x.file_hash) for x in tables.documents().collect()), sorted((x.file_name, x.position, x.block_text) for x in blocks.collect()),
        sorted((x.path.rsplit("/", 1)[1], x.reason) for x in tables.refused().collect()),
    )


@pytest.mark.parametrize("dies_at", ["pending", "blocks", "documents"])
def test_ingest_restarts(spark, tmp_path, dies_at):
    """A batch that dies while it writes is written again by its number; contents that came before aren't taken again."""
    tables = Ingest(spark, str(tmp_path / "tables"))
    assert tables.documents() is None is tables.blocks()
    arrived(tmp_path / "in", ["a.md", "d.exe"])
    assert tables.start(str(tmp_path / "in")).awaitTermination(120)
    arrived(tmp_path / "in", ["b.txt", "c.md", "e.csv"])
    put = tables._put

    def die(rows, name, batch):
        if name == dies_at:
            raise RuntimeError("lost")
        put(rows, name, batch)

    tables._put = die
    with pytest.raises(Exception, match="lost"):
        tables.start(str(tmp_path / "in")).awaitTermination(120)
    assert [x.file_name for x in tables.documents().collect()] == ["a.md"] and {x.document_id for x in tables.blocks().collect()} == {x.document_id for x in tables.documents().collect()}
    again = Ingest(spark, str(tmp_path / "tables"))
    assert again.start(str(tmp_path / "in")).awaitTermination(120)
    first = contents(again)
    assert [x[0] for x in first[0]] == ["a.md", "b.txt", "e.csv"] and first[2] == [("c.md", "duplicate"), ("d.exe", "extension")]
    once = Ingest(spark, str(tmp_path / "once"))
    once.start(str(tmp_path / "in")).awaitTermination(120)
    assert [x for _, x in contents(once)[0]] == [x for _, x in first[0]] and contents(once)[1] == first[1]
    assert again.start(str(tmp_path / "in")).awaitTermination(120)  # nothing new
    assert contents(again) == first and len({x.document_id for x in again.documents().collect()}) == 3
