"""Streams give what the batch twin gives."""

from datetime import datetime, timedelta, timezone
from hashlib import sha256

from pyspark.sql import functions as F

from cairn.streaming import journal, marking, retention


def test_marking_stream_equals_batch(spark, tmp_path):
    """Events late within the watermark, repeated ones, and sessions that end: the last news of each is the batch's."""
    rows = [(1, 0, "point", 0, 1.0), (1, 1, "point", 0, 2.0), (1, 2, "point", 1, 3.0), (2, 3, "point", 0, 1.0), (2, 4, "undo", 0, 0.0), (3, 5, "point", 0, 1.0), (3, 6, "point", 0, 2.0), (3, 7, "point", 0, 9.0), (3, 8, "reset", 0, 0.0), (4, 9, "point", 0, 1.0), (4, 10, "point", 0, 2.0), (4, 11, "point", 0, 9.0)]
    batch = {r.k: (r.plane, r.n_points, r.complete) for r in marking.folded(spark.createDataFrame(rows, "k long, n long, action string, plane long, x double"), "k", "n", 2).collect()}
    assert batch == {1: (1, 1, False), 2: (0, 0, False), 3: (-1, 0, False), 4: (0, 2, True)}
    schema = "k long, n long, action string, plane long, x double, at timestamp"
    begin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    timed = [(*r, begin + timedelta(seconds=r[1])) for r in rows]
    tick = lambda s: (0, 1000 + s, "point", 0, 0.0, begin + timedelta(seconds=s))
    parts = [[timed[1], timed[3], timed[0]], [timed[4], timed[2], timed[1], timed[7]], [timed[5], timed[6], *timed[8:], timed[7]], [tick(40)], [tick(200)], [tick(201)], [tick(202)]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        path, news, kept = str(tmp_path / "in"), [], []
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
            stream = marking.folded_stream(spark.readStream.schema(schema).parquet(path), "k", "n", "at", 2)
            q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: news.extend(df.collect())).trigger(availableNow=True).start()
            q.awaitTermination()
            kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
        last_state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.k: (r.plane, r.n_points, r.complete) for r in news if r.k}
    assert got == batch
    assert last_state < max(kept)  # sessions that are idle are forgotten


def test_journal_goes_on(spark, tmp_path):
    append = journal.appender(str(tmp_path / "j"), "n", "p")
    for i in (0, 1, 1):
        append(spark.createDataFrame([(2 * i, f"p{2 * i}"), (2 * i + 1, f"p{2 * i + 1}")], "n long, p string"), i)
    got = spark.read.parquet(str(tmp_path / "j")).orderBy("n").collect()
    last = "0" * 64
    for r in got:
        assert r.prev == last
        last = sha256(f"{last}\x1e{r.payload}".encode()).hexdigest()
        assert r.hash == last
    assert [r.payload for r in got] == ["p0", "p1", "p2", "p3"]


def test_sweep_stream_equals_batch(spark, tmp_path):
    now = datetime.now(timezone.utc)
    stamps = [now - timedelta(days=9), now - timedelta(hours=25), now + timedelta(hours=1), None]
    rows = [(i, bool(i & 1), bool(i & 2), stamps[i // 8 % 4], bool(i & 4)) for i in range(32)]
    schema = "copy long, active boolean, has_key boolean, created timestamp, locked boolean"
    df, path = spark.createDataFrame(rows, schema), str(tmp_path / "c")
    for part in (rows[:20], rows[20:], rows[5:9]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    q = retention.sweep_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.format("memory").queryName("swept").start()
    q.processAllAvailable()
    q.stop()
    c = F.col
    want = df.select("copy", retention.outcome(c("active"), c("has_key"), c("created"), F.lit(now), 24, c("locked")).alias("outcome")).collect()
    got = spark.table("swept").select("copy", "outcome")
    assert got.count() == 36 and {tuple(r) for r in got.collect()} == {tuple(r) for r in want}
    assert {r.outcome for r in want} == {"kept", "orphaned", "failed", "expired"}
