from kvstrata.sources import runs
from kvstrata.streaming import tail


def test_log_is_tailed(spark, tmp_path):
    path = str(tmp_path / "log")
    state = {}

    def sink(batch, _):
        state.update({(r.store_id, bytes(r.key)): (r.tsn, r.op) for r in batch.collect()})

    for n in range(3):
        runs.from_rows(spark, [("s", f"k{i}".encode(), n * 10 + i, "DEL" if i == n else "PUT", b"") for i in range(4)]).coalesce(1).write.mode("append").parquet(path)
        tail.write_latest(tail.tail(spark, path), sink, str(tmp_path / "checkpoint")).awaitTermination()
        assert state == {("s", f"k{i}".encode()): (n * 10 + i, "DEL" if i == n else "PUT") for i in range(4)}


def test_windows(spark, small):
    events = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).parquet(f"{small}/events.parquet*")
    rows = events.selectExpr("'s' AS store_id", "CAST(ts AS timestamp) AS ts", "IF(event_type = 'error', 'DEL', 'PUT') AS op")
    q = tail.changes_per_window(rows, "ts", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT sum(puts) + sum(deletions) FROM windows").first()[0]
    assert got == spark.read.parquet(f"{small}/events.parquet").count()
