"""The stream gives what the batch form gives."""

from __future__ import annotations

from conftest import DATA
from pyspark.sql import functions as F

from pustaka.streaming import keyed_state as K


def test_known_answer(spark):
    df = spark.createDataFrame([(1, i, c == "F") for i, c in enumerate("FFSFSFFF")], "k long, t long, bad boolean")
    r = K.health(df, "k", ["t"], F.col("bad")).first()
    assert (r["n_missed"], r["n_newly_down"], r["n_still_down"], r["n_recovered"], r["n_up"], r["is_down"]) == (3, 2, 1, 1, 1, True)


def test_streaks(spark):
    df = spark.createDataFrame([(1, d) for d in ("2024-01-01", "2024-01-02", "2024-01-02", "2024-01-04")], "k long, d string").withColumn("d", F.to_date("d"))
    r = K.streaks(df, "k", "d").first()
    assert (r["n_days"], r["longest"], r["last_run"]) == (3, 2, 1)


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = K.health_stream(stream, "user_id", "event_id", F.col("event_type") == "error")
    q.writeStream.format("memory").queryName("health").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    cols = ("user_id", "n_up", "n_missed", "n_newly_down", "n_still_down", "n_recovered", "is_down")
    got = {tuple(r[c] for c in cols) for r in spark.table("health").collect()}
    want = {tuple(r[c] for c in cols) for r in K.health(e, "user_id", ["event_id"], F.col("event_type") == "error").collect()}
    assert got == want


def test_tumbling_stream_with_watermark(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.write.parquet(src)
    s = K.tumbling(spark.readStream.schema(e.schema).parquet(src), "ts", "event_type", "1 day", "1 hour")
    s.writeStream.format("memory").queryName("tumble").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: {(r["start"], r["event_type"]): r["n"] for r in df.collect()}
    assert key(spark.table("tumble")) == key(K.tumbling(e, "ts", "event_type", "1 day"))


def test_lifecycle_in_small_chunks_and_as_a_stream(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("what", F.element_at(F.array(*[F.lit(x) for x in ("fetched", "failure", "missing", "saved", "verify", "other")]), (F.col("event_id") % 6 + 1).cast("int")))
    rows = sorted((r["user_id"], r["event_id"], r["what"]) for r in e.collect())
    want = {}
    for user, _, what in rows:
        at, n = want.get(user, (0, 0))
        want[user] = (K.MOVES[what][at] if what in K.MOVES else at, n + 1)
    want = {u: (K.LIFE[at], n) for u, (at, n) in want.items()}
    for chunk in (3, 10_000):
        assert {r["user_id"]: (r["state"], r["n_events"]) for r in K.lifecycle(e, "user_id", ["event_id"], F.col("what"), chunk).collect()} == want
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    q = K.lifecycle_stream(spark.readStream.schema(e.schema).parquet(src), "user_id", "event_id", F.col("what"))
    q.writeStream.format("memory").queryName("life").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r["user_id"]: (r["state"], r["n_events"]) for r in spark.table("life").collect()} == want


def test_pages_are_worked_off_once(spark, tmp_path):
    src, done = str(tmp_path / "in"), str(tmp_path / "done")
    schema = "job long, page int, text string"
    go = lambda: K.resume(spark.readStream.schema(schema).parquet(src), ["job", "page"], done, lambda df: df.withColumn("n", F.length("text")), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, 1, "a"), (1, 2, "bb"), (1, 2, "bb")], schema).coalesce(1).write.parquet(src)
    go()
    spark.createDataFrame([(1, 2, "bb"), (2, 1, "ccc")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert sorted((r["job"], r["page"], r["n"]) for r in spark.read.parquet(done).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 3)]


def test_the_last_seen(spark):
    df = spark.createDataFrame([(1, i, i % 5) for i in range(20)] + [(2, 1, None)], "k long, at long, item int")
    assert {(r["k"], r["item"]) for r in K.seen_ring(df, "k", ["at"], "item", 3).collect()} == {(1, 4), (1, 3), (1, 2), (2, None)}
