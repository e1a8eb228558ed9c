"""The stream operators on files read as a stream agree with the batch ones."""

from pyspark.sql import functions as F

from waylake.streaming import events as ev

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string").withColumn("ts", F.to_timestamp("ts"))
    for i in range(2):
        df.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, spark, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


ROWS = [(1, "2026-01-01 00:00:00", 1, "a"), (2, "2026-01-01 00:10:00", 1, "b"), (3, "2026-01-01 02:00:00", 1, "b"), (4, "2026-01-01 00:05:00", 2, "a"), (5, "2026-01-03 00:00:00", 9, "z")]


def test_sessions(spark, tmp_path):
    batch, live = stream(spark, tmp_path, ROWS)
    want = {(r["user_id"], str(r["started"]), r["n"]) for r in ev.sessions(batch, "user_id", "ts", "30 minutes").collect()}
    got = {(r["user_id"], str(r["started"]), r["n"]) for r in run(ev.sessions(live, "user_id", "ts", "30 minutes", "1 day"), spark, tmp_path, "sessions").collect()}
    assert (1, "2026-01-01 00:00:00", 2) in want and len(want) == 4 and got == {w for w in want if w[0] != 9}  # the last is still open


def test_windows(spark, tmp_path):
    batch, live = stream(spark, tmp_path, ROWS)
    want = {(r["event_type"], str(r["started"]), r["n"]) for r in ev.window_counts(batch, "event_type", "ts", "1 hour").collect()}
    got = {(r["event_type"], str(r["started"]), r["n"]) for r in run(ev.window_counts(live, "event_type", "ts", "1 hour", late="1 day"), spark, tmp_path, "windows", "update").collect()}
    assert got >= want


def test_latest(spark, tmp_path):
    batch, live = stream(spark, tmp_path, ROWS)
    assert {(r["user_id"], r["value"]) for r in ev.latest(batch, "user_id", "ts", "event_type").collect()} == {(1, "b"), (2, "a"), (9, "z")}
    rows = [tuple(r) for r in run(ev.latest_changes(live, "user_id", "ts", "event_type"), spark, tmp_path, "latest").select("user_id", "value").collect()]
    assert {u: v for u, v in rows} == {1: "b", 2: "a", 9: "z"}
