from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.streaming import session_jumps


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", m, m % 3) for m in (0, 5, 10, 40)] + [(1, "2024-01-01 05:00:00", 99, 1), (2, "2024-01-01 00:01:00", 7, 2), (9, "2024-01-03 00:00:00", 100, 0)]
    df = spark.createDataFrame(rows, "user int, t string, id int, lvl int").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    batch = session_jumps(df, "user", "t", "lvl", "id")
    stream = session_jumps(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "user", "t", "lvl", "id")
    for _ in range(2):  # the second file moves the watermark past the sessions
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.createDataFrame([(9, "2024-01-09 00:00:00", 101, 0)], "user int, t string, id int, lvl int").withColumn("t", F.to_timestamp("t")).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = {tuple(r) for r in spark.read.schema(batch.schema).parquet(f"file://{tmp_path}/out").where("user < 9").collect()}
    assert got == {tuple(r) for r in batch.where("user < 9").collect()} and len(got) == 3
