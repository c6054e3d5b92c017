import os

from chronogrid.streaming.ticks import stream_time_since


def test_counts_continue_over_batches(spark, tmp_path):
    schema = "time int, unit long, event double"
    steps = [(0, 1, 0.0), (1, 1, 1.0), (2, 1, 0.0), (3, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0), (2, 2, None), (3, 2, 2.0)]
    source = tmp_path / "in"
    seen = set()
    for batch in (0, 2):
        spark.createDataFrame([s for s in steps if batch <= s[0] < batch + 2], schema).coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("*.parquet"):  # files are taken in order of age
            if f.name not in seen:
                os.utime(f, (1_700_000_000 + batch, 1_700_000_000 + batch))
                seen.add(f.name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream_time_since(stream).writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    out = {(r.time, r.unit): r.since for r in spark.table("ticks").collect()}
    assert len(out) == 8
    assert [out[t, 1] for t in range(4)] == [0, 1, 0, 1]
    assert [out[t, 2] for t in range(4)] == [0, 1, 2, 3]
