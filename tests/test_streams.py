"""Windows over two batches: what comes after the watermark is dropped, what comes late before it counts."""

from datetime import datetime

from corpusloom.streaming.activity import window_stats

SCHEMA = "ts timestamp, event_type string, value double"


def rows(spark, *days):
    return spark.createDataFrame([(datetime(2024, 1, d, h), "view", float(d)) for d, h in days], SCHEMA).coalesce(1)


def test_late_rows_are_dropped_and_windows_slide(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"

    def run(slide=None, name="a"):
        stats = window_stats(spark.readStream.schema(SCHEMA).parquet(f"file://{folder}"), "2 days" if slide else "1 day", slide, late="2 days")
        stats.writeStream.format("parquet").option("path", f"{out}-{name}").option("checkpointLocation", f"file://{tmp_path}/checkpoint-{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {(r["window_start"].day, r["n"]) for r in spark.read.parquet(f"{out}-{name}").collect()}

    rows(spark, (1, 5), (1, 6), (2, 1), (10, 0)).write.mode("append").parquet(f"file://{folder}")
    first = run()
    assert first == {(1, 2), (2, 1)}  # day 10 may still get rows
    # of day 2 and 7 after the watermark of day 8, of day 9 before it
    rows(spark, (2, 3), (7, 3), (9, 3), (20, 0)).write.mode("append").parquet(f"file://{folder}")
    assert run() == first | {(9, 1), (10, 1)}
    sliding = run("1 day", "b")
    assert {(1, 4), (2, 2), (9, 2), (10, 1)} <= sliding  # each row in two windows; in one batch nothing is late
