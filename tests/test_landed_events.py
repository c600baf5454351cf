from datetime import datetime, timedelta

from boxrates.conformance import queries


def test_files_of_a_batch_grow_with_the_events(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 1)
    events = [(i, at + timedelta(minutes=i), i % 7, "view", float(i), None) for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events.parquet"))

    def batches(name):
        seen = []

        def on_batch(batch, batch_id):
            files = batch.selectExpr("input_file_name() AS file").groupBy("file").count().collect()
            seen.append((len(files), sum(r["count"] for r in files)))

        stream = queries._live_quotes(spark, str(tmp_path))
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", str(tmp_path / name)).trigger(
            availableNow=True
        ).start().awaitTermination()
        return seen

    whole = batches("whole")
    assert [n for n, _ in whole] == [1] * 4
    monkeypatch.setattr(queries, "LANDED_EVENTS", 20)
    cut = batches("cut")
    assert [n for n, _ in cut] == [5] * 4
    assert sum(n for _, n in cut) == sum(n for _, n in whole)
