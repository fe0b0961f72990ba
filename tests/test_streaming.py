from binfold.operators import one_axis
from binfold.operators.histogram import build
from binfold.streaming.incremental import over_span, windowed


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windowed(stream, ["value"], "1DxP", "ts", "1 day", "365 days")
    query = out.writeStream.outputMode("update").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    # update mode tells a bin's count anew each time: the last one counts
    stored = spark.sql("SELECT window_start, window_end, kind, code, max(count) AS count FROM hist GROUP BY ALL")
    got, want = over_span(stored, "1DxP"), build(source, "value", "1DxP")
    rows = lambda h: sorted(str(tuple(r)) for r in h.df.select("kind", "code", "count").collect())
    assert rows(got) == rows(want)
    assert one_axis.percentile(got, [50]).first() == one_axis.percentile(want, [50]).first()
    some = over_span(stored, "1DxP", start="1900-01-01", end="1900-01-02")
    assert some.df.count() == 0
