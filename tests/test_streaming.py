from palisade.plans.rules import BY_ID
from palisade.streaming import counts_by_window, stream_findings


def test_stream_reports_a_value_once(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0) AS ts, 'from 8.8.8.8 and 9.9.9.9' AS text FROM range(3)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = stream_findings(stream, "id", "text", "ts", [BY_ID["ipv4-public"]])
    q = found.writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").select("digest").distinct().count() == spark.table("found").count() == 2
    assert counts_by_window(spark.table("found"), "ts").agg({"n": "sum"}).first()[0] == 2
