"""The streaming extension."""

from changelens.streaming import daily_churn


def test_daily_churn(spark, tmp_path):
    schema = "ts timestamp, author string, added long, deleted long"
    rows = [("2024-01-01 10:00:00", "A", 1, 2), ("2024-01-01 23:00:00", "A", 3, None), ("2024-01-02 01:00:00", "B", 5, 0), ("2024-01-09 00:00:00", "A", 1, 1)]
    spark.createDataFrame(rows, "ts string, author string, added long, deleted long").selectExpr("cast(ts as timestamp) ts", "author", "added", "deleted").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = daily_churn(stream).writeStream.outputMode("update").format("memory").queryName("churn").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((str(r["day"])[:10], r["author"], r["added"], r["deleted"]) for r in spark.table("churn").collect())
    assert got == [("2024-01-01", "A", 4, 2), ("2024-01-02", "B", 5, 0), ("2024-01-09", "A", 1, 1)]
