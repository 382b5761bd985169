from evigraph.streaming import evidence


def test_running_labels(spark, tmp_path):
    schema = "claim string, unit_id string, stance string, weight double, at timestamp"
    rows = [("c", f"u{i % 6}", "support", 1.0, None) for i in range(12)] + [("d", "u", "challenge", 1.0, None)]
    df = spark.createDataFrame(rows, schema).selectExpr("claim", "unit_id", "stance", "weight", "timestamp'2024-01-01 00:00:00' AS at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = evidence.labels(stream).writeStream.outputMode("update").format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["ledger"]: (r["success"], r["bayesian_label"]) for r in spark.table("labels").collect()}
    assert got == {"c": (6.0, "prior_sensitive"), "d": (0.0, "thin_evidence")}
