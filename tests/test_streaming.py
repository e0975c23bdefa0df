from pyspark.sql import functions as F

from pagewarden.streaming.audits import reaudit_states, running_scores, score_alerts


def drain(spark, tmp_path, rows, schema, query, mode):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = query(stream).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("SELECT * FROM out_" + tmp_path.name.replace("-", "_")).collect()


def test_running_scores(spark, tmp_path):
    rows = [("2026-01-01 01:00:00", 1, "high", "fail"), ("2026-01-01 02:00:00", 1, "high", "pass"), ("2026-01-01 02:00:00", 1, "low", "info"), ("2026-01-02 02:00:00", 1, "med", "warn")]
    typed = lambda s: running_scores(s.withColumn("ts", F.to_timestamp("ts")))
    out = drain(spark, tmp_path, rows, "ts string, site_id long, severity string, status string", typed, "complete")
    assert sorted((r.score, r.findings) for r in out) == [(50, 2), (55, 1)]


def test_alerts(spark, tmp_path):
    rows = [(1, 10, "a", 80), (1, 11, "b", 77), (1, 12, "c", 73), (2, 13, "a", 50)]
    out = drain(spark, tmp_path, rows, "site_id long, audit_id long, created_at string, overall int", score_alerts, "append")
    assert [tuple(r) for r in out] == [(1, 12, 77, 73)]


def test_state_machine(spark, tmp_path):
    events = [("audit", 0, 0, 0), ("tasks", 1, 2, 0), ("audit", 0, 0, 0), ("tasks", 2, 2, 0), ("audit", 0, 0, 1), ("tasks", 2, 2, 0), ("audit", 0, 0, 0), ("audit", 0, 0, 5)]
    rows = [(1, f"2026-01-01 00:0{k}:00", *e) for k, e in enumerate(events)]
    rows = rows[::-1] + [(2, "2026-01-01 00:00:00", "audit", 0, 0, 0), (2, "2026-01-01 00:00:00", "tasks", 1, 1, 0)]  # not in the order of arrival; of one time tasks come first
    out = drain(spark, tmp_path, rows, "parent_id long, ts string, kind string, done int, total int, broken int", reaudit_states, "append")
    assert sorted((r.parent_id, r.old_state, r.new_state) for r in out) == [(1, "awaiting_fixes", "needs_more_work"), (1, "needs_more_work", "passed"), (2, "awaiting_fixes", "passed")]
