from __future__ import annotations

from deltamesh.streaming.snapshots import churn_of_windows, stream_to_table, windowed_edges


def test_stream_gives_the_batch_windows(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 00:00:00", f"u{d % 3}", f"v{d % 2}", "t") for d in range(1, 29)]
    df = spark.createDataFrame(rows, "ts string, s string, t string, k string").selectExpr("cast(ts as timestamp) ts", "s", "t", "k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    names = {"source": "s", "target": "t", "kind": "k"}
    q = stream_to_table(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), **names)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    full = windowed_edges(df, **names)
    last = full.agg({"window_start": "max"}).first()[0]
    want = {tuple(r) for r in full.where(full.window_start < last).collect()}
    got = {tuple(r) for r in out.collect()}
    assert got <= {tuple(r) for r in full.collect()} and want <= got | {r for r in want if r[0] == last}
    assert churn_of_windows(full).count() == full.select("window_start").distinct().count() - 1
