import numpy as np

from spanloom.streaming.assign import assign_stream


def test_stateful_assignment(spark, tmp_path):
    schema = "term_id long, occ_id long, embed array<double>"
    rng = np.random.default_rng(3)
    for b in range(3):
        far = [(1, 100, [0.0, 1.0])] if b == 2 else []
        rows = [(1, b * 10 + i, [1.0 + float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01))]) for i in range(6)]
        spark.createDataFrame(rows + far, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = assign_stream(src, buffer_size=10).writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.occ_id: r.status for r in spark.table("assigned").collect()}
    assert len(got) == 19 and got[100] in ("anomaly", "buffered")
    assert sum(s == "buffered" for s in got.values()) in (12, 13)
