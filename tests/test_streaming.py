from pyspark.sql import functions as F

from strataform.plans.schema import s
from strataform.streaming import stream as S


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k * 2 + j, "ab"[j], float(k)) for j in range(2)], "n long, key string, x double").coalesce(1).write.mode("append").parquet(at)
    source = lambda: spark.readStream.schema("n long, key string, x double").option("maxFilesPerTrigger", 1).parquet(at)
    made = run(spark, S.validated(source(), s.object(n=s.int(), key=s.string(), x=s.number().max(1))), "v")
    assert sorted(r["valid"] for r in made) == [False, False, True, True, True, True]
    sums = run(spark, S.scan_by_key(source(), "key", "n", "x", 0.0, lambda a, x: a + x), "scans")
    assert sorted(r["value"] for r in sums if r["key"] == "a") == [0, 1, 3]
    pairs = run(spark, S.pairwise_by_key(source(), "key", "n", "x"), "pairs")
    assert sorted((r["prev"], r["cur"]) for r in pairs if r["key"] == "b") == [(0, 1), (1, 2)]
    windows = run(spark, S.window_by_key(source(), "key", "n", "x", 2), "windows")
    assert sorted(r["items"] for r in windows if r["key"] == "a") == [[0, 1], [1, 2]]
    chunks = run(spark, S.chunk_by_key(source(), "key", "n", "x", 2), "chunks")
    assert sorted((r["key"], r["items"]) for r in chunks) == [("a", [0, 1]), ("b", [0, 1])]
    assert len(run(spark, S.unique(source(), "key"), "first")) == 2
    totals = run(spark, S.aggregated(source(), "key", "x"), "totals", "complete")
    assert {r["key"]: r["sum"] for r in totals} == {"a": 3, "b": 3}
    seen = []
    S.consume(source().select(F.col("n")), lambda df, k: seen.extend(r["n"] for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == list(range(6))
