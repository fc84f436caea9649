from graticule.operators.learn import train_baseline
from graticule.schemas import find_split
from graticule.sources.vectors import memory_samples
from graticule.streaming import predict_stream, windowed_accuracy


def test_stream_of_samples(spark, tmp_path):
    df = memory_samples(spark, [[255, 0, 0, 0], [0, 0, 0, 255]] * 3, [1, 7] * 3, 2, 2).selectExpr("*", "timestamp_seconds(idx * 40) as at")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    protos = train_baseline(df.drop("at"), 2, 2, find_split("digits"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = windowed_accuracy(predict_stream(stream, protos, 2, 2))
    query = counts.writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    rows = spark.table("acc").collect()
    assert sum(r.total for r in rows) == sum(r.correct for r in rows) == 6 and len(rows) == 4
