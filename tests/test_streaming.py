from lexispark.session import Session
from lexispark.streaming.micro_batch import each_batch, to_parquet


def test_batches_are_answered(spark, tmp_path):
    session = Session(spark)
    session.sql("CREATE MODEL('m', 'rules', 'offline', {\"model_parameters\": {\"rule\": \"upper\"}})")
    spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, t string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    answer = session.llm_complete({"model_name": "m"}, {"prompt": "x", "context_columns": [{"data": "t"}]})
    writer = each_batch(stream, lambda b: b.withColumn("a", answer), to_parquet(str(tmp_path / "out")))
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3 and {r["a"] for r in got.collect()} == {f"T{i}" for i in range(20)}
    session.close()
