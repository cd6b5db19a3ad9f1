from pyspark.sql import functions as F

from orrerix.sources import sinks


def test_write_if_any_and_single_file(spark, tmp_path):
    assert not sinks.parquet_if_any(spark.range(0), str(tmp_path / "none")) and not sinks.exists(spark, str(tmp_path / "none"))
    assert sinks.parquet_if_any(spark.range(3), str(tmp_path / "some")) and spark.read.parquet(str(tmp_path / "some")).count() == 3
    sinks.parquet(spark.range(100).repartition(5), str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    sinks.parquet(spark.range(2), str(tmp_path / "one"), append=True)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 102


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', 1), ("line\nbreak", 2)], "t string, n int")
    sinks.csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), schema=df.schema, header=True, quote='"', escape='"', multiLine=True)
    assert sorted(back.collect()) == sorted(df.collect())


def test_vector_index(spark, tmp_path):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0, 0.0]), ("b", None)], "uri string, embedding array<double>")
    sinks.vector_index(df, str(tmp_path / "v"))
    (row,) = spark.read.parquet(str(tmp_path / "v")).collect()
    assert row.uri == "a" and [round(x, 3) for x in row.embedding] == [0.6, 0.8]


def test_memo_is_by_plan_and_data(spark, tmp_path):
    source, folder = str(tmp_path / "s"), str(tmp_path / "memo")
    sinks.parquet(spark.range(5), source)
    plan = lambda: spark.read.parquet(source).where("id > 1")
    assert sinks.memo(plan(), folder).count() == 3 and sinks.memo(plan(), folder).count() == 3
    assert len(list((tmp_path / "memo").glob("*.parquet"))) == 1
    sinks.parquet(spark.range(9), source)
    assert sinks.memo(plan(), folder).count() == 7  # other data, another result
    assert sinks.memo(spark.read.parquet(source).where("id > 2"), folder).count() == 6


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_side", "right_side"):
            sinks.table(spark.range(50).withColumn(name, F.col("id") * 2), name, "id", buckets=4)
        joined = spark.table("left_side").join(spark.table("right_side"), "id")
        assert joined.count() == 50
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_side", "right_side"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_predictions_follow_a_stream_of_requests(spark, tmp_path):
    """Each micro-batch is scored against what the table has by then; a pair that comes again isn't scored again."""
    from orrerix.streaming.incremental import PredictionTable

    requests, made = str(tmp_path / "requests"), PredictionTable(spark, str(tmp_path / "predictions"), lambda batch: batch["property_token"] * 0.5)

    def ask(*pairs):
        spark.createDataFrame(list(pairs), "inchi string, property_token long").coalesce(1).write.mode("append").parquet(requests)

    ask(("a", 1), ("a", 2), ("a", 1))
    stream = spark.readStream.schema("inchi string, property_token long").option("maxFilesPerTrigger", 1).parquet(requests)
    query = made.follow(stream, str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, made.rows().collect())) == [("a", 1, 0.5), ("a", 2, 1.0)]
        ask(("a", 2), ("b", 1))
        query.processAllAvailable()
        assert sorted(map(tuple, made.rows().collect())) == [("a", 1, 0.5), ("a", 2, 1.0), ("b", 1, 0.5)]
    finally:
        query.stop()
    again = made.follow(stream, str(tmp_path / "checkpoint"))  # what was answered stays answered
    again.processAllAvailable()
    again.stop()
    assert made.view().count() == 3


def test_keys_tell_plans_apart_that_the_hash_does_not(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(type(spark.range(1)), "semanticHash", lambda self: 7)
    spark.range(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    keys = {sinks.memo_key(df.where(f"id > {n}")) for n in range(3)}
    assert len(keys) == 3 and sinks.memo_key(df.where("id > 1")) in keys and isinstance(df, DataFrame)
    wide = df.select(*(F.lit(i).alias(f"c{i}") for i in range(60)))
    assert sinks.memo_key(wide) != sinks.memo_key(wide.withColumn("c59", F.lit(-1)))
