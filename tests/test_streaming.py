from pyspark.sql import functions as F

from quernlake.operators import corpus_store
from quernlake.operators.facts import attempt_stats
from quernlake.streaming import incremental


def events(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_daily_counts_equal_batch(spark, small, tmp_path):
    batch, stream = events(spark, small, tmp_path)
    got = incremental.run_to_table(incremental.daily_counts(stream, "ts", "event_type"), "daily_counts", "complete", str(tmp_path / "c"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in incremental.daily_counts(batch, "ts", "event_type").collect()}


def test_attempt_state_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 0), (3, 2)], "session_id long, try_seq int")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = incremental.run_to_table(incremental.attempts_per_session(stream), "attempt_state", "update", str(tmp_path / "c"))
    last = {r.session_id: (r.attempt_count, r.max_try_seq) for r in got.groupBy("session_id").agg(F.max("attempt_count").alias("attempt_count"), F.max("max_try_seq").alias("max_try_seq")).collect()}
    assert last == {r.session_id: (r.attempt_count, r.max_try_seq) for r in attempt_stats(rows).collect()}


def test_embedding_stream_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "id string, text string").withColumn("arrived", F.lit("2026-01-01").cast("timestamp"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = incremental.embed_stream(stream, corpus_store.hash_embedder(4), 4)
    got = incremental.run_to_table(made, "embedded", "append", str(tmp_path / "c"))
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_alerts(spark, tmp_path):
    told = []
    for i, (c, t) in enumerate(((20, 200), (80, 200))):
        spark.createDataFrame([(c, t)], "no_attempt long, total long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("no_attempt long, total long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.alert_batches(rows, str(tmp_path / "c"), told.append).awaitTermination()
    assert len(told) == 1 and told[0]["excess"] == 60


def test_alerts_go_on_after_a_restart(spark, tmp_path):
    told, place = [], str(tmp_path / "in")
    for c, t in ((20, 200), (80, 200)):
        spark.createDataFrame([(c, t)], "no_attempt long, total long").coalesce(1).write.mode("append").parquet(place)
        rows = spark.readStream.schema("no_attempt long, total long").parquet(place)
        incremental.alert_batches(rows, str(tmp_path / "c"), told.append).awaitTermination()
    assert len(told) == 1 and told[0]["excess"] == 60


def test_attempts_by_state_of_their_own(spark, tmp_path):
    """Repeated attempts count once, late ones within the watermark count, and batch sums are the oracle."""
    day = lambda d, h=0: f"2026-01-{d:02d} {h:02d}:00:00"
    batches = [[(1, 0, day(1)), (1, 1, day(1, 1)), (2, 1, day(1, 2))], [(1, 1, day(1, 1)), (2, 3, day(1, 3)), (2, 3, day(1, 3))], [(1, 2, day(1, 2)), (3, 1, day(1, 3))], [(4, 1, day(9))], [(4, 1, day(9)), (4, 2, day(9, 1))]]
    schema = "session_id long, try_seq int, try_created_at string"
    for b in batches:
        spark.createDataFrame(b, schema).withColumn("try_created_at", F.col("try_created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kind = "session_id long, try_seq int, try_created_at timestamp"
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        made = incremental.attempt_states(stream, late="4 hours")
        query = made.writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out"))
    last = {r.session_id: (r.attempt_count, r.max_try_seq) for r in told.groupBy("session_id").agg(F.max("attempt_count").alias("attempt_count"), F.max("max_try_seq").alias("max_try_seq")).collect()}
    every = spark.createDataFrame([r for b in batches for r in b], schema).dropDuplicates(["session_id", "try_seq"])
    assert last == {r.session_id: (r.attempt_count, r.max_try_seq) for r in attempt_stats(every).collect()}


def test_checked_ingest(spark, tmp_path):
    from quernlake.schemas import PAYMENT_CSV_COLUMNS
    from quernlake.streaming import checked_ingest

    good = "s1,1,T1,M1,11112222,Title,100,1,Paid,Paid,,P1,B1,C1,Automated,10,,2026-01-01 10:00:00,,,,2026-01-01 11:00:00"
    at = lambda **c: ",".join(c.get(n, v) for n, v in zip(PAYMENT_CSV_COLUMNS, good.split(","), strict=True))
    (tmp_path / "in").mkdir()
    root = str(tmp_path / "root")

    def arrive(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join([",".join(PAYMENT_CSV_COLUMNS), *lines]) + "\n")
        checked_ingest.land(spark, str(tmp_path / "in"), root).awaitTermination()
        checked_ingest.check(spark, root).awaitTermination()

    arrive("a.csv", at(), at(try_seq="2"), at(amount="-5"), at(session_key="s2"), at(session_key="s2"))
    arrive("b.csv", at(try_seq="2"), at(try_seq="3", amount="7"), at(session_key="s3", category_title="Other"), at(session_key="s4", category_id="33334444"), at(session_key="s4", try_status="Odd"))
    rejected = {(r.file, r.reason, r.first_row, r.rows) for r in checked_ingest.first_rejections(spark, root).collect()}
    assert rejected == {
        ("a.csv", "a whole number is invalid, out of range or negative", 3, 1), ("a.csv", checked_ingest.DUPLICATE, 5, 1), ("b.csv", checked_ingest.DUPLICATE, 1, 1),
        ("b.csv", checked_ingest.VARYING, 2, 1), ("b.csv", checked_ingest.TITLES, 3, 1), ("b.csv", "the attempt status is unknown", 5, 1),
    }
    accepted = spark.read.parquet(f"{root}/accepted")
    assert sorted((r.session_key, r.try_seq, r.batch) for r in accepted.collect()) == [("s1", "1", 0), ("s1", "2", 0), ("s2", "1", 0), ("s4", "1", 1)]
    checked_ingest.check(spark, root).awaitTermination()  # nothing new
    assert spark.read.parquet(f"{root}/accepted").count() == 4
