import pytest
from pyspark.sql import functions as F

from hopwise.operators import prefix
from hopwise.operators.fold import verdicts
from hopwise.sources.hops import ev_hops
from hopwise.streaming.verdicts import late_hops, log_batches, run_stream, stream_verdicts


def test_stream_equals_batch(spark, tmp_path):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("session_id < 40")
    for i in range(3):  # three files, three micro-batches; within a file rows come in any order
        part = hops.where(f"hop > {i * 20} and hop <= {(i + 1) * 20 if i < 2 else 10**6}").orderBy(F.desc("hop"))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else state expiry keeps availableNow going
    source = spark.readStream.schema(hops.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_verdicts(source).writeStream.format("memory").queryName("judged").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.session_id, r.hop): (r.tier, round(r.trust, 9), r.matches) for r in spark.table("judged").collect()}
    want = {(r.session_id, r.hop): (r.tier, round(r.trust, 9), ",".join(m.key for m in r.matches)) for r in verdicts(hops).collect()}
    assert got == want and len({t for t, _, _ in got.values()}) >= 3


def batch_rows(judged):
    return {(r.session_id, r.hop): (r.tier, round(r.trust, 9), ",".join(m.key for m in r.matches)) for r in judged.collect()}


def stream_rows(judged):
    return {(r.session_id, r.hop): (r.tier, round(r.trust, 9), r.matches) for r in judged.collect()}


@pytest.fixture
def rocks(spark):
    conf = {"stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "noDataMicroBatches.enabled": "false"}
    own = spark.newSession()
    for k, v in conf.items():
        own.conf.set(f"spark.sql.streaming.{k}", v)
    own.conf.set("spark.sql.shuffle.partitions", "4")
    return own


def test_controls_between_batches(spark, rocks, tmp_path):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("session_id < 12")
    shut = verdicts(hops).where("suspended")
    releases = shut.groupBy("session_id", "channel").agg(F.min("hop").alias("hop"))
    resets = hops.where("session_id % 4 = 0 and hop in (15, 31)").select("session_id", "hop")
    rows = releases.select("session_id", "hop", F.lit("release").alias("control"), "channel").unionByName(resets.selectExpr("session_id", "hop", "'reset' as control", "cast(null as string) as channel"))
    assert releases.count() > 3 and resets.count() > 3
    for i in range(3):
        between = f"hop > {i * 15} and hop <= {(i + 1) * 15 if i < 2 else 10**6}"
        hops.where(between).orderBy(F.desc("hop")).coalesce(1).write.parquet(f"{tmp_path}/hops/{i}")
        rows.where(between).coalesce(1).write.parquet(f"{tmp_path}/controls/{i}")

    def source(df, name):
        return rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")

    out = stream_verdicts(source(hops, "hops"), source(rows, "controls")).writeStream.format("memory").queryName("controlled")
    assert out.option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    want = batch_rows(verdicts(hops, releases=releases, resets=resets))
    assert stream_rows(rocks.table("controlled")) == want != batch_rows(verdicts(hops))
    assert want != batch_rows(verdicts(hops, releases=releases))


def test_history_of_a_long_session(spark, rocks, tmp_path):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.01/events.parquet")).where("hop <= 40 and session_id < 8")
    long = hops.withColumn("hop", (F.col("hop") + 40 * (F.col("session_id") - 1)).cast("int")).withColumn("session_id", F.lit(1).cast("long"))
    long = long.withColumn("hop", F.row_number().over(prefix.Window.partitionBy("session_id").orderBy("hop"))).where("hop <= 200")
    assert long.count() == 200
    for i in range(3):
        long.where(f"hop > {i * 70} and hop <= {(i + 1) * 70}").coalesce(1).write.parquet(f"{tmp_path}/hops/{i}")
    source = rocks.readStream.schema(long.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/hops")
    out = stream_verdicts(source).writeStream.format("memory").queryName("remembered").option("checkpointLocation", f"{tmp_path}/cp")
    assert out.outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    want = {r.hop: ",".join(map(str, r.history)) for r in prefix.history(long).collect()}
    assert {r.hop: r.history for r in rocks.table("remembered").collect()} == want


def test_event_time_puts_shuffled_files_in_order(spark, rocks, tmp_path):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("session_id < 10")
    hops = hops.withColumn("ts", F.timestamp_seconds(F.col("hop") * 10 + 1_700_000_000))
    for i in range(4):  # every file holds hops of all times within two hours
        hops.where(f"hop % 4 = {(i * 3) % 4}").orderBy(F.rand(i)).coalesce(1).write.parquet(f"{tmp_path}/hops/{i}")
    end = hops.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "hop": F.lit(1), "ts": F.timestamp_seconds(F.lit(1_800_000_000))})
    end.coalesce(1).write.parquet(f"{tmp_path}/hops/8")
    late = hops.where("session_id = 1").limit(1).withColumns({"hop": F.lit(9999), "ts": F.timestamp_seconds(F.lit(1_600_000_000))})
    late.coalesce(1).write.parquet(f"{tmp_path}/hops/9")
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    source = rocks.readStream.schema(hops.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/hops")
    out = stream_verdicts(source, delay="12 hours").writeStream.format("memory").queryName("timed").option("checkpointLocation", f"{tmp_path}/cp")
    assert out.outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    judged = rocks.table("timed")
    assert stream_rows(judged) == batch_rows(verdicts(hops))
    everything = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/hops").where("session_id > 0")
    assert [r.hop for r in late_hops(everything, spark.createDataFrame(judged.collect(), judged.schema)).collect()] == [9999]


def test_a_repeated_batch_leaves_the_log_unchanged(spark, tmp_path):
    log, counts = f"{tmp_path}/log", f"{tmp_path}/counts"
    write = log_batches(log, counts)
    batches = [spark.createDataFrame([(i, h, "PASS" if h % 3 else "FLAG") for h in range(5)], "session_id int, hop int, tier string") for i in range(3)]
    for i, b in enumerate(batches):
        write(b, i)
    read = lambda p: sorted(map(str, spark.read.parquet(p).collect()))
    before = read(log), read(counts)
    write(batches[1], 1)
    batches[2].write.mode("overwrite").parquet(f"{log}/batch=2")  # a run that died between its two writes
    write(batches[2], 2)
    assert (read(log), read(counts)) == before and spark.read.parquet(log).count() == 15


def test_run_stream_leaves_settings_alone(spark, tmp_path):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("session_id < 5")
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    judged = run_stream(spark, hops, f"{tmp_path}/s")
    assert stream_rows(judged) == batch_rows(verdicts(hops)) and spark.conf.get(name) == before
    n = {r.tier: r.n for r in spark.read.parquet(f"{tmp_path}/s/counts").groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    assert sum(n.values()) == hops.count()
