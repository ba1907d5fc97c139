from pyspark.sql import functions as F

from vigilog.session import scratch_path
from vigilog.sources.state import KeyedStateTable
from vigilog.streaming import keyed, streams


def put(spark, base, i, users):
    df = spark.createDataFrame([(i, u) for u in users], "part int, user_name string")
    df.coalesce(1).write.parquet(f"{base}/in/p{i}")
    return df.schema


def test_stream_flags_and_bursts_by_key(spark):
    base = scratch_path(spark, "test-keyed")
    for i, users in enumerate((["a", "a", None], ["a", "b"], ["c", "b", "b", "b"])):
        schema = put(spark, base, i, users)
        for name in ("new_entities", "burst_scores"):
            getattr(keyed, name)(streams.file_stream(spark, f"{base}/in/*", schema), "user_name", f"{base}/{name}", f"{base}/{name}-cp")
    new = sorted((r.part, r.user_name or "", r.is_new) for r in spark.read.parquet(f"{base}/new_entities").collect())
    assert new == [(0, "", 0.0), (0, "a", 1.0), (0, "a", 1.0), (1, "a", 0.0), (1, "b", 1.0), (2, "b", 0.0), (2, "b", 0.0), (2, "b", 0.0), (2, "c", 1.0)]
    burst = {(r.part, r.user_name): r.burst for r in spark.read.parquet(f"{base}/burst_scores").collect()}
    assert burst == {(0, "a"): 1.0, (0, None): 1.0, (1, "a"): 1 / 3, (1, "b"): 1.0, (2, "b"): 3 / 4, (2, "c"): 1.0}
    assert {r.user_name: r.n for r in keyed.state_of(spark, f"{base}/new_entities-cp").collect()} == {"a": 3, "b": 4, "c": 1}


def test_a_micro_batch_touches_only_its_keys(spark):
    base = scratch_path(spark, "test-keyed")
    schema = put(spark, base, 0, [f"u{i}" for i in range(300)])
    run = lambda: keyed.new_entities(streams.file_stream(spark, f"{base}/in/*", schema), "user_name", f"{base}/out", f"{base}/cp")
    run()
    put(spark, base, 1, ["u7"] * 5000 + ["u8", "new"])
    (store,) = run().lastProgress["stateOperators"]
    assert store["numRowsTotal"] == 301 and store["numRowsUpdated"] == 3
    assert store["customMetrics"]["rocksdbGetCount"] < 30
    late = {r.user_name: r.is_new for r in spark.read.parquet(f"{base}/out").where("part = 1").distinct().collect()}
    assert late == {"u7": 0.0, "u8": 0.0, "new": 1.0}


def test_a_hot_key_meets_the_state_as_a_few_rows(spark):
    df = spark.range(100_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    counts = keyed.task_counts(df.where("k = 'hot' OR k < '2'"), "k")
    assert counts.where("k = 'hot'").count() <= 12 and counts.agg(F.sum("n")).first()[0] == df.where("k = 'hot' OR k < '2'").count()


def counters(spark, path, buckets=16):
    return KeyedStateTable(spark, path, "k", "k string, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), buckets)


def test_buckets_of_other_keys_are_neither_read_nor_written(spark):
    table = counters(spark, scratch_path(spark, "test-buckets"))
    many = spark.createDataFrame([(f"k{i}", 1) for i in range(200)], "k string, n long")
    table.write(many, 0)
    first = table.versions()
    one = spark.createDataFrame([("k7", 5)], "k string, n long")
    files = table.before(1, one).inputFiles()
    assert len({f.split("_bucket=")[1].split("/")[0] for f in files}) == 1
    table.write(one, 1)
    now = table.versions()
    assert len(first) == 16 and sorted(now.values()) == [0] * 15 + [1]
    got = {r.k: r.n for r in table.before().collect()}
    assert got == {**{f"k{i}": 1 for i in range(200)}, "k7": 6}
    assert table.before(0).isEmpty() and {r.k: r.n for r in table.before(1).collect()} == {f"k{i}": 1 for i in range(200)}


def test_a_repeated_batch_changes_nothing_and_old_versions_go(spark):
    table = counters(spark, scratch_path(spark, "test-buckets"), 2)
    for batch in range(6):
        part = spark.createDataFrame([("a", 1), ("b", 1), (f"c{batch}", 2)], "k string, n long")
        table.write(part, batch)
        table.write(part, batch)
    assert {r.k: r.n for r in table.before().collect()} == {"a": 6, "b": 6, **{f"c{i}": 2 for i in range(6)}}
    assert len(table._numbers(f"{table.path}/data", "batch")) <= 4 and len(table._numbers(table.path, "manifest")) == 2
    table.write(spark.createDataFrame([], "k string, n long"), 6)
    assert table.before().count() == 8
