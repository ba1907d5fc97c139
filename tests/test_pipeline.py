import pytest
from pyspark.sql import functions as F

from vigilog.operators import cleaning, features_batch, filters, paging, rules
from vigilog.operators.features_behaviour import EntityState, behaviour_features
from vigilog.operators.threat import threat_level
from vigilog.session import scratch_path
from vigilog.sources import readers
from vigilog.sources.state import StateTable
from vigilog.streaming import streams


def test_csv_drops_only_long_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",2,3\n')
    df = readers.read_csv(spark, str(path))
    assert sorted(tuple(r) for r in df.select("a", "b", "c").collect()) == [("1", 2, 3), ("4", 5, None), ("x,y", 2, 3)]


def test_raw_csv_skips_first_line_and_fixes_width(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("broken first line\n" + ",".join("abcdefghijkl") + ",extra\nonly,two\n")
    rows = readers.read_raw_csv(spark, str(path)).collect()
    assert len(rows) == 2 and rows[0]["Effective_process"] == "l" and rows[1]["@timestamp"] is None


def test_missing_strategies(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "s string, n int")
    assert [tuple(r) for r in cleaning.handle_missing(df, "fill_default").collect()] == [("a", 1), ("<missing>", 0)]
    assert cleaning.handle_missing(df, "drop").count() == 1 and cleaning.handle_missing(df, "flag").count() == 2
    with pytest.raises(ValueError):
        cleaning.handle_missing(df, "other")


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2)], "id int, k string, t int")
    got = cleaning.deduplicate(df, ["k"], ["t", "id"]).orderBy("k").collect()
    assert [(r.k, r.id) for r in got] == [("a", 2), ("b", 3)]


def test_numbers_are_coerced_only_where_one_converts(spark):
    df = spark.createDataFrame([("1", "x", "2"), ("n/a", "y", "3")], "port_no string, status string, name string")
    out, converted = cleaning.coerce_numbers(df)
    assert converted == {"port_no": 1} and dict(out.dtypes) == {"port_no": "double", "status": "string", "name": "string"}


def test_boolean_clause_defaults(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, s string")
    a, b = F.col("s") == "a", F.col("s") == "b"
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(filters.combine(should=[a, b])) == [2, 3]
    assert ids(filters.combine(must=[F.col("id") > 1], should=[a])) == [2, 3]
    assert ids(filters.combine(must_not=[a])) == [1, 3]
    assert ids(filters.combine(should=[a, b, F.col("id") == 2], minimum=2)) == [2]


def test_threat_level_order(spark):
    df = spark.createDataFrame([
        ("cmd.exe", "bob", "dir", True), ("CMD.EXE", "bob", "dir", False), ("x", "root", "dir", True), ("x", "root", "dir", False),
        ("cmd.exe", "bob", "curl x", False), (None, None, None, None)],
        "process_name string, user_name string, command_line string, is_anomaly boolean")
    got = [r[0] for r in df.select(threat_level(df)).collect()]
    assert got == ["High Threat", "Suspicious", "Critical", "Normal", "Critical", "Normal"]


def test_rule_shapes(spark):
    df = spark.createDataFrame([(1, "Cmd.exe", 5), (2, "sh", 50), (3, None, None)], "doc_id int, process_name string, n int")
    rule = rules.Rule("r", "t", "low", {"a": {"process.name": "cmd.exe"}, "b": {"n": (">", 10)}}, any_of=("a", "b"), ignore_case=True)
    assert sorted(r.doc_id for r in df.filter(rule.predicate(df)).collect()) == [1, 2]
    other = rules.Rule("r", "t", "low", {"all": {"n": (">=", 0)}, "big": {"n": (">", 10)}}, require=("all",), exclude=("big",))
    assert [r.doc_id for r in df.filter(other.predicate(df)).collect()] == [1]


def test_first_batch_has_full_burst(logs):
    out = behaviour_features(logs, EntityState(), ["user"])
    assert out.filter("_ml_user_burst_score <> 1.0").isEmpty()
    assert out.filter("user_name is not null and _ml_user_is_new <> 1.0").isEmpty()


def test_small_batches_are_refused(logs):
    with pytest.raises(ValueError):
        features_batch.batch_features(logs.limit(3))


def test_absent_columns_give_zero(spark, logs):
    out = features_batch.batch_features(logs.select("doc_id", "host_name"))
    assert set(features_batch.FEATURES) <= set(out.columns)
    row = out.agg(F.max("_ml_src_ip_event_count").alias("m")).first()
    assert row.m == 0.0


def test_pages_cover_everything(logs):
    df = logs.select("ts", "event_no").limit(250)
    pages = list(paging.all_pages(df, ["ts", "event_no"], 100))
    assert [len(p) for p in pages] == [100, 100, 50]


def test_time_filter_is_pushed_to_the_scan(spark, sf, capsys):
    from vigilog.sources.logs import logs as view

    df = view(spark, sf).filter(filters.time_range(F.col("ts"), "2024-01-05 00:00:00", "2024-01-06 00:00:00")).select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_state_is_idempotent_and_snapshots(spark):
    table = StateTable(spark, scratch_path(spark, "test-state"), "k string, n long",
                       lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), snapshot_every=2)
    for batch in range(5):
        part = spark.createDataFrame([("a", 1), (f"b{batch}", 2)], "k string, n long")
        table.write(part, batch)
        table.write(part, batch)
    assert {r.k: r.n for r in table.before().collect()} == {"a": 5, **{f"b{i}": 2 for i in range(5)}}
    assert {r.k: r.n for r in table.before(3).collect()} == {"a": 3, "b0": 2, "b1": 2, "b2": 2}
    assert table.before(0).isEmpty()


def test_stream_flags_first_batch_of_each_user(spark):
    base = scratch_path(spark, "test-stream")
    state = streams.entity_state(spark, f"{base}/state", "user_name")
    for i, users in enumerate((["a", "a", None], ["a", "b"])):
        df = spark.createDataFrame([(i, u) for u in users], "part int, user_name string")
        df.coalesce(1).write.parquet(f"{base}/in/p{i}")
        streams.new_entities(streams.file_stream(spark, f"{base}/in/*", df.schema), "user_name", state, f"{base}/out", f"{base}/cp")
    got = sorted((r.part, r.user_name or "", r.is_new) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(0, "", 0.0), (0, "a", 1.0), (0, "a", 1.0), (1, "a", 0.0), (1, "b", 1.0)]


def test_large_in_list_becomes_a_join(spark):
    df = spark.range(5000)
    assert filters.terms_semi(df, "id", list(range(0, 3000, 2))).count() == 1500
