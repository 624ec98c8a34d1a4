"""Fixtures of the record operators, the catalog, the folds and the streams."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import folds, records
from millrace.sources import files
from millrace.sources.catalog import Catalog, CatalogError
from millrace.streaming import logs

JOB = T.StructType([T.StructField("id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("stock", T.LongType())])


@pytest.fixture
def jobs(spark):
    rows = [("job-30", '{"id":"a","status":"ready"}'), ("job-10", '{"id":"b","status":"claimed","stock":4}'), ("job-20", '{"id":"c","status":"ready"}'), ("job-40", '{"id":"d","status":"ready"}')]
    return spark.createDataFrame(rows, "key string, json string")


def test_take_of_ready_jobs(jobs):
    ready = records.typed(jobs, JOB).where("v.status = 'ready'")
    assert [r.key for r in records.take(ready, 2, "key").collect()] == ["job-20", "job-30"]
    assert records.take(ready, 0, "key").count() == 0 and records.take(ready, -1, "key").count() == 0
    assert [r.v.stock for r in records.typed(jobs, JOB).orderBy("key").collect()] == [4, 0, 0, 0]


def test_malformed_record_fails(spark):
    for bad in ("nonsense{", '{"stock": "four"}'):
        with pytest.raises(Exception, match="MALFORMED"):
            records.typed(spark.createDataFrame([("k", bad)], "key string, json string"), JOB).collect()


def test_state_and_dedupe(spark):
    log = spark.createDataFrame([("a", 1, 10, False), ("b", 2, 20, False), ("a", 3, 11, False), ("b", 4, None, True)], "key string, seq long, value long, deleted boolean")
    assert [(r.key, r.value) for r in records.current_state(log, ["key"], "seq", "deleted").collect()] == [("a", 11)]
    assert {(r.key, r.seq) for r in records.first_wins(log, ["key"], "seq").collect()} == {("a", 1), ("b", 2)}
    assert [r.after for r in records.gaps(spark.createDataFrame([(1,), (2,), (5,), (6,)], "seq long"), "seq").collect()] == [2]
    assert [r.seq for r in records.retained(log, "seq", 2).collect()] == [4, 3]


def test_accounts(spark):
    log = [(1, "deposit", 5), (1, "create", 100), (1, "create", -1), (1, "withdraw", 30), (1, "freeze", 0), (1, "withdraw", 1), (1, "deposit", 7), (1, "freeze", 0), (1, "unfreeze", 0), (1, "withdraw", 1000), (2, "freeze", 0)]
    df = spark.createDataFrame([(a, i, k, n) for i, (a, k, n) in enumerate(log)], "user_id long, seq long, kind string, amount long")
    got = {r.user_id: tuple(r)[1:] for r in folds.accounts(df).collect()}
    assert got == {1: (True, 77, False, 6, 4, 10), 2: (False, 0, False, 0, 1, 1)}
    refused = spark.createDataFrame([(3, 0, "create", -5), (3, 1, "deposit", 1)], "user_id long, seq long, kind string, amount long")
    assert [tuple(r) for r in folds.accounts(refused).collect()] == [(3, False, 0, False, 0, 2, 2)]


def test_account_decisions(spark):
    log = [(1, "deposit", 5), (1, "create", 100), (1, "create", 1), (1, "withdraw", 30), (1, "freeze", 0), (1, "withdraw", 1), (1, "unfreeze", 0), (2, "create", -1), (2, "freeze", 0), (3, "create", 0)] * 1
    df = spark.createDataFrame([(a, i, k, n) for i, (a, k, n) in enumerate(log)], "user_id long, seq long, kind string, amount long")
    got = [(r.accepted, r.effect) for r in folds.account_decisions(df).orderBy("seq").collect()]
    assert got == [(False, 0), (True, 1), (False, 0), (True, 2), (True, 4), (False, 0), (True, 4), (False, 0), (False, 0), (True, 1)]
    assert folds.account_decisions(df.limit(0)).count() == 0


def test_transfers(spark):
    log = [(1, None, "create", 100), (2, None, "create", 0), (1, 2, "transfer", 60), (1, 2, "transfer", 60), (2, None, "freeze", 0), (1, 2, "transfer", 10), (2, 1, "transfer", 5), (1, 2, "begin_transfer", 20), (1, 2, "confirm", 20), (1, 2, "confirm", 20), (1, 9, "transfer", 1)]
    log += [(1, None, "cancel", 0), (1, 2, "begin_transfer", 3), (1, 2, "begin_transfer", 4), (1, 2, "confirm", 3), (1, 2, "confirm", 4), (1, 2, "begin_transfer", 4), (1, 999, "confirm", 4), (5, None, "create", -1)]
    df = spark.createDataFrame([(i, a, b, k, n) for i, (a, b, k, n) in enumerate(log)], "seq long, account long, other long, kind string, amount long")
    got = [(r.reason, r.balance) for r in folds.transfers(df).orderBy("seq").collect()]
    want = [("", 100), ("", 0), ("", 40), ("insufficient_funds", 40), ("", 60), ("", 30), ("account_frozen", 70), ("", 30), ("", 10), ("invalid_workflow", 10), ("account_missing", 10)]
    # a cancel with nothing pending counts, a second begin replaces the first, a confirm must name target and amount and ends what is pending
    assert got == want + [("", 10), ("", 10), ("", 10), ("invalid_workflow", 10), ("invalid_workflow", 10), ("", 10), ("invalid_workflow", 10), ("invalid_amount", None)]


def test_catalog(spark, tmp_path, jobs):
    c = Catalog(spark, str(tmp_path / "db"))
    jobs_set = c.dataset("main", "jobs", "job/v1", max_value_bytes=100)
    assert c.dataset("main", "jobs", "job/v1") is jobs_set
    c.dataset("main", "archive", "job/v1")
    with pytest.raises(CatalogError, match="incompatible"):
        c.dataset("main", "jobs", "job/v2")
    for bad in ("", " x", "a/b"):
        with pytest.raises(CatalogError, match="invalid_input"):
            c.dataset("main", bad, "t")
    c.write(jobs_set, jobs)
    with pytest.raises(CatalogError, match="limit"):
        c.write(jobs_set, jobs.unionAll(jobs))
    again = Catalog(spark, str(tmp_path / "db"))
    assert [r.name for r in again.listing().collect()] == ["archive", "jobs"]
    assert [r.key for r in again.scan(jobs_set).collect()] == ["job-10", "job-20", "job-30", "job-40"]
    assert again.get(jobs_set, "job-20").count() == 1 and again.get(jobs_set, "none").count() == 0


def test_files(spark, tmp_path, jobs):
    odd = jobs.unionAll(spark.createDataFrame([(None, None), ("a,b\n", '"')], jobs.schema)).coalesce(1)
    files.write_json_rows(odd, str(tmp_path / "j"))
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(files.read_json_rows(spark, str(tmp_path / "j"), jobs.schema)) == key(odd)
    (tmp_path / "array.json").write_text('[{"key": "a", "json": "x"}, {"key": "b"}]')
    assert key(files.read_json_arrays(spark, str(tmp_path / "array.json"), jobs.schema)) == [("a", "x"), ("b", None)]
    files.write_trace(odd.where("key like 'job%'"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["key", "json"] and spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 4
    (tmp_path / "transfer-fast-2.json").write_text('{"n": 3}')
    got = files.read_reports(spark, str(tmp_path / "transfer-*.json"), T.StructType([T.StructField("n", T.LongType())]), r"(\w+)-(\w+)-(\d+)\.json").collect()
    assert [tuple(r) for r in got] == [(3, "transfer", "fast", "2")]
    (tmp_path / "c.txt").write_text("12,,cycles,x\n<not counted>,,misses\n7,,instructions\n")
    assert {(r.event, r.n) for r in files.read_counters(spark, str(tmp_path / "c.txt")).collect()} == {("cycles", 12), ("instructions", 7)}


def stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", 1, 40, at(1)), ("a", 2, 80, at(2)), ("b", 3, 8, at(3)), ("a", 1, 40, at(4)), ("b", 4, 100, at(30))]
    df = spark.createDataFrame(rows, "key string, seq long, value long, ts timestamp")
    for k in range(2):
        df.where(F.col("seq") <= 2 if k == 0 else F.col("seq") > 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    read = lambda: logs.read_log(spark, str(tmp_path / "log"), df.schema)
    stream(logs.current_state(read(), "key", "seq", "value"), "state", "complete")
    assert {(r.key, r.value) for r in spark.table("state").collect()} == {("a", 80), ("b", 100)}
    stream(logs.drop_replays(read(), ["key", "seq"], "ts", "1 minute"), "once", "append")
    assert spark.table("once").count() == 4
    stream(logs.ewma(read().where("key = 'b'"), "key", "seq", "value"), "ewma", "update")
    assert spark.table("ewma").orderBy(F.desc("n")).first().average == (3 * 2 + 100) // 4


def test_generated_rows(spark):
    from millrace.functions import generate

    state, want = generate.SEED, []
    for _ in range(50):
        state = (state * generate.MULTIPLIER + generate.INCREMENT) % (1 << 64)
        want.append(state)
    assert generate.states(0, 50).tolist() == want and generate.states(17, 20).tolist() == want[17:37]
    rows = generate.products(spark, 50).orderBy("id").collect()
    assert [r.category for r in rows] == [(s >> 17) % 8 for s in want] and rows[0].id == 1000001 and rows[49].name == "Product-000050"
    assert generate.products(spark, 0).count() == 0


def test_percentiles_of_histograms(spark):
    from millrace.functions.stats import percentile_by_index

    df = spark.createDataFrame([("a", v) for v in (5, 1, 5, 9)] + [("b", 2)], "g string, v long")
    got = percentile_by_index(df, ["g"], "v", {"mid": "ceil(0.5BD * n) - 1", "top": "n - 1"}, "n").orderBy("g").collect()
    assert [tuple(r) for r in got] == [("a", 4, 5, 9), ("b", 1, 2, 2)]
