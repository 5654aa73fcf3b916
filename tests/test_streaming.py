import datetime as dt

import pytest
from pyspark.sql import functions as F

from bibliome.streaming import events as ev

T = dt.datetime(2024, 1, 1)
ROWS = [(i, T + dt.timedelta(minutes=20 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(30)]
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


@pytest.fixture()
def landed(spark, tmp_path):
    for n, part in enumerate((ROWS[:20], ROWS[10:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_dedup_on_a_stream_equals_batch(spark, landed, tmp_path):
    q = ev.deduplicated(stream(spark, landed)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))


def test_windows_and_sessions_on_a_stream(spark, landed, rows):
    q = ev.tumbling(ev.deduplicated(stream(spark, landed)), lateness=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ev.tumbling(spark.createDataFrame(ROWS, SCHEMA))
    assert set(rows(spark.table("w"))) <= set(rows(batch))
    s = rows(ev.sessions(spark.createDataFrame(ROWS, SCHEMA), "90 minutes").select("user_id", "n"))
    assert s == [(0, 10), (1, 10), (2, 10)]


def test_foreach_batch_is_idempotent(spark, landed, tmp_path):
    sink = ev.append_new(str(tmp_path / "log"))
    ev.run_once(stream(spark, landed), sink, str(tmp_path / "c1"))
    ev.run_once(stream(spark, landed), sink, str(tmp_path / "c1"))  # nothing new
    ev.run_once(stream(spark, landed), sink, str(tmp_path / "c2"))  # all of it replayed
    assert spark.read.parquet(str(tmp_path / "log")).count() == 30


def test_admission(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    late = [(1, T - dt.timedelta(days=400), 0, "x", 0.0), (2, T, 0, "x", 0.0), (3, T + dt.timedelta(days=2), 0, "x", 0.0)]
    assert [r.event_id for r in ev.admitted(ev.timed(spark.createDataFrame(late, SCHEMA)), now).collect()] == [2]


SIGNALS = [(1, "f", T + dt.timedelta(hours=i), i, 1.0 if i < 80 else -1.0, 1.0) for i in range(100)] + [(2, "g", T, 200, 1.0, 5.0)]
SIG = "user_id bigint, feature string, ts timestamp, event_id bigint, direction double, value double"


def test_learned_weights_clamp_in_order(spark, tmp_path):
    df = spark.createDataFrame(SIGNALS, SIG)
    r = ev.learned_weights(df).collect()
    assert len(r) == 1 and r[0].weight == pytest.approx(1.0 - 20 * 0.02) and r[0].observations == 100
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    s = ev.learned_weights_stream(spark.readStream.schema(SIG).parquet(str(tmp_path / "s")))
    q = s.writeStream.format("memory").queryName("weights").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("weights").collect()
    assert len(got) == 1 and got[0].weight == pytest.approx(r[0].weight) and got[0].observations == 100
