import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import live
from tidemark.streaming.closing import closing_row, run_to_end

T0 = dt.datetime(2024, 1, 1)


def table(spark, hours):
    rows = [(T0 + dt.timedelta(hours=h), k, float(h % 5)) for h in hours for k in ("a", "b")]
    return spark.createDataFrame(rows, "time timestamp, series_id string, value double")


def test_closing_row(spark):
    b = table(spark, range(9)).unionByName(spark.createDataFrame([(None, "c", 99.0), (T0, "d", None)], "time timestamp, series_id string, value double"))
    r = closing_row(b, "time", "value", 10).collect()
    assert len(r) == 1 and r[0].value == 4.0 and r[0].time == T0 + dt.timedelta(days=10, hours=8)
    assert closing_row(b.limit(0), "time").isEmpty()


def test_stream_of_many_files_equals_batch(spark, tmp_path):
    src, whole = str(tmp_path / "in"), table(spark, range(40))
    for day in range(4):  # files in order of time, one batch each
        whole.where((F.hour("time") >= 0) & (F.floor(F.unix_timestamp("time") / 36000) % 100 == (int(T0.timestamp()) // 36000 + day) % 100)).coalesce(1).write.mode("append").parquet(src)
    raw = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(src)
    batch = spark.read.schema(whole.schema).parquet(src)
    for n, build in enumerate((lambda d: live.stream_exceedance_sessions(d, 2.5, "90 minutes"), lambda d: live.stream_duration_depth(d, 6, 2, ["series_id"]))):
        got = run_to_end(raw, batch, build, str(tmp_path / f"run{n}"), "time", "value")
        want = build(batch)
        assert want.count() > 10 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_empty_stream(spark, tmp_path):
    empty = table(spark, range(3)).limit(0)
    empty.write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(empty.schema).parquet(str(tmp_path / "in"))
    assert run_to_end(raw, empty, lambda d: live.stream_exceedance_sessions(d, 2.5, "90 minutes"), str(tmp_path / "run"), "time").isEmpty()
