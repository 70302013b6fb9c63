import datetime as dt

from pyspark.sql import functions as F

from declara.operators import analytics
from declara.streaming import live


def scans(spark, days):
    return spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=i % 20), "COMPLIANT" if i % 3 else "NON_COMPLIANT", float(i % 100))
                                  for i, d in enumerate(days)], "id bigint, created_at timestamp, overall_status string, compliance_score double")


def test_trend_equals_batch_on_closed_days(spark, tmp_path):
    df = scans(spark, [i // 10 for i in range(100)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live.run_available(live.live_trend(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.date: tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.date: tuple(r) for r in analytics.daily_trend(df).collect()}
    assert len(got) == 7 and all(batch[d] == row for d, row in got.items())


def test_redelivered_scans_count_once(spark, tmp_path):
    df = scans(spark, [0] * 50)
    for name in ("a", "b"):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_available(live.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_earliest_of_copies_in_one_delivery_counts(spark, tmp_path):
    late_first = scans(spark, [90] * 40).unionByName(scans(spark, [0] * 40)).coalesce(1)
    late_first.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(late_first.schema).parquet(str(tmp_path / "in"))
    live.run_available(live.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in got) == list(range(40)) and {r.created_at.date() for r in got} == {dt.date(2026, 1, 1)}
    # the copies that were dropped have moved the watermark: after it a key is forgotten
    scans(spark, [100] * 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.run_available(live.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def feed(spark, tmp_path, arrivals, shares=3):
    """Changes of a stream to which deliveries (lists of (id, day)) come one after the other; the last one ends it."""
    end = scans(spark, [0]).select(F.lit(None).cast("bigint").alias("id"), F.lit(dt.datetime(2027, 1, 1)).alias("created_at"),
                                   "overall_status", "compliance_score")
    every, stream = None, None
    for n, rows in enumerate(arrivals):
        df = spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=i % 24), "COMPLIANT" if i % 3 else "FAILED",
                                     None if i % 11 == 0 else i % 100 / 10) for i, d in rows],
                                   "id bigint, created_at timestamp, overall_status string, compliance_score double")
        every = df if every is None else every.unionByName(df)
        (df.unionByName(end) if n == len(arrivals) - 1 else df).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream or live.trend_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), shares=shares)
        with live.rocks_state(spark):
            live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out")), every


def test_corrected_trend_equals_batch_trend(spark, tmp_path):
    arrivals = [[(i, i // 10) for i in range(100)], [(i, 20) for i in range(100, 130)],
                [(i, 3) for i in range(200, 230)] + [(300, 21)], [(i, 4) for i in range(400, 405)] + [(500, 3)]]
    changes, every = feed(spark, tmp_path, arrivals)
    got = {r.date: r for r in live.corrected_trend(changes).collect()}
    want = {r.date: r for r in analytics.daily_trend(every).collect()}
    assert {d: tuple(r)[:6] for d, r in got.items()} == {d: tuple(r) for d, r in want.items()}
    late = {r.id for r in live.late_scans(changes).collect()}
    assert late == {*range(200, 230), *range(400, 405), 500}
    assert got["2026-01-04"].revisions == 2 and got["2026-01-01"].revisions == 0
    assert changes.filter("kind = 'day' AND revision = 0").groupBy("day_ms", "share").count().filter("count > 1").count() == 0


def test_nothing_arrives(spark, tmp_path):
    changes, _ = feed(spark, tmp_path, [[]])
    assert live.corrected_trend(changes).count() == live.late_scans(changes).count() == 0
